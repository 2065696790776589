"""Closures and paths over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators.components import connected_components
from depsift.plans.lineage import cut
from depsift.plans.skew import numbered, spread_join

#: Frontiers that are kept apart before they are written together.
MERGE = 20


def closure(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    """(keys..., node, depth) reachable from starts(keys..., node) along edges, starts at depth 0.

    Edges have src, dst and those of the keys that they hang on; without one, all keys share them.

    One frontier for all keys moves a step a round; nodes met before are dropped, so cycles end. Each round
    is one join and one anti join, and only the new frontier is checkpointed: what was met before is the union
    of the frontiers' checkpoints, never written again, so a lost executor costs one round. Many frontiers are
    written together once in MERGE rounds, so that plans stay short on deep graphs. Joins are by shuffle: a file's
    size tells little of its rows, and what is broadcast goes through the driver anew each round.
    """
    keys = list(keys)
    own = [k for k in keys if k in edges.columns]
    edges = cut(edges.select(*own, "src", "dst").distinct())
    frontier = cut(starts.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    met, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.withColumnRenamed("node", "src").join(edges.hint("merge"), [*own, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(_union(met).hint("merge"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        met.append(frontier)
        if len(met) > MERGE:
            met = [cut(_union(met))]
    return _union(met)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable_split(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Every node with reachable: whether an entrypoint leads to it."""
    met = closure(edges, entrypoints).select("node").withColumn("reachable", F.lit(True))
    return nodes.join(met.hint("merge"), "node", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def affected_targets(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes that depend, in any number of steps, on changed ones, these included."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, changed).select("node")


def call_chains(edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Shortest path from an entrypoint to every reachable node, of several the least node by node: (node, depth, path)."""
    return paths_of(shortest_tree(edges, entrypoints))


def shortest_tree(edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(node, depth, parent) of every reachable node: the node before it on its least shortest path, null for entrypoints.

    Nodes of one depth are numbered in the order of their paths, which is that of their parents' numbers and then their own, so a
    round moves a pair of numbers for each edge out of the frontier and no path. There are as many rounds as the graph is deep.
    """
    edges = cut(edges.select("src", "dst").distinct())
    frontier = numbered(entrypoints.select("node").distinct(), [F.col("node")], "place")
    none = F.lit(None).cast(entrypoints.schema["node"].dataType)
    met, depth = [frontier.select("node", F.lit(0).alias("depth"), none.alias("parent"))], 0
    while True:
        depth += 1
        ahead = frontier.join(edges.hint("merge"), frontier.node == edges.src).select(F.col("dst").alias("node"), F.struct("place", F.col("node").alias("parent")).alias("via"))
        new = ahead.join(_union(met).select("node").hint("merge"), "node", "left_anti").groupBy("node").agg(F.min("via").alias("via")).select("node", "via.*")
        frontier = numbered(new.withColumnRenamed("place", "before"), [F.col("before"), F.col("node")], "place")
        if frontier.isEmpty():
            return _union(met)
        met.append(frontier.select("node", F.lit(depth).alias("depth"), "parent"))
        if len(met) > MERGE:
            met = [cut(_union(met))]


def paths_of(tree: DataFrame) -> DataFrame:
    """(node, depth, path) of a tree (node, depth, parent), rebuilt by pointer doubling.

    After k rounds a node has the last 2^k nodes of its path and a pointer to the one before them, whose own part it takes in
    the next round; so a path of n nodes is whole after log2(n) rounds, and what moves in all of them is the paths' length.
    """
    rows = cut(tree.select("node", "depth", F.array("node").alias("path"), F.col("parent").alias("up")))
    done = []
    while True:
        done.append(rows.where("up is null").select("node", "depth", "path"))
        open_ = rows.where("up is not null")
        if open_.isEmpty():
            return _union(done)
        # pointers lead to whole paths too, so these stay in what is looked up
        parts = _union([d.withColumn("up", F.lit(None).cast(tree.schema["node"].dataType)) for d in done] + [open_])
        parts = parts.select(F.col("node").alias("at"), F.col("path").alias("more"), F.col("up").alias("next"))
        rows = cut(open_.join(parts.hint("merge"), open_.up == parts.at).select("node", "depth", F.concat("more", "path").alias("path"), F.col("next").alias("up")))


def shared_dependencies(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(dep, n, packages) of each dependency that two of the packages or more have, instead of a row for each pair."""
    deps = edges.select(F.col("src").alias("package"), F.col("dst").alias("dep")).distinct().join(packages.select("package").distinct(), "package")
    rows = deps.groupBy("dep").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("package").cast("string"))).alias("packages"))
    return rows.where("n > 1")


def dependency_counts(edges: DataFrame, roots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Direct and transitive dependencies of each key's roots (keys..., node); nodes are whole numbers.

    What a root reaches is found once, however many keys have it, and held as bits: words of 64 nodes with a mask of those reached, a row for each
    root. A key's masks are united by word, so no row is made for a key and a node. Roots that very many keys share are split.
    """
    keys = list(keys)
    roots = roots.select(*keys, "node").where("node is not null").distinct()
    met = closure(edges, roots.select(F.col("node").alias("root"), "node").distinct(), ("root",))
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    when = lambda c: F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long")))
    words = met.groupBy("root", F.shiftright("node", 6).alias("word")).agg(F.bit_or(bit).alias("all"), when(F.col("depth") == 1).alias("next"), when(F.col("depth") == 0).alias("own"))
    sets = cut(words.groupBy("root").agg(F.collect_list(F.struct("word", "all", "next", "own")).alias("words")))
    rows = spread_join(roots.withColumnRenamed("node", "root"), sets, ["root"], keys[0]).select(*keys, F.explode("words").alias("w"))
    united = rows.groupBy(*keys, "w.word").agg(*[F.bit_or(f"w.{c}").alias(c) for c in ("all", "next", "own")])
    left = lambda c: F.sum(F.bit_count(F.col(c).bitwiseAND(F.bitwise_not("own")))).cast("long")
    out = united.groupBy(*keys).agg(left("next").alias("direct"), left("all").alias("every"))
    return out.select(*keys, "direct", (F.col("every") - F.col("direct")).alias("transitive"))


def merge_advisories(records: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Records (pos, id, aliases, cvss, details, urls) of one flaw as one row, groups closed over aliases.

    The base is the first record; aliases are all ids, its own too; the highest score, the longest details and all
    distinct urls stay. Where records have `severity`, that of the highest score stays (the first of several, a null score being 0),
    and where they have `affected`, an array of structs with ecosystem and package, the last record's of each (ecosystem, package).
    `labels` are those of `alias_labels`, which are computed if not given.
    """
    labels = alias_labels(records) if labels is None else labels
    rows = records.join(labels, records.id == labels.node).drop("node")
    more = []
    if "severity" in records.columns:
        more.append(F.min_by("severity", F.when(F.col("severity").isNotNull(), F.struct((-F.coalesce("cvss", F.lit(0.0))).alias("s"), "pos"))).alias("severity"))
    merged = rows.groupBy("component").agg(
        F.min_by("id", "pos").alias("id"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("ids"),
        F.max("cvss").alias("cvss"), F.max_by("details", F.struct(F.length("details"), -F.col("pos"))).alias("details"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.count("*").alias("records"), *more,
    )
    out = ["id", F.array_sort("ids").alias("aliases"), "cvss", "details", "urls", "records", *[c for c in ("severity",) if c in records.columns]]
    if "affected" in records.columns:
        each = rows.select("component", "pos", F.posexplode("affected").alias("at", "a")).groupBy("component", "a.ecosystem", "a.package")
        each = each.agg(F.max_by("a", F.struct("pos", "at")).alias("a")).groupBy("component").agg(F.array_sort(F.collect_list("a")).alias("affected"))
        merged, out = merged.join(each, "component", "left"), [*out, "affected"]
    return merged.select(*out)


def alias_labels(records: DataFrame) -> DataFrame:
    """(node, component) of every id and alias of records (id, aliases): the least id that aliases lead to."""
    pairs = records.select("id", F.explode_outer("aliases").alias("alias")).select("id", F.coalesce("alias", "id").alias("alias"))
    return connected_components(pairs, "id", "alias")


def add_alias_labels(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Labels of `alias_labels` after more records came, as if all had been labelled together.

    Only what the new records touch is joined: their ids and aliases stand for the groups they are in, the groups that new records link are
    united by the least of their labels, and of the old labels those of these groups alone are written anew. Groups are looked up by id; nothing is
    relabelled round by round but the edges of the new records.
    """
    pairs = cut(records.select("id", F.explode_outer("aliases").alias("alias")).select("id", F.coalesce("alias", "id").alias("alias")).distinct())
    ends = pairs.select(F.col("id").alias("node")).union(pairs.select(F.col("alias").alias("node"))).distinct()
    known = cut(ends.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node")))
    group = lambda c: known.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group"))
    links = pairs.join(group("id"), "id").join(group("alias"), "alias").select("id_group", "alias_group")
    united = cut(connected_components(links, "id_group", "alias_group").withColumnRenamed("node", "group").withColumnRenamed("component", "least"))
    fresh = known.where("component is null").join(united, "group").select("node", F.col("least").alias("component"))
    moved = united.where("group <> least").select(F.col("group").alias("component"), "least")
    old = labels.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return old.unionByName(fresh)
