"""Prefix tries of conversations, rolled up by depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import numbered, spread_join

#: Depths of one band; turns whose prefixes one task sums at once; turns whose conversations are one piece of a list.
BAND, PIECE, LIST = 16, 1024, 1024
#: A node: its depth and two hashes of its turns.
NODE = ["depth", "f1", "f2"]


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Turns in order: conv_id, depth (from 1), length (turns of the conversation), place, x1, x2 (hashes of role and text), n_bytes.

    Turns stand by number, null first, then by role and by a digest of the text. Null roles and texts are empty. Rows with a
    null conv_id belong to no conversation and are left out. `place` numbers the turns of the whole table, conversation by
    conversation; a conversation with most of the rows is ordered by many tasks.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("x1"),
        F.xxhash64(F.lit(2), role, text).alias("x2"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("x1"), F.col("x2")], "place")
    convs = cut(rows.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("length")))
    rows = spread_join(rows, convs, ["conv_id"], "place", size="length")
    return cut(rows.select("conv_id", (F.col("place") - F.col("first") + 1).alias("depth"), "length", "place", "x1", "x2", "n_bytes"))


def with_shared_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that take their first turns from the first of their family.

    Conversation c begins with the first h turns of conversation c - c % family, all if it has fewer and none if
    it doesn't exist, followed by its own turns after its first h; h is the unsigned crc32 of c in decimal, modulo
    `heads`. Conversations left without turns keep a row of depth 0.
    """
    convs = turns.where("depth = 1").select("conv_id", "length", F.col("place").alias("first"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    convs = convs.withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_length", F.lit(0))))
    convs = cut(convs.withColumn("total", F.col("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))))
    out = ["conv_id", "depth", "total", "place", "first", "x1", "x2", "n_bytes"]
    tails = spread_join(turns.drop("length"), convs, ["conv_id"], "place", size="length").where("depth > h")
    tails = tails.withColumn("depth", F.col("depth") - F.col("h") + F.col("head"))
    lead = turns.where(F.col("depth") < heads).select(F.col("conv_id").alias("base"), "depth", "place", "x1", "x2", "n_bytes")
    taken = convs.join(lead, "base").where("depth <= head")
    bare = convs.where("total = 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit(None).cast("long").alias("place"), "first",
        *[F.lit(0).cast("long").alias(x) for x in ("x1", "x2", "n_bytes")],
    )
    return tails.select(out).unionByName(taken.select(out)).unionByName(bare.select(out))


def whole_conversations(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that `prefix_trie` takes."""
    return turns.select(
        "conv_id", "depth", F.col("length").alias("total"), "place", (F.col("place") - F.col("depth") + 1).alias("first"), "x1", "x2", "n_bytes"
    )


def prefixes(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each conversation and depth, 0 included: the node (depth, f1, f2) and its parent's hashes (p1, p2).

    A node's two hashes are the exclusive or of 64-bit hashes of each turn together with its depth, so those of a
    prefix come from pieces of `piece` turns that are summed apart, and a parent's from its child's.
    """
    turns = turns.withColumn("h1", F.xxhash64("depth", "x1")).withColumn("h2", F.xxhash64("depth", "x2"))
    own = turns.where("depth > 0").withColumn("piece", F.expr(f"(depth - 1) div {piece}"))
    run = W.partitionBy("conv_id", "piece").orderBy("depth")
    own = own.withColumn("f1", F.bit_xor("h1").over(run)).withColumn("f2", F.bit_xor("h2").over(run))
    # what the pieces before hold; a row for each piece of long conversations alone
    long_ = turns.where(f"depth > 0 and total > {piece}").groupBy("conv_id", F.expr(f"(depth - 1) div {piece}").alias("piece"))
    before = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sums = long_.agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv_id", "piece", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2")).where("piece > 0")
    own = own.join(sums, ["conv_id", "piece"], "left")
    for k in "12":
        own = own.withColumn(f"f{k}", F.col(f"f{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0).cast("long"))))
        own = own.withColumn(f"p{k}", F.col(f"f{k}").bitwiseXOR(F.col(f"h{k}")))
    out = ["conv_id", *NODE, "p1", "p2", "n_bytes", "total", "first", "place"]
    zero = [F.lit(0).cast("long").alias(c) for c in (*NODE, "p1", "p2", "n_bytes")]
    roots = turns.where("depth = least(1, total)").select("conv_id", *zero, "total", "first", F.lit(None).cast("long").alias("place"))
    return own.select(out).unionByName(roots.select(out))


def band_totals(paths: DataFrame, own: DataFrame, sums: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """Sums over the subtree of each node, itself included: depth, f1, f2, conv_id and `sums`.

    `paths` has a row (conv_id, depth, f1, f2) for each conversation and depth from 0 on, `own` a row for each node with its
    values and one conversation through it. Bands are `band` depths high. A node adds its values to its ancestors
    inside its band alone, so it makes `band` rows at most. The nodes that begin a band then form a tree that is `band`
    times less deep, with the sums inside their bands as values; its totals are found in the same way, and each
    completed total is added to the ancestors in the band above. So there are as many rounds as `deepest` has
    digits to the base `band`, and no node ever makes a row for each of its ancestors.
    """
    chains = paths.groupBy("conv_id", F.expr(f"depth div {band}").alias("band"))
    chains = cut(chains.agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("chain")))

    def added(values: DataFrame, level: Column, upto: Column) -> DataFrame:
        """Values summed by the first `upto` nodes of their conversation's chain in band `level`."""
        met = values.select("conv_id", level.alias("band"), upto.alias("upto"), *sums).join(chains, ["conv_id", "band"])
        met = met.select(F.explode(F.slice("chain", F.lit(1), F.col("upto"))).alias("n"), *sums).select("n.*", *sums)
        return met.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])

    level = F.expr(f"depth div {band}")
    inside = added(own, level, (F.col("depth") % band + 1).cast("int"))
    if deepest < band:
        return own.drop(*sums).join(inside, NODE)
    inside = cut(own.drop(*sums).join(inside, NODE))
    first = lambda rows: rows.where(F.col("depth") % band == 0).withColumn("depth", level)
    done = band_totals(first(paths), first(inside), sums, deepest // band, band)
    below = added(done.where("depth > 0"), F.col("depth") - 1, F.lit(band))
    below = below.select(*NODE, *[F.col(c).alias(f"__{c}") for c in sums])
    out = inside.join(below, NODE, "left")
    for c in sums:
        out = out.withColumn(c, F.col(c) + F.coalesce(f"__{c}", F.lit(0)))
    return cut(out.drop(*[f"__{c}" for c in sums]))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's ids, read piece by piece in order and never held together."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k]) for k in key] + [pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        *keys, ids = (batch.column(c).to_pylist() for c in (*NODE, "ids"))
        for *found, text in zip(*keys, ids):
            if found != key:
                if key:
                    yield row()
                key, state = found, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if key:
        yield row()


def end_digests(paths: DataFrame, size: int = LIST) -> DataFrame:
    """For each node at which conversations end: depth, f1, f2, ends_sha256 over their ids, ascending, comma-joined.

    Ids are sorted and joined in pieces, which many tasks do; one task then reads a node's pieces in order.
    """
    ends = paths.where("depth = total").withColumn("piece", F.expr(f"first div {size}"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*NODE, "piece").agg(ids.alias("ids"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return pieces.mapInArrow(_list_digests, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND, piece: int = PIECE, size: int = LIST) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's smallest member, null for the root), n_convs
    (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, each node's members
    less one times the bytes of its last text), ends_sha256 (members that end here), and place (of its last turn in the
    numbered table, for `node_texts`).

    Takes turns of `whole_conversations` or `with_shared_heads`. Nodes are grouped by 128 bits of hashes with partial sums, so
    a first turn that most conversations share gathers nowhere; parents with very many children are split when
    these look up their parent. Subtrees are summed by depth bands (`band_totals`). Conversations of any length and texts
    of any length are taken whole. An empty table gives an empty result.
    """
    paths = cut(prefixes(turns, piece))
    nodes = cut(paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes"),
        F.min("place").alias("place"),
    ))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    own = nodes.select(*NODE, "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved)
    totals = band_totals(paths.select("conv_id", *NODE), own, ["n_leaves", "saved_tokens"], deepest, band).drop("conv_id")
    parents = nodes.where("n_children > 0").select(*NODE, F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below = nodes.where("depth > 0").select(*up, (F.col("depth")).alias("d"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    parents = spread_join(below, parents, NODE, "g1", size="__n").select(F.col("d").alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2"), "parent_conv_id")
    out = nodes.join(totals, NODE).join(parents, NODE, "left").join(end_digests(paths, size), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "place",
    )


def node_texts(nodes: DataFrame, conversations: DataFrame, **names: str) -> DataFrame:
    """Nodes with the role and text of their last turn (null for the root), read from the conversations themselves.

    A node's last turn is found by its place, so a text crosses the network for each node it ends and not for each member.
    """
    conv, turn = names.get("conv_col", "conv_id"), names.get("turn_col", "turn")
    role, text = names.get("role_col", "role"), names.get("text_col", "text")
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "role", "text")]
    rows = numbered(rows, order, "place").select("place", "role", "text")
    return nodes.join(rows, "place", "left")
