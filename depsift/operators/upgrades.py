"""Differences of dependency graphs and artifacts, and plans made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.upgrades import remediation_effort, risk_of_rank, risk_rank
from depsift.operators.match import KEYS
from depsift.plans.lineage import cut
from depsift.plans.skew import SMALL


def dependency_diff(old: DataFrame, new: DataFrame, key: str = "upgrade") -> DataFrame:
    """What changes between two resolved graphs of each upgrade, by name: reason, from_version, to_version, risk, breaking.

    Graphs: key, name, version, relation; SELF nodes are left out, of a repeated name the greatest version counts.
    Changed versions have a null risk, which the upgrade of that package itself tells.
    """
    pick = lambda g, v: g.where("relation <> 'SELF'").groupBy(key, "name").agg(F.max("version").alias(v))
    both = pick(old, "from_version").join(pick(new, "to_version"), [key, "name"], "full_outer").where("not from_version <=> to_version")
    gone, fresh = F.col("to_version").isNull(), F.col("from_version").isNull()
    return both.select(
        key, "name", F.when(fresh, "NewDependency").when(gone, "Removed").otherwise("VersionAlignment").alias("reason"),
        F.coalesce("from_version", F.lit("none")).alias("from_version"), F.coalesce("to_version", F.lit("removed")).alias("to_version"),
        F.when(fresh, "Low").when(gone, "High").alias("risk"), F.when(gone, 1).otherwise(0).alias("breaking"),
    )


def upgrade_overall_risk(direct: DataFrame, changes: DataFrame, key: str = "upgrade") -> DataFrame:
    """Worst risk of each upgrade: its own (High at least if it breaks), those of its changes (Medium at least if they
    break), and Critical if a dependency goes. direct: key, risk, breaking; changes: as dependency_diff, risks known."""
    each = F.greatest(F.coalesce(risk_rank(F.col("risk")), F.lit(1)), F.when(F.col("breaking") > 0, 2).otherwise(1), F.when(F.col("reason") == "Removed", 4).otherwise(1))
    most = changes.groupBy(key).agg(F.max(each).alias("most"))
    own = F.greatest(risk_rank(F.col("risk")), F.when(F.col("breaking") > 0, 3).otherwise(1))
    return direct.join(most, key, "left").select(key, risk_of_rank(F.greatest(own, F.coalesce("most", F.lit(1)))).alias("risk"))


def _hours(risk: Column, hours: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, hours)), risk_rank(risk).cast("int"))


def upgrade_effort(direct: DataFrame, changes: DataFrame, key: str = "upgrade") -> DataFrame:
    """Hours of each upgrade to the quarter, and counts for its notes: breaking, removed and added dependencies."""
    each = F.coalesce(_hours(F.col("risk"), (0.1, 0.5, 2.0, 4.0)), F.lit(0.1)) + F.col("breaking") * 0.5
    sums = changes.groupBy(key).agg(
        F.sum(each).alias("more"), F.sum("breaking").alias("broken"), F.count_if(F.col("reason") == "Removed").alias("removed"),
        F.count_if(F.col("reason") == "NewDependency").alias("added"),
    )
    hours = 0.5 + _hours(F.col("risk"), (0.25, 1.0, 4.0, 8.0)) + F.col("breaking") * 0.5 + F.coalesce("more", F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rounded = F.round(F.round(hours, 6) * 4) / 4  # sums of tenths are rounded before they are compared with halves
    return direct.join(sums, key, "left").select(key, rounded.alias("hours"), count("broken"), count("removed"), count("added"))


def api_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(class, kind, signature) of what two versions of an artifact differ in.

    Versions: class, methods, fields (arrays of signatures, null ones have none). Members are told of classes that both have only.
    """
    listed = lambda c, n: F.coalesce(c, F.array().cast("array<string>")).alias(n)
    a = old.select("class", listed("methods", "m0"), listed("fields", "f0"), F.lit(True).alias("in0"))
    b = new.select("class", listed("methods", "m1"), listed("fields", "f1"), F.lit(True).alias("in1"))
    item = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("signature")))
    members = F.concat(
        item("RemovedMethod", F.array_except("m0", "m1")), item("AddedMethod", F.array_except("m1", "m0")),
        item("RemovedField", F.array_except("f0", "f1")), item("AddedField", F.array_except("f1", "f0")),
    )
    whole = lambda kind: item(kind, F.array("class"))
    found = F.when(F.col("in1").isNull(), whole("RemovedClass")).when(F.col("in0").isNull(), whole("AddedClass")).otherwise(members)
    return a.join(b, "class", "full_outer").select("class", F.explode(found).alias("c")).select("class", "c.*")


def shaded_class_match(classes: DataFrame, known: DataFrame) -> DataFrame:
    """Classes whose fingerprint is that of a known artifact's class: original, artifact, confidence 1."""
    originals = known.select("fingerprint", F.col("class").alias("original"), "artifact").distinct()
    return classes.where("fingerprint is not null").join(originals, "fingerprint").withColumn("confidence", F.lit(1.0))


def relocation_match(classes: DataFrame, relocations: DataFrame) -> DataFrame:
    """Classes under a shaded prefix with the name they had: original, confidence 0.8.

    relocations: pattern, shaded. A class meets a prefix by equality with one of its own starts, of the lengths that prefixes have, so relocations may be
    many; all prefixes that fit are returned. The starts are never broadcast: relocations are if they are few, else both are sorted.
    """
    known = cut(relocations.select("pattern", "shaded"))
    lengths = known.agg(F.collect_set(F.greatest(F.length("shaded"), F.lit(1))).alias("lengths"))
    fit = F.filter("lengths", lambda n: n <= F.greatest(F.length("class"), F.lit(1)))
    starts = classes.crossJoin(F.broadcast(lengths)).withColumn("n", F.explode(fit)).withColumn("shaded", F.expr("substring(class, 1, n)")).drop("lengths", "n")
    known = F.broadcast(known) if known.count() <= SMALL else known.hint("merge")
    original = F.concat("pattern", F.expr("substring(class, length(shaded) + 1)"))
    return starts.join(known, "shaded").select(*classes.columns, "shaded", original.alias("original"), F.lit(0.8).alias("confidence"))


def relocates(name: Column, pattern: Column, includes: Column, excludes: Column) -> Column:
    """Whether a relocation takes a class: under its pattern, under one of includes if there are any, under no exclude."""
    under = lambda prefixes: F.exists(prefixes, lambda p: F.startswith(name, p))
    return F.startswith(name, pattern) & F.coalesce(under(includes), F.lit(True)) & ~F.coalesce(under(excludes), F.lit(False))


def identify_artifacts(jars: DataFrame, pom: DataFrame, manifest: DataFrame, checksums: DataFrame) -> DataFrame:
    """Coordinates of each jar by the first source that knows it: its pom, its manifest, its checksum.

    jars: jar, sha; pom and manifest: jar, coordinates; checksums: sha, coordinates; one row a key in each.
    """
    named = lambda df, key, c: df.groupBy(key).agg(F.min("coordinates").alias(c))
    rows = jars.join(named(pom, "jar", "p"), "jar", "left").join(named(manifest, "jar", "m"), "jar", "left").join(named(checksums, "sha", "c"), "sha", "left")
    source = F.when(F.col("p").isNotNull(), "pom").when(F.col("m").isNotNull(), "manifest").when(F.col("c").isNotNull(), "checksum")
    return rows.select(*jars.columns, F.coalesce("p", "m", "c").alias("coordinates"), source.alias("source"))


def first_fixed_version(affected: DataFrame) -> DataFrame:
    """First fix of each advisory's package: advisory, name, fixed (null: none). affected: advisory, name, ranges."""
    fixes = F.filter(F.flatten(F.transform("ranges", lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda x: x.isNotNull())
    return affected.select("advisory", "name", F.get(fixes, F.lit(0)).alias("fixed"))


def names_package(package: Column, asked: Column) -> Column:
    """Whether an advisory's package is the one asked for, by its whole name or its end after a slash."""
    return (package == asked) | F.endswith(package, F.concat(F.lit("/"), asked))


def remediation_summary(affected: DataFrame, by: str) -> DataFrame:
    """Per group: total advisories, fixable and unfixable affected packages, and the effort they ask for."""
    rows = affected.groupBy(by).agg(F.countDistinct("advisory").alias("total"), F.count("fixed").alias("fixable"), F.count_if(F.col("fixed").isNull()).alias("unfixable"))
    return rows.withColumn("effort", remediation_effort(F.col("fixable")))


def urgency_batches(flaws: DataFrame, edges: DataFrame) -> DataFrame:
    """Batches of fixes: urgency, n, minutes, conflicts.

    flaws: package, urgency; edges: src depends on dst. Immediate ones count only if nothing depends on them; conflicts
    are packages of the High batch that share a dependency with another one of it, counted by dependency, so a popular
    dependency makes no pairs.
    """
    used = edges.select(F.col("dst").alias("package")).distinct()
    now = flaws.where("urgency = 'IMMEDIATE'").join(used, "package", "left_anti").select("package", F.lit("IMMEDIATE").alias("batch"), F.lit(30).alias("minutes"))
    high = flaws.where("urgency = 'HIGH'").select("package", F.lit("HIGH").alias("batch"), F.lit(60).alias("minutes"))
    rest = flaws.where("urgency in ('MEDIUM', 'LOW')").select("package", F.lit("MEDIUM").alias("batch"), F.lit(120).alias("minutes"))
    deps = high.select("package").distinct().join(edges.select(F.col("src").alias("package"), "dst").distinct(), "package")
    shared = deps.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    conflicts = deps.join(shared, "dst").agg(F.countDistinct("package").alias("c")).withColumn("batch", F.lit("HIGH"))
    rows = now.unionByName(high).unionByName(rest).groupBy("batch", "minutes").agg(F.count("*").alias("n"))
    return rows.join(conflicts, "batch", "left").select(F.col("batch").alias("urgency"), "n", "minutes", F.coalesce("c", F.lit(0)).cast("long").alias("conflicts"))


def os_upgrade_plan(matches: DataFrame, distro: str) -> DataFrame:
    """Per installed package: the CVEs an upgrade fixes and the highest version needed, in the distribution's order.

    matches: release, package, installed, cve, fixed, as os_match gives them; rows without a fix ask for none.
    """
    by = ["release", "package", "installed"]
    # fixes are parsed once for each package, not for each match
    fixes = matches.where("fixed is not null").groupBy(*by, "fixed").agg(F.collect_set("cve").alias("cves")).withColumn("order", KEYS[distro](F.col("fixed")))
    return fixes.groupBy(*by).agg(F.max_by("fixed", "order").alias("recommended"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cves")))).alias("cves"))


def release_breaking_changes(releases: DataFrame, old: str, new: str, by: str = "package") -> DataFrame:
    """(by, version, description) of breaking changes told in releases after `old` up to `new`.

    releases: by, position (0 is the newest), version, body; `old` and `new` name columns with the versions. Under a
    heading "breaking change(s)" or "breaking", bullets and numbered items count up to the next heading; elsewhere a
    line `**breaking**: text` does. A release is one row, so its lines are ordered inside it. Releases count all, when
    `old` is none of them, and from the newest, when `new` is none.
    """
    at = releases.groupBy(by).agg(F.min(F.when(F.col("version") == F.col(old), F.col("position"))).alias("to"), F.min(F.when(F.col("version") == F.col(new), F.col("position"))).alias("from"))
    rows = releases.join(at, by).where((F.col("position") < F.coalesce("to", F.col("position") + 1)) & (F.col("position") >= F.coalesce("from", F.lit(0))))
    head = r"(?i)^#+\\s*breaking(\\s+changes?:?)?\\s*$"
    # state: whether the lines are under a breaking heading, and what was found
    fold = f"""aggregate(transform(split(body, '\\n'), x -> trim(x)), named_struct('inside', false, 'found', cast(array() as array<string>)), (s, x) -> named_struct(
        'inside', if(x like '#%', x rlike '{head}', s.inside),
        'found', case when x like '#%' then s.found
            when s.inside and x rlike '^[-*0-9]' then array_append(s.found, trim(regexp_replace(x, '^-*[*]*[0-9]*[.]*', '')))
            when not s.inside and x rlike '(?i)[*][*]breaking[*][*]:?\\\\s*.' then array_append(s.found, trim(regexp_extract(x, '(?i)[*][*]breaking[*][*]:?\\\\s*(.+)', 1)))
            else s.found end)).found"""
    return rows.select(by, "version", F.explode(F.expr(fold)).alias("description")).where("description <> ''")
