"""Licence compatibility, look-alike package names and upgrade feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Project licence, risk, licences of dependencies at that risk; equal licences are safe anyway.
LICENSE_RISKS = (
    ("MIT", "Safe", ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "Unlicense")),
    ("MIT", "Critical", ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("Apache-2.0", "Safe", ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD")),
    ("Apache-2.0", "High", ("GPL-2.0-only", "GPL-2.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("Apache-2.0", "Medium", ("GPL-3.0-only", "GPL-3.0-or-later")),
    ("BSD-2-Clause", "Safe", ("MIT", "Apache-2.0", "BSD-3-Clause", "ISC")),
    ("BSD-2-Clause", "Critical", ("GPL-3.0-only", "AGPL-3.0-only")),
    ("BSD-3-Clause", "Safe", ("MIT", "Apache-2.0", "BSD-2-Clause", "ISC")),
    ("BSD-3-Clause", "Critical", ("GPL-3.0-only", "AGPL-3.0-only")),
)
COPYLEFT_PROJECTS = ("GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
UNSTATED = ("NOASSERTION", "Unknown", "NONE")


def license_compatibility(project: Column, dependency: Column) -> Column:
    """Risk of a dependency's licence in a project, Safe to Critical; a null on either side is `Unknown`."""
    project, dependency = (F.coalesce(c, F.lit("Unknown")) for c in (project, dependency))
    out = F.when((project == dependency) | project.isin(*COPYLEFT_PROJECTS), "Safe")
    for licence, risk, others in LICENSE_RISKS:
        out = out.when((project == licence) & dependency.isin(*others), risk)
    return out.when(dependency.isin(*UNSTATED), "High").otherwise("Medium")


def _thirds(name: Column) -> Column:
    """(number, start, end) of the three parts of a name, as long as each other but for a character."""
    n = F.length(name)
    cut = lambda i: F.floor(n * i / 3).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("i"), cut(i).alias("a"), cut(i + 1).alias("b")) for i in range(3)])


def typosquats(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Each distinct package name with the known name it looks like most: name, known, distance, similarity, level.

    Alike means at most two edits and a similarity (1 - edits / longer length) over 0.8 and under 1; ties go
    to the smaller known name. Two edits leave one third of the known name whole, moved by two places at
    most, so names meet by such a part and never all with all. Null names are left out.
    """
    names = packages.where("name is not null").select("name").distinct()
    goals = known.where("name is not null").select(F.col("name").alias("known")).distinct()
    part = F.explode(_thirds(F.col("known"))).alias("p")
    goals = goals.select("known", F.length("known").alias("size"), part)
    goals = goals.select("known", "size", F.col("p.i").alias("i"), F.expr("substring(known, p.a + 1, p.b - p.a)").alias("piece"))
    sizes = names.select("name", F.explode(F.expr("sequence(greatest(length(name) - 2, 1), length(name) + 2)")).alias("size"))
    spots = sizes.select("name", "size", F.explode(F.expr(
        "transform(sequence(0, 2), i -> named_struct('i', i, 'a', cast(floor(size * i / 3) as int), 'b', cast(floor(size * (i + 1) / 3) as int)))"
    )).alias("p"))
    spots = spots.select("name", "size", F.col("p.i").alias("i"), F.explode(F.expr(
        "array_distinct(transform(sequence(greatest(p.a - 2, 0), p.a + 2), x -> substring(name, x + 1, p.b - p.a)))"
    )).alias("piece"))
    met = spots.join(goals, ["size", "i", "piece"]).where("name <> known").select("name", "known").distinct()
    distance = F.levenshtein("name", "known")
    met = met.withColumn("distance", distance).where("distance <= 2")
    met = met.withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("name"), F.length("known"))).where("similarity > 0.8")
    best = met.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "known", "distance", "similarity")).alias("b"))
    s, d = F.col("similarity"), F.col("distance")
    level = F.when((s > 0.95) & (d == 1), "Critical").when(s > 0.9, "High").when(s > 0.85, "Medium").otherwise("Low")
    return best.select("name", "b.known", "b.distance", "b.similarity").withColumn("level", level)


def upgrade_success(feedback: DataFrame) -> DataFrame:
    """Attempts, successes, failures, rate and distinct issues (sorted) of each (package, from_version, to_version).

    feedback: package, from_version, to_version, success, issue (null: none); a null success counts as a failure.
    """
    won = F.count_if(F.coalesce("success", F.lit(False)))
    out = feedback.groupBy("package", "from_version", "to_version").agg(
        F.count("*").alias("attempts"), won.alias("successes"), F.sort_array(F.collect_set("issue")).alias("issues")
    )
    return out.withColumn("failures", F.col("attempts") - F.col("successes")).withColumn("rate", F.col("successes") / F.col("attempts"))


def upgrade_statistics(success: DataFrame) -> DataFrame:
    """One row over all of `upgrade_success`: packages, upgrades, attempts, successes, rate (0 without an attempt)."""
    out = success.agg(F.countDistinct("package").alias("packages"), F.count("*").alias("upgrades"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempts", "successes")])
    return out.withColumn("rate", F.when(F.col("attempts") > 0, F.col("successes") / F.col("attempts")).otherwise(0.0))


def upgrade_success_lookup(upgrades: DataFrame, success: DataFrame) -> DataFrame:
    """Upgrades with the success rate known for them, else null."""
    keys = ["package", "from_version", "to_version"]
    return upgrades.join(success.select(*keys, "rate"), keys, "left")
