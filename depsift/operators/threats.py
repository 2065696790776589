"""Threat feeds, look-alike names, confusion of registries, and changes of maintainers and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.threats import THRESHOLDS, malicious_text
from depsift.plans.skew import paired_join

# Neighbours on a keyboard and characters that look alike.
KEYBOARD = {
    "q": "wa12", "w": "qeas23", "e": "wrsd34", "r": "etdf45", "t": "ryfg56", "y": "tugh67", "u": "yihj78", "i": "uojk89", "o": "ipkl90", "p": "ol0",
    "a": "qwsz", "s": "weadzx", "d": "ersfxc", "f": "rtdgcv", "g": "tyfhvb", "h": "yugjbn", "j": "uihknm", "k": "iojlm", "l": "opk",
    "z": "asx", "x": "sdzc", "c": "dfxv", "v": "fgcb", "b": "ghvn", "n": "hjbm", "m": "jkn",
}
LOOK_ALIKES = {
    "l": "1i|", "1": "li|", "i": "l1|", "o": "0", "0": "o", "s": "5$", "5": "s", "e": "3", "3": "e", "a": "4@", "4": "a", "g": "9q", "9": "gq",
    "b": "68", "n": "m", "m": "n",
}
PUBLIC = ("MavenCentral", "NpmRegistry", "PyPI")


def feed_lookup(packages: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed entries (pattern, ...) of each package: equal names, and patterns with exactly one *.

    Distinct names meet patterns by their fixed start (the empty one too): each name offers its own starts, so a
    pattern is compared only with names that begin as it does. Entries that a package meets twice stay single. Popular names
    and starts make many pairs, which are counted and dealt over tasks.
    """
    stars = F.length("pattern") - F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    equal = paired_join(packages, feed.withColumn("name", F.col("pattern")), ["name"])
    wild = feed.where(stars == 1).withColumn("start", F.substring_index("pattern", "*", 1)).withColumn("end", F.substring_index("pattern", "*", -1))
    names = packages.select("name").distinct()
    starts = names.select("name", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substr(F.col("name"), F.lit(1), n))).alias("start"))
    sizes = wild.select("start").distinct()
    met = paired_join(starts.join(sizes, "start", "left_semi"), wild, ["start"]).where("endswith(name, end) and name <> pattern").drop("start", "end")
    return equal.unionByName(paired_join(packages, met, ["name"])).select(*packages.columns, *feed.columns)


def feed_stats(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """(measure, n): feeds, enabled feeds, threats, and threats of each severity."""
    first = feeds.agg(F.count("*").alias("feeds"), F.count_if("enabled").alias("enabled")).unpivot([], ["feeds", "enabled"], "measure", "n")
    every = entries.agg(F.count("*").alias("n")).select(F.lit("threats").alias("measure"), "n")
    return first.unionByName(every).unionByName(entries.groupBy(F.col("severity").alias("measure")).agg(F.count("*").alias("n")))


def dependency_confusion(packages: DataFrame, internal: DataFrame) -> DataFrame:
    """Internal names taken from where they don't belong: level Critical or High.

    packages: name, registry; internal: name, expected (null: a name without a configured registry). With one, any
    other registry is critical; without, a public one is high.
    """
    known = internal.groupBy("name").agg(F.min("expected").alias("expected"))
    level = F.when(F.col("expected").isNotNull(), F.when(F.col("registry") != F.col("expected"), "Critical")).when(F.col("registry").isin(*PUBLIC), "High")
    return packages.join(known, "name").withColumn("level", level).where("level is not null")


def _letters(a: Column, b: Column, pairs: dict[str, str]) -> Column:
    """For names of one length, an array over places: null where equal, else whether `pairs` has the two letters."""
    listed = F.array(*[F.lit(k + x) for k, xs in pairs.items() for x in xs])
    letters = lambda c: F.split(F.lower(c), "")
    return F.zip_with(letters(a), letters(b), lambda x, y: F.when(x != y, F.array_contains(listed, F.concat(x, y))))


def typosquat_score(name: Column, known: Column) -> Column:
    """Points for a name that may pass for a known one (fixed values as published)."""
    distance = F.levenshtein(name, known)
    similarity = 1 - distance / F.greatest(F.length(name), F.length(known))
    same = F.length(name) == F.length(known)
    differing = lambda pairs: F.filter(_letters(known, name, pairs), lambda x: x.isNotNull())
    near, alike = differing(KEYBOARD), differing(LOOK_ALIKES)
    odd = sum((F.when(c, 10.0).otherwise(0.0) for c in (name.rlike("[01]"), name.contains("--"), name.contains("_") & name.contains("-"))), F.lit(0.0))
    dashes = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    return (
        F.when(similarity > 0.7, similarity * 50.0).otherwise(0.0) + F.when(same & (F.size(near) == 1) & F.exists(near, lambda x: x), 30.0).otherwise(0.0)
        + F.when(same & F.exists(alike, lambda x: x), 25.0).otherwise(0.0) + odd
        + F.when(F.startswith(name, known) | F.endswith(name, known), 15.0).otherwise(0.0) + F.when((dashes(name) == dashes(known)) & (name != known), 20.0).otherwise(0.0)
    )


def _candidates(names: DataFrame, goals: DataFrame) -> DataFrame:
    """(name, known) of every pair that can score over 40; names never meet all with all.

    A similarity over 0.7 leaves, of two names of lengths n and k, a string of k // (edits + 1) letters in place. What
    scores without it has look-alike letters at one place of names of one length, or the known name as a start or end,
    or differs by dashes only.
    """
    k, long_ = "k", "greatest(k, length(name))"
    ahead = names.select("name", F.explode(F.expr("sequence(greatest(1, length(name) * 7 div 10), length(name) * 10 div 7 + 1)")).alias(k))
    ahead = ahead.withColumn("q", F.expr(f"cast(greatest(1, k div ((3 * {long_} - 1) div 10 + 1)) as int)")).where("q <= length(name)")
    pieces = "array_distinct(transform(sequence(0, length({0}) - q), i -> substring({0}, i + 1, q)))"
    ahead = ahead.select("name", k, F.explode(F.expr(pieces.format("name"))).alias("piece"))
    sizes = "sequence(1, greatest(1, cast(length(known) div ((3 * length(known) - 1) div 10 + 1) as int)))"
    behind = goals.select("known", F.length("known").alias(k), F.explode(F.expr(sizes)).alias("q"))
    behind = behind.select("known", k, F.explode(F.expr(pieces.format("known"))).alias("piece"))
    alike = ahead.join(behind, [k, "piece"]).select("name", "known")

    odd = "int(name rlike '[01]') + int(name like '%--%') + int(name like '%\\_%' and name like '%-%')"
    letters = lambda c: F.explode(F.expr(f"transform(sequence(1, length({c})), i -> named_struct('i', i, 'c', lower(substring({c}, i, 1))))")).alias("x")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("c"), F.lit(a).alias("g")) for a, xs in LOOK_ALIKES.items() for x in xs])).alias("p")
    few = names.where(f"{odd} >= 2 or length(name) <= 3").select("name", F.length("name").alias(k), letters("name")).select("name", k, "x.i", "x.c")
    pairs = names.sparkSession.range(1).select(pairs).select("p.c", "p.g")
    swapped = few.join(F.broadcast(pairs), "c").select("name", k, "i", "g")
    places = goals.select("known", F.length("known").alias(k), letters("known")).select("known", k, "x.i", F.col("x.c").alias("g"))
    swapped = swapped.join(places, [k, "i", "g"]).select("name", "known")

    ends = "array_distinct(flatten(transform(sequence(1, length(name)), i -> array(substring(name, 1, i), substring(name, i)))))"
    inside = names.where(f"{odd} = 3").select("name", F.explode(F.expr(ends)).alias("known")).join(goals, "known").select("name", "known")
    dashes = lambda c: F.replace(c, F.lit("-"), F.lit("_")).alias("d")
    dashed = names.select("name", dashes("name")).join(goals.select("known", dashes("known")), "d").select("name", "known")
    return alike.union(swapped).union(inside).union(dashed).where("name <> known").distinct()


def typosquat_full(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Each distinct name with the known name it scores most against, over 40 points: name, known, score, level.

    Ties go to the smaller known name. Null and empty names are left out.
    """
    names = packages.where("name <> ''").select("name").distinct()
    goals = known.where("name <> ''").select(F.col("name").alias("known")).distinct()
    scored = _candidates(names, goals).withColumn("score", typosquat_score(F.col("name"), F.col("known"))).where("score > 40")
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "known")).alias("b")).select("name", "b.known", (-F.col("b.s")).alias("score"))
    return best.withColumn("level", F.when(F.col("score") > 80, "Critical").when(F.col("score") > 60, "High").otherwise("Medium"))


def malicious_db(advisories: DataFrame) -> DataFrame:
    """Malicious packages told of by advisories: name, ecosystem, versions, description, id.

    advisories: id, summary, details, affected (array of ecosystem, name, versions), of which the first counts.
    """
    first = F.get("affected", F.lit(0))
    rows = advisories.where(malicious_text(F.col("summary"), F.col("details"), F.col("id"))).where("size(affected) > 0")
    text = F.coalesce("summary", "details", F.concat(F.lit("Malicious package: "), "id"))
    return rows.select(first["name"].alias("name"), first["ecosystem"].alias("ecosystem"), first["versions"].alias("versions"), text.alias("description"), "id")


def malicious_stats(db: DataFrame) -> DataFrame:
    """Malicious packages of each ecosystem: ecosystem, packages."""
    return db.groupBy("ecosystem").agg(F.count("*").alias("packages"))


def threat_delta(before: DataFrame, after: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """(package, description, change): new and resolved threats of the watched packages, repeats once."""
    keys = ["package", "description"]
    a, b = (x.select(*keys).distinct() for x in (before, after))
    if watched is not None:
        a, b = (x.join(watched.select("package").distinct(), "package", "left_semi") for x in (a, b))
    fresh, gone = b.join(a, keys, "left_anti").withColumn("change", F.lit("new")), a.join(b, keys, "left_anti").withColumn("change", F.lit("resolved"))
    return fresh.unionByName(gone)


def _last_two(events: DataFrame, fields: list[str], at: str) -> DataFrame:
    """package, with the newest event `a`, the one before it `b` and the number of events; no package is sorted whole."""
    item = F.struct(at, *fields)
    newest = events.groupBy("package").agg(F.max(item).alias("a"), F.count("*").alias("n"))
    rest = events.join(newest.select("package", "a"), "package").where(item < F.col("a")).groupBy("package").agg(F.max(item).alias("b"))
    return newest.join(rest, "package", "left")


def maintainer_change(maintainers: DataFrame) -> DataFrame:
    """Packages whose newest maintainer looks new: signals and risk (two High, one Medium).

    maintainers: package, at, email, account_age_days. Signals: another mail domain than the one before, and an
    account under 30 days old where there was another maintainer. Of events at one time the greater mail is newer.
    """
    rows = _last_two(maintainers, ["email", "account_age_days"], "at")
    domain = lambda c: F.when(F.col(c).contains("@"), F.split(F.col(c), "@")[1])
    signals = F.array_compact(F.array(
        F.when(domain("a.email") != domain("b.email"), "email domain"), F.when((F.col("a.account_age_days") < 30) & (F.col("n") > 1), "new account"),
    ))
    return rows.select("package", signals.alias("signals")).where("size(signals) > 0").withColumn("risk", F.when(F.size("signals") >= 2, "High").otherwise("Medium"))


def version_jump(releases: DataFrame) -> DataFrame:
    """Packages whose newest release's major is over one more than that before: package, old, new.

    releases: package, at, version; a leading v is dropped, versions without a number jump nowhere.
    """
    rows = _last_two(releases, ["version"], "at")
    major = lambda c: F.regexp_extract(F.col(c), r"^v*(\d+)(\.|$)", 1).try_cast("long")
    return rows.where(major("a.version") > major("b.version") + 1).select("package", F.col("b.version").alias("old"), F.col("a.version").alias("new"))


def release_burst(releases: DataFrame, as_of: Column, least: int = 3) -> DataFrame:
    """Packages with `least` releases in the day before `as_of`: package, n."""
    recent = releases.where((F.col("at") <= as_of) & (F.col("at") > as_of - F.expr("interval 1 day")))
    return recent.groupBy("package").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def train_anomaly_thresholds(features: DataFrame) -> DataFrame:
    """One row of bounds: mean and two deviations of transitive, vulns and releases; the defaults for an empty table."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    high = lambda c: F.avg(c) + 2.0 * sd(c)
    learned = {"max_transitive": high("transitive"), "max_vulns": high("vulns"), "min_releases": F.avg("releases") - 2.0 * sd("releases"), "max_releases": high("releases")}
    return features.agg(*[F.coalesce(learned.get(k, F.lit(v)), F.lit(v)).alias(k) for k, v in THRESHOLDS.items()])
