"""Audit logs, policies, configurations and teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.severity import severity_rank
from depsift.plans.lineage import cut


def query_audit(entries: DataFrame, since: int | None = None, until: int | None = None, action: str | None = None, result: str | None = None) -> DataFrame:
    """Entries between two Unix times, both included, of an action and a result; null bounds and names ask for nothing.

    Entries kept by day (`sources.history`) are read for the days between the bounds alone.
    """
    at, day = F.col("timestamp_unix"), lambda t: F.date_from_unix_date(F.lit(t // 86400))
    if "day" in entries.columns and since is not None:
        entries = entries.where(F.col("day") >= day(since))
    if "day" in entries.columns and until is not None:
        entries = entries.where(F.col("day") <= day(until))
    for condition, value in ((at >= F.lit(since), since), (at <= F.lit(until), until), (F.col("action") == F.lit(action), action), (F.col("result") == F.lit(result), result)):
        if value is not None:
            entries = entries.where(condition)
    return entries


def audit_retention(entries: DataFrame, days: int, now: int) -> DataFrame:
    """Entries of the last `days` days before `now` (Unix time); 0 keeps all."""
    return query_audit(entries, since=now - days * 86400) if days else entries


def latest(rows: DataFrame, n: int, at: str, *ties: str) -> DataFrame:
    """The n newest rows, newest first; a small sorted list from each partition."""
    return rows.orderBy(F.desc(at), *map(F.desc, ties)).limit(n)


def audit_tail(entries: DataFrame, n: int, at: str, *ties: str, most: int = 1000) -> DataFrame:
    """The last n entries, `most` at most, oldest first."""
    return latest(entries, min(n, most), at, *ties).orderBy(at, *ties)


def audit_entry(checks: DataFrame, violations: DataFrame, by: str = "check") -> DataFrame:
    """One entry per policy check: result Pass, Warn or Fail, its violations, and those of Low and Medium severity as warnings.

    checks: by, passed; violations: by, severity. A check that did not pass without a violation warns.
    """
    counts = violations.groupBy(by).agg(F.count("*").alias("violations"), F.count_if(F.upper("severity").isin("LOW", "MEDIUM")).alias("warnings"))
    rows = checks.join(counts, by, "left").fillna(0, ["violations", "warnings"])
    return rows.withColumn("result", F.when(F.col("passed"), "Pass").when(F.col("violations") == 0, "Warn").otherwise("Fail"))


def team_metrics(entries: DataFrame, by: str = "team", k: int = 5) -> DataFrame:
    """Per team: findings fixed, and the k users with most Fixed or Assigned actions, with their number. entries: by, user, action."""
    fixed = F.col("action").contains("Fixed")
    users = entries.where(fixed | F.col("action").contains("Assigned")).where("user is not null").groupBy(by, "user").agg(F.count("*").alias("n"), F.count_if(fixed).alias("f"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "user"))), 1, k)
    rows = users.groupBy(by).agg(F.sum("f").alias("fixed"), top.alias("t"))
    return rows.select(by, "fixed", F.transform("t", lambda x: F.struct(x["user"].alias("user"), (-x["m"]).alias("n"))).alias("top"))


def merge_policies(policies: DataFrame, strategy: str, by: str = "project") -> DataFrame:
    """One policy for each project from those it inherits, in order of `at`.

    policies: by, at, severity (threshold), allow, deny (arrays or null), kev_gate, epss (threshold), vex_auto. strict
    takes the lower thresholds, common licences to allow (none in common: null), all licences denied, any gate, and
    automatic statements only if all have them; permissive takes the reverse; override takes the last policy whole.
    """
    if strategy == "override":
        fields = [c for c in policies.columns if c not in (by, "at")]
        return policies.groupBy(by).agg(F.max_by(F.struct(*fields), "at").alias("p")).select(by, "p.*")
    strict = strategy == "strict"
    pick = F.min if strict else F.max
    level = (F.min_by if strict else F.max_by)("severity", F.when(F.col("severity").isNotNull(), severity_rank(F.col("severity"))))
    ordered = policies.groupBy(by).agg(
        level.alias("severity"), F.array_sort(F.collect_list(F.struct("at", "allow", "deny"))).alias("l"), pick("epss").alias("epss"),
        (F.bool_or if strict else F.bool_and)("kev_gate").alias("kev_gate"), (F.bool_and if strict else F.bool_or)("vex_auto").alias("vex_auto"),
    )
    return ordered.select(by, "severity", _folded("allow", strict).alias("allow"), _folded("deny", not strict).alias("deny"), "kev_gate", "epss", "vex_auto")


def _folded(field: str, common: bool) -> Column:
    """Lists of `l` in order: what all have in common (nothing: null, and the next list counts), or all of them; null lists add nothing."""
    none = F.lit(None).cast("array<string>")

    def step(have: Column, item: Column) -> Column:
        new = item[field]
        both = F.array_intersect(have, new) if common else F.array_union(have, new)
        both = F.when(F.size(both) > 0, both) if common else both
        return F.when(have.isNull(), new).when(new.isNull(), have).otherwise(both)

    return F.aggregate("l", none, step)


def config_diff(pairs: DataFrame, by: str) -> DataFrame:
    """(by, path, change): dotted keys that only one of two JSON objects has. pairs: by, old, new (texts).

    Objects on both sides are compared key by key, down to any depth; under a key that only one side has, and of values
    that are no object on one side, nothing more is told. Null texts and texts that are no object have no keys. A step of
    the loop is a level of nesting, cut from the one before.
    """
    level = pairs.select(by, F.lit("").alias("at"), *[F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(c) for c in ("old", "new")])
    out, kind = None, "map<string,string>"
    while True:
        path = lambda k: F.concat("at", F.when(F.col("at") != "", ".").otherwise(""), k)
        one = lambda a, b, said: F.transform(F.array_except(F.map_keys(a), F.map_keys(b)), lambda k: F.struct(path(k).alias("path"), F.lit(said).alias("change")))
        told = level.select(by, F.explode(F.concat(one("old", "new", "removed"), one("new", "old", "added"))).alias("c")).select(by, "c.*")
        out = told if out is None else out.unionByName(told)
        both = level.select(by, "at", "old", "new", F.explode(F.array_intersect(F.map_keys("old"), F.map_keys("new"))).alias("k"))
        sides = both.select(by, path(F.col("k")).alias("at"), *[F.element_at(c, F.col("k")).alias(c) for c in ("old", "new")])
        sides = sides.where("ltrim(old) like '{%' and ltrim(new) like '{%'")
        level = cut(sides.select(by, "at", *[F.from_json(c, kind).alias(c) for c in ("old", "new")]).where("old is not null and new is not null"))
        if level.isEmpty():
            return out


def suppressed_cves(statements: DataFrame) -> DataFrame:
    """CVEs that a statement on all products suppresses. statements: cve, purl, status."""
    return statements.where("purl is null and status in ('not_affected', 'fixed')").select("cve").distinct()


def latest_vex(statements: DataFrame) -> DataFrame:
    """The last statement of each (cve, purl), by time and then place in its document. statements: cve, purl, status, timestamp, position."""
    return statements.groupBy("cve", "purl").agg(F.max_by("status", F.struct("timestamp", "position")).alias("status"))


def direct_dependencies(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Nodes that a project asks for itself, of one name if given. nodes: relation, name and more."""
    rows = nodes.where("relation = 'DIRECT'")
    return rows if name is None else rows.where(F.col("name") == name)


def artifacts_by_type(artifacts: DataFrame, kind: str | None = None) -> DataFrame:
    """Artifacts of a kind, or those with Maven coordinates. artifacts: kind, coordinates and more."""
    return artifacts.where(F.col("kind") == kind) if kind else artifacts.where("coordinates is not null")
