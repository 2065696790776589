"""Filtering, merging, summarising and planning over findings."""

from __future__ import annotations

import re
from re import _parser as sre_parser

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from depsift.functions.names import PIECE, pieces
from depsift.functions.severity import severity_rank
from depsift.plans.lineage import cut

FILTERS = {
    "p0": "priority = 'P0'", "p1": "priority = 'P1'", "p2": "priority = 'P2'", "fixable": "fixed is not null",
    "quick-wins": "fixed is not null and not coalesce(breaking, false)", "critical": "severity = 'CRITICAL'", "high": "severity = 'HIGH'",
    "medium": "severity = 'MEDIUM'", "low": "severity = 'LOW'", "kev": "is_kev",
}


def filter_findings(findings: DataFrame, name: str) -> DataFrame:
    """A named filter; an unknown name keeps all rows."""
    return findings.where(FILTERS[name]) if name in FILTERS else findings


def filter_min_severity(findings: DataFrame, least: str | None) -> DataFrame:
    """Rows at or above a severity; rows without one pass, and so do all without a bound. Unknown text ranks as LOW."""
    if least is None:
        return findings
    rank = lambda c: F.greatest(severity_rank(c), F.lit(1))
    return findings.where(F.col("severity").isNull() | (rank(F.col("severity")) >= rank(F.lit(least))))


def search_dependencies(packages: DataFrame, text: str, kind: str = "substring", severity: str | None = None, any_case: bool = False) -> DataFrame:
    """Packages by name: substring (any case), regex, or glob with * and ?; with a severity, those of a finding of it.

    packages: name, and for a severity `severities`, an array of those of the package's findings. No text asks for nothing;
    an expression that is none matches nothing.
    """
    if severity is not None:
        packages = packages.where(F.array_contains("severities", severity))
    if not text:
        return packages
    name = F.col("name")
    if kind == "substring":
        return packages.where(F.lower(name).contains(text.lower()))
    if kind == "glob":
        text = "^" + re.escape(text).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    return packages.where(name.rlike(("(?i)" if any_case else "") + text) if is_pattern(packages.sparkSession, text) else F.lit(False))


def is_pattern(spark: SparkSession, text: str) -> bool:
    """Whether the JVM reads the text as a regular expression."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return False
    return True


def should_notify(alerts: DataFrame, least: str, enabled: bool = True) -> DataFrame:
    return alerts.where(F.lit(enabled) & (severity_rank(F.col("severity")) >= severity_rank(F.lit(least))))


#: Parts of the names that meet rules without a piece.
SALTS = 64


def required_text(pattern: str | None) -> str:
    """A text that stands in every match of a pattern: the longest run of plain letters that no choice or option leaves out; may be empty."""
    try:
        tree = sre_parser.parse(pattern or "")
    except (re.error, OverflowError, RecursionError):
        return ""
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    best, run = "", ""
    for op, value in [*tree, (None, None)]:
        if op is sre_parser.LITERAL:
            run += chr(value)
            continue
        if op is not sre_parser.AT:
            best, run = max(best, run, key=len), ""
    return best


def route_findings(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule, by `at`, whose pattern matches the package; a pattern that is no expression fails the job.

    Distinct package names meet rules by an inverted index: a rule stands under one piece, of PIECE letters or fewer, of the text
    that its pattern requires (`required_text`), the one that fewest names have, and a name looks its own pieces up. Patterns
    are tried on those names alone. Patterns that require no text are tried on every name, in SALTS parts. Rules may be any number.
    """
    names = cut(findings.select("package").where("package is not null").distinct())
    literal = F.udf(required_text, "string")
    rules = cut(rules.withColumn("_text", literal("pattern")).withColumn("_q", F.least(F.length("_text"), F.lit(PIECE))))
    asked = rules.where("_q > 0").select("_q", F.explode(pieces(F.col("_text"), F.col("_q"))).alias("_piece")).distinct()
    held = names.withColumn("_q", F.explode(F.expr(f"sequence(1, least({PIECE}, length(package)))"))).where("package <> ''")
    held = cut(held.select("package", "_q", F.explode(pieces(F.col("package"), F.col("_q"))).alias("_piece")).join(asked, ["_q", "_piece"], "left_semi"))
    counts = held.groupBy("_q", "_piece").agg(F.count("*").alias("_n"))
    # rules with a piece that no name has match nothing; the others stand under their rarest piece
    each = rules.where("_q > 0").select("at", "pattern", "_q", F.explode(pieces(F.col("_text"), F.col("_q"))).alias("_piece")).distinct()
    each = each.join(counts, ["_q", "_piece"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    under = each.groupBy("at", "pattern").agg(F.min(F.struct("_n", "_q", "_piece")).alias("_k")).where("_k._n > 0").select("at", "pattern", "_k._q", "_k._piece")
    tried = held.join(under, ["_q", "_piece"]).select("package", "at", "pattern")
    salted = rules.where("_q = 0").select("at", "pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    tried = tried.unionByName(names.withColumn("_s", F.pmod(F.xxhash64("package"), F.lit(SALTS)).cast("int")).join(salted, "_s").drop("_s"))
    first = tried.where("package rlike pattern").groupBy("package").agg(F.min(F.struct("at", "pattern")).alias("_r")).select("package", "_r.at", "_r.pattern")
    told = [c for c in rules.columns if c not in ("at", "pattern", "_text", "_q")]
    said = rules.groupBy("at", "pattern").agg(F.min(F.struct(*told)).alias("r"))
    return findings.join(first.join(said, ["at", "pattern"]).select("package", "r"), "package", "left").select(*findings.columns, "r.*")


def policy_violation(severity: Column, is_kev: Column, epss: Column, threshold: str, kev_gate: bool, epss_threshold: float | None, reachable: Column | None = None) -> Column:
    """The first failing rule of a finding: severity, then KEV, then EPSS; null if none.

    With `reachable` given, unreachable findings pass.
    """
    out = F.when(severity_rank(severity) >= severity_rank(F.lit(threshold)), "severity")
    if kev_gate:
        out = out.when(F.coalesce(is_kev, F.lit(False)), "kev")
    if epss_threshold is not None:
        out = out.when(epss >= epss_threshold, "epss")
    return out if reachable is None else F.when(reachable, out)


def license_violation(license: Column, deny: list[str], allow: list[str] | None) -> Column:
    out = F.when(license.isin(deny), "denied")
    return out if allow is None else out.when(~license.isin(allow), "not allowed")


def user_predicates(findings: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A row per finding and rule that holds; rules are SQL conditions by name."""
    named = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in sorted(rules.items())]))
    return findings.withColumn("rule", F.explode(named))


def dedupe_findings(findings: DataFrame, by: tuple[str, ...] = ("image", "cve"), severity: Column | None = None, fixed: Column | None = None) -> DataFrame:
    """One row per image and CVE over all tools: worst severity and score; first fix, layer and EPSS by tool order; tools, KEV, and
    the references of all tools where there is such a column.

    `severity` and `fixed` are aggregates to take instead. Of several EPSS that one tool tells of one layer, the highest counts.
    """
    at = F.struct("tool_order", "layer", "package", "installed")
    first = lambda c, at: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    worst = F.max_by("severity", severity_rank(F.col("severity"))) if severity is None else severity
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("references")))).alias("references")] if "references" in findings.columns else []
    return findings.groupBy(*by).agg(
        worst.alias("severity"), F.max("cvss").alias("cvss"), first("fixed", at) if fixed is None else fixed.alias("fixed"), F.min_by("layer", at).alias("layer"),
        F.array_sort(F.collect_set("tool")).alias("tools"), first("epss", F.struct("tool_order", "layer", -F.col("epss"))), F.bool_or("is_kev").alias("is_kev"), *more,
    )


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")]


def findings_summary(findings: DataFrame, by: str = "image") -> DataFrame:
    fixable, kev = F.count_if(F.col("fixed").isNotNull()), F.count_if("is_kev")
    return findings.groupBy(by).agg(F.count("*").alias("total"), *severity_counts(), fixable.alias("fixable"), kev.alias("kev"))


def security_score(
    c: Column, h: Column, m: Column, low: Column, method: str = "report", deps: Column | None = None, reachable: Column | None = None, kev: Column | None = None,
) -> Column:
    """Score 0 to 100 of severity counts by one of the published formulas: report, dashboard, status, container or graded.

    Counts are held to a bound before they are weighed in `container` and `graded`.
    """
    held = lambda n, most: F.least(n, F.lit(most))
    if method == "dashboard":
        worst = 20.0 * (10 * c + 5 * h + 2 * m + low) / F.greatest(deps, F.lit(1))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - worst))
    if method == "status":
        score = 100 - 15 * c - 8 * h - 3 * m - low - 5 * F.coalesce(reachable, F.lit(0))
    elif method == "container":
        score = 100 - 10 * held(c, 10) - 2 * held(h, 20) - held(m, 50) - 5 * held(F.coalesce(kev, F.lit(0)), 5)
    elif method == "graded":
        score = 100 - held(10 * c, 100) - held(2 * h, 40) - held(m, 50)
    else:
        score = 100 - 20 * c - 10 * h - 5 * m - 2 * low
    return F.greatest(F.lit(0), score)


def letter_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def letter_rating(score: Column) -> Column:
    """Rating of a container's score."""
    return F.when(score >= 90, "A+").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def compliance_status(critical: Column, high: Column, kev: Column, total: Column, score: Column) -> Column:
    """(pci, hipaa, soc2, overall): the issues of each framework, none meaning a pass, and PASS, WARNING or FAIL by the score.

    SOC 2 doesn't ask for high findings; a full pass needs a score of 90 and no finding.
    """
    told = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    c, h, k = told(critical, " critical vulnerabilities present"), told(high, " high severity vulnerabilities"), told(kev, " known exploited vulnerabilities (CISA KEV)")
    overall = F.when((score >= 90) & (total == 0), "PASS").when(score >= 70, "WARNING").otherwise("FAIL")
    listed = lambda *xs: F.array_compact(F.array(*xs))
    return F.struct(listed(c, h, k).alias("pci"), listed(c, h, k).alias("hipaa"), listed(c, k).alias("soc2"), overall.alias("overall"))


def scan_risk_level(c: Column, h: Column, m: Column) -> Column:
    return F.when(c > 0, "CRITICAL").when(h > 0, "HIGH").when(m > 5, "MEDIUM").otherwise("LOW")


def top_fixes(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k packages of each image whose fix removes most weighted findings."""
    per = findings.where("fixed is not null").groupBy("image", "package").agg(*severity_counts(), F.countDistinct("cve").alias("cves"))
    weight = 10 * F.col("critical") + 5 * F.col("high") + 2 * F.col("medium") + F.col("low")
    best = W.partitionBy("image").orderBy(F.desc("weight"), "package")
    return per.withColumn("weight", weight).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def quick_wins(findings: DataFrame) -> DataFrame:
    """Non-breaking fixes per image, layer and package, five minutes each, worst first."""
    per = findings.where("fixed is not null and not breaking").groupBy("image", "layer", "package").agg(
        F.countDistinct("cve").alias("cves"), F.max(severity_rank(F.col("severity"))).alias("rank")
    )
    order = W.partitionBy("image").orderBy(F.desc("rank"), F.desc("cves"), "layer", "package")
    return per.withColumn("minutes", F.lit(5)).withColumn("place", F.row_number().over(order))


def action_plan(findings: DataFrame) -> DataFrame:
    """Per package and fixed version: best priority, CVEs, KEV, breaking, EPSS and hours (breaking 2, KEV 1, else a quarter)."""
    per = findings.where("fixed is not null").groupBy("package", "fixed").agg(
        F.min("priority").alias("priority"), F.countDistinct("cve").alias("cves"), F.bool_or("is_kev").alias("kev"),
        F.bool_or("breaking").alias("breaking"), F.max("epss").alias("epss"),
    )
    return per.withColumn("hours", F.when(F.col("breaking"), 2.0).when(F.col("kev"), 1.0).otherwise(0.25))


def effort_by_priority(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("priority").isin("P0", "P1", "P2")).groupBy("priority").agg(F.count("*").alias("fixes"), F.sum("hours").alias("hours"))


# Points of an image's priority.
IMPACT = {"critical": 10, "three high": 6, "ten medium": 3}
EXPOSED, HIDDEN, DATA, SERVICE = 12, 5, 10, 6
BASE_CHANCE, LIKELY = 10, {"exploited": 10, "half": 6, "fifth": 3}
KNOWN = {"exploited": 9, "serious": 6, "medium": 3}
EASE = {"critical": 7, "high": 4}
BASE_EASE, PATH = 6, {"critical": 14, "three high": 9, "some": 5}


def image_priority_score(c: Column, h: Column, m: Column, kev: Column, epss: Column, reachable: Column) -> Column:
    """Impact, probability, complexity and exploitability points of an image's counts."""
    hit = kev > 0
    impact = F.when(c > 0, IMPACT["critical"]).when(h >= 3, IMPACT["three high"]).when(m >= 10, IMPACT["ten medium"]).otherwise(0)
    impact += F.when(hit, EXPOSED).otherwise(HIDDEN) + DATA + SERVICE
    chance = BASE_CHANCE + F.when(hit, LIKELY["exploited"]).when(epss >= 0.5, LIKELY["half"]).when(epss >= 0.2, LIKELY["fifth"]).otherwise(0)
    chance += F.when(hit | (epss >= 0.9), KNOWN["exploited"]).when(c + h > 0, KNOWN["serious"]).when(m > 0, KNOWN["medium"]).otherwise(0)
    ease = BASE_EASE + F.when(c > 0, EASE["critical"]).when(h > 0, EASE["high"]).otherwise(0)
    path = F.when(hit | (c > 0), PATH["critical"]).when(h >= 3, PATH["three high"]).when((m > 0) | (reachable > 0), PATH["some"]).otherwise(0)
    return impact + chance + ease + path


def image_priority(score: Column) -> Column:
    return (
        F.when(score >= 80, "P1 - Show Stopper").when(score >= 60, "P2 - Critical").when(score >= 40, "P3 - Major").when(score >= 20, "P4 - Normal").otherwise("P5 - Minor")
    )


#: Packages whose upgrades often conflict with others (fixed values).
CONFLICTING = ("netty", "jackson", "guava", "slf4j", "logback", "spring-", "kotlin-stdlib", "protobuf")


def fix_batches(fixes: DataFrame) -> DataFrame:
    """Batches of fixes by risk, with seconds to apply and to test, and fixes by severity where there is such a column."""
    conflict = F.lit(False)
    for name in CONFLICTING:
        conflict |= F.col("package").contains(name)
    risk = F.when(conflict, "High").when(F.col("breaking"), "Moderate").otherwise("Low")
    n = F.col("n")
    seconds = F.when(F.col("risk") == "Low", 5 * n + 30).when(F.col("risk") == "Moderate", 10 * n + 60).otherwise(15 * n + 90)
    counts = severity_counts() if "severity" in fixes.columns else []
    return fixes.groupBy(risk.alias("risk")).agg(F.count("*").alias("n"), *counts).withColumn("seconds", seconds).withColumn("test_seconds", 20 * n)


def reachability_summary(findings: DataFrame, by: str = "image") -> DataFrame:
    total, reached = F.count("*"), F.count_if("reachable")
    return findings.groupBy(by).agg(total.alias("total"), reached.alias("reachable"), (total - reached).alias("unreachable"), ((total - reached) / total * 100).alias("noise"))


def _by_image(findings: DataFrame, by: str, prefix: str) -> DataFrame:
    """Counts and distinct CVEs of each image; a scan kept by `sources.history` is not shuffled for it."""
    named = {"total": F.count("*"), "critical": F.count_if(F.col("severity") == "CRITICAL"), "high": F.count_if(F.col("severity") == "HIGH"), "cves": F.collect_set("cve")}
    if "severity" not in findings.columns:
        named = {"cves": named["cves"]}
    return findings.groupBy(by).agg(*[c.alias(prefix + n) for n, c in named.items()])


def _two_scans(baseline: DataFrame, current: DataFrame, by: str) -> DataFrame:
    both = _by_image(baseline, by, "a_").join(_by_image(current, by, "b_"), by, "full_outer")
    none = F.array().cast("array<string>")
    return both.withColumn("a_cves", F.coalesce("a_cves", none)).withColumn("b_cves", F.coalesce("b_cves", none))


def scan_diff(baseline: DataFrame, current: DataFrame, by: str = "image") -> DataFrame:
    """New, fixed and unchanged CVEs of each image, and which way it went by their number."""
    both = _two_scans(baseline.select(by, "cve"), current.select(by, "cve"), by)
    n = lambda c: F.size(c).cast("long")
    out = both.select(by, n(F.array_except("b_cves", "a_cves")).alias("added"), n(F.array_except("a_cves", "b_cves")).alias("fixed"), n(F.array_intersect("a_cves", "b_cves")).alias("unchanged"))
    return out.withColumn("trend", F.when(F.col("added") > F.col("fixed"), "WORSE").when(F.col("added") < F.col("fixed"), "BETTER").otherwise("UNCHANGED"))


def baseline_delta(baseline: DataFrame, current: DataFrame, by: str = "image") -> DataFrame:
    """Change of total, critical and high findings of each image, and the CVEs that are new and fixed, sorted."""
    both = _two_scans(baseline.select(by, "cve", "severity"), current.select(by, "cve", "severity"), by).fillna(0)
    change = [(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in ("total", "critical", "high")]
    return both.select(by, *change, F.array_sort(F.array_except("b_cves", "a_cves")).alias("added"), F.array_sort(F.array_except("a_cves", "b_cves")).alias("fixed"))


def anti_new(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet: new tickets, native findings, orphans."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")
