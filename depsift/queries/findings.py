"""Filters, summaries, plans and diffs of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.functions.severity import priority, severity_from_cvss
from depsift.operators import findings as O
from depsift.queries.registry import Tables, query

KEYS = ("image", "layer", "cve", "tool")
PRIORITY = """case when (is_kev and cvss >= 7) or cvss >= 9 or epss >= 0.9 then 'P0' when cvss >= 7 and (is_kev or epss >= 0.5) then 'P1'
    when cvss >= 7 or (cvss >= 4 and epss >= 0.1) then 'P2' when cvss >= 4 then 'P3' else 'P4' end"""
COUNTS = ", ".join(f"count_if(severity = '{s.upper()}') as {s}" for s in ("critical", "high", "medium", "low"))


def prioritised(t: Tables) -> DataFrame:
    return t.findings.withColumn("priority", priority(F.col("cvss"), F.col("epss"), F.col("is_kev")))


def _named(name: str, condition: str):
    def run(t: Tables) -> DataFrame:
        return O.filter_findings(prioritised(t), name).groupBy("image").agg(F.count("*").alias("n"))

    run.__name__ = "filter_findings_" + name.replace("-", "_")
    query(f"select image, count(*) as n from (select *, {PRIORITY} as priority from findings) where {condition} group by image")(run)


for _name, _condition in O.FILTERS.items():
    _named(_name, _condition)


@query("select image, layer, cve, tool from findings where severity in ('MEDIUM', 'HIGH', 'CRITICAL')")
def filter_min_severity(t: Tables) -> DataFrame:
    return O.filter_min_severity(t.findings, "MEDIUM").select(*KEYS)


@query("""
    select component_id, 'substring' as kind from components where contains(lower(name), 'ring') union all
    select component_id, 'regex' as kind from components where regexp_matches(name, '^s.*-1[0-5]$') union all
    select component_id, 'glob' as kind from components where name like 's%-_' union all
    select component_id, 'severity' as kind from components c where contains(lower(name), 's') and exists (select 1 from advisories a where a.name = c.name and a.ecosystem = c.ecosystem and a.cvss >= 9)
""")
def search_dependencies(t: Tables) -> DataFrame:
    asks = (("RING", "substring"), ("^s.*-1[0-5]$", "regex"), ("s*-?", "glob"))
    parts = [O.search_dependencies(t.components, text, kind).select("component_id", F.lit(kind).alias("kind")) for text, kind in (*asks, ("[a", "regex"))]
    found = t.advisories.groupBy("ecosystem", "name").agg(F.collect_set(severity_from_cvss(F.col("cvss"))).alias("severities"))
    severe = O.search_dependencies(t.components.join(found, ["ecosystem", "name"], "left"), "S", severity="CRITICAL").select("component_id", F.lit("severity").alias("kind"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(severe)


@query("select cve from advisories where cvss >= 7")
def should_notify(t: Tables) -> DataFrame:
    return O.should_notify(t.advisories.select("cve", severity_from_cvss(F.col("cvss")).alias("severity")), "high").select("cve")


@query("""
    with rules as (select s_suppkey as pos, '-' || s_suppkey % 20 || '$' as pattern, 'team-' || s_suppkey as component from supplier where s_suppkey % 3 = 1 union all select 1000000000, '^s', 'Frontend'),
    first as (select package, arg_min(component, pos) as component from (select distinct package from findings) join rules on regexp_matches(package, pattern) group by 1)
    select image, layer, cve, tool, component from findings left join first using (package)
""")
def route_findings(t: Tables) -> DataFrame:
    """Rules of suppliers in their order, and a last one."""
    rules = t.supplier.where("s_suppkey % 3 = 1").selectExpr("s_suppkey as at", "concat('-', s_suppkey % 20, '$') as pattern", "concat('team-', s_suppkey) as component")
    last = t.region.select(F.lit(1000000000).cast("long").alias("at"), F.lit("^s").alias("pattern"), F.lit("Frontend").alias("component")).distinct()
    return O.route_findings(t.findings.select(*KEYS, "package"), rules.unionByName(last)).select(*KEYS, "component")


@query("select image, layer, cve, tool, case when cvss >= 9 then 'severity' when is_kev then 'kev' when epss >= 0.8 then 'epss' end as rule from findings")
def policy_violations(t: Tables) -> DataFrame:
    rule = O.policy_violation(F.col("severity"), F.col("is_kev"), F.col("epss"), "CRITICAL", True, 0.8)
    return t.findings.select(*KEYS, rule.alias("rule"))


@query("select component_id, case when license in ('AGPL-3.0-only', 'GPL-3.0-only') then 'denied' when license not in ('MIT', 'ISC', 'Apache-2.0') then 'not allowed' end as rule from components")
def license_policy(t: Tables) -> DataFrame:
    return t.components.select("component_id", O.license_violation(F.col("license"), ["AGPL-3.0-only", "GPL-3.0-only"], ["MIT", "ISC", "Apache-2.0"]).alias("rule"))


@query("select cve, 'deny' as rule from advisories where cvss > 9 union all select cve, 'warn' as rule from advisories where fixed is null")
def user_predicates(t: Tables) -> DataFrame:
    return O.user_predicates(t.advisories, {"deny": "cvss > 9", "warn": "fixed is null"}).select("cve", "rule")


@query("""
    select image, cve, max(severity) as severity, max(cvss) as cvss, max(fixed) as fixed, arg_min(layer, [tool_order, layer]) as layer,
           array_to_string(list_sort(list(distinct tool)), ',') as tools, arg_min(epss, [tool_order, layer]) filter (epss is not null) as epss, bool_or(is_kev) as is_kev,
           array_to_string(list_sort(list_distinct(flatten(list(['nvd/' || cve, tool || '/' || layer])))), ',') as references
    from (select * replace (case when layer <> 2 then epss + tool_order end as epss) from findings) group by image, cve
""")
def dedupe_findings(t: Tables) -> DataFrame:
    """Tools tell different EPSS scores, and none in the second layer. The SQL takes the greatest texts of severity and fix, not the worst and the first."""
    told = t.findings.withColumn("epss", F.when(F.col("layer") != 2, F.col("epss") + F.col("tool_order")))
    told = told.withColumn("references", F.array(F.concat(F.lit("nvd/"), "cve"), F.concat("tool", F.lit("/"), F.col("layer").cast("string"))))
    found = O.dedupe_findings(told, severity=F.max("severity"), fixed=F.max("fixed"))
    return found.withColumn("tools", F.concat_ws(",", "tools")).withColumn("references", F.concat_ws(",", "references"))


@query(f"select image, count(*) as total, {COUNTS}, count(fixed) as fixable, count_if(is_kev) as kev from findings group by image")
def findings_summary(t: Tables) -> DataFrame:
    return O.findings_summary(t.findings)


@query(f"""
    select image, greatest(0, 100 - 20 * critical - 10 * high - 5 * medium - 2 * low) as report,
           round(greatest(0.0, least(100.0, 100.0 - 20.0 * (10 * critical + 5 * high + 2 * medium + low) / total::double)), 6) as dashboard,
           greatest(0, 100 - 15 * critical - 8 * high - 3 * medium - low - 5 * reached) as status,
           case when s >= 90 then 'A' when s >= 80 then 'B' when s >= 70 then 'C' when s >= 60 then 'D' else 'F' end as grade, k as container,
           case when k >= 90 then 'A+' when k >= 75 then 'B' when k >= 60 then 'C' when k >= 40 then 'D' else 'F' end as rating,
           case when critical > 0 then 'CRITICAL' when high > 0 then 'HIGH' when medium > 5 then 'MEDIUM' else 'LOW' end as risk
    from (select image, count(*) as total, {COUNTS}, count_if(reachable) as reached,
          greatest(0, 100 - least(10 * count_if(severity = 'CRITICAL'), 100) - least(2 * count_if(severity = 'HIGH'), 40) - least(count_if(severity = 'MEDIUM'), 50)) as s,
          greatest(0, 100 - 10 * least(count_if(severity = 'CRITICAL'), 10) - 2 * least(count_if(severity = 'HIGH'), 20) - least(count_if(severity = 'MEDIUM'), 50) - 5 * least(count_if(is_kev), 5)) as k from findings group by image)
""")
def security_score(t: Tables) -> DataFrame:
    s = O.findings_summary(t.findings).join(O.reachability_summary(t.findings).select("image", F.col("reachable").alias("reached")), "image")
    c = [F.col(x) for x in ("critical", "high", "medium", "low")]
    container = O.security_score(*c, "container", kev=F.col("kev"))
    return s.select(
        "image", container.alias("container"), O.letter_rating(container).alias("rating"), O.security_score(*c).alias("report"), F.round(O.security_score(*c, "dashboard", deps=F.col("total")), 6).alias("dashboard"),
        O.security_score(*c, "status", reachable=F.col("reached")).alias("status"), O.letter_grade(O.security_score(*c, "graded")).alias("grade"), O.scan_risk_level(*c[:3]).alias("risk"),
    )


@query(f"""
    select image, package, cves, weight, place from (
        select *, row_number() over (partition by image order by weight desc, package) as place from (
            select image, package, count(distinct cve) as cves,
                   10 * count_if(severity = 'CRITICAL') + 5 * count_if(severity = 'HIGH') + 2 * count_if(severity = 'MEDIUM') + count_if(severity = 'LOW') as weight
            from findings where fixed is not null group by image, package)) where place <= 5
""")
def top_fixes(t: Tables) -> DataFrame:
    return O.top_fixes(t.findings).select("image", "package", "cves", "weight", "place")


_RANK = "case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


@query(f"""
    select image, layer, package, cves, 5 as minutes, row_number() over (partition by image order by rank desc, cves desc, layer, package) as place from (
        select image, layer, package, count(distinct cve) as cves, max({_RANK}) as rank from findings where fixed is not null and not breaking group by 1, 2, 3)
""")
def quick_wins(t: Tables) -> DataFrame:
    return O.quick_wins(t.findings).drop("rank")


_PLAN = f"""select package, fixed, min({PRIORITY}) as priority, count(distinct cve) as cves, bool_or(is_kev) as kev, bool_or(breaking) as breaking, max(epss) as epss,
    case when bool_or(breaking) then 2.0 when bool_or(is_kev) then 1.0 else 0.25 end::double as hours from findings where fixed is not null group by 1, 2"""


@query(_PLAN)
def action_plan(t: Tables) -> DataFrame:
    return O.action_plan(prioritised(t))


@query(f"select priority, count(*) as fixes, sum(hours)::double as hours from ({_PLAN}) where priority in ('P0', 'P1', 'P2') group by 1")
def effort_by_priority(t: Tables) -> DataFrame:
    return O.effort_by_priority(O.action_plan(prioritised(t)))


@query(f"""
    select image, score, case when score >= 80 then 'P1 - Show Stopper' when score >= 60 then 'P2 - Critical' when score >= 40 then 'P3 - Major' when score >= 20 then 'P4 - Normal' else 'P5 - Minor' end as level
    from (select image, case when c > 0 then 10 when h >= 3 then 6 when m >= 10 then 3 else 0 end + case when k > 0 then 12 else 5 end + 16
            + 10 + case when k > 0 then 10 when e >= 0.5 then 6 when e >= 0.2 then 3 else 0 end + case when k > 0 or e >= 0.9 then 9 when c + h > 0 then 6 when m > 0 then 3 else 0 end
            + case when c > 0 then 7 when h > 0 then 4 else 0 end + 6 + case when k > 0 or c > 0 then 14 when h >= 3 then 9 when m > 0 or r > 0 then 5 else 0 end as score
          from (select image, count_if(severity = 'CRITICAL') c, count_if(severity = 'HIGH') h, count_if(severity = 'MEDIUM') m, count_if(is_kev) k, max(epss) e, count_if(reachable) r from findings group by 1))
""")
def image_priority_score(t: Tables) -> DataFrame:
    s = t.findings.groupBy("image").agg(*O.severity_counts(), F.count_if("is_kev").alias("k"), F.max("epss").alias("e"), F.count_if("reachable").alias("r"))
    score = O.image_priority_score(*[F.col(x) for x in ("critical", "high", "medium", "k", "e", "r")])
    return s.select("image", score.alias("score")).withColumn("level", O.image_priority(F.col("score")))


@query("""
    select *, case risk when 'Low' then 5 * n + 30 when 'Moderate' then 10 * n + 60 else 15 * n + 90 end as seconds, 20 * n as test_seconds
    from (select case when contains(package, 'spring-') then 'High' when breaking then 'Moderate' else 'Low' end as risk, count(*) as n,
                 count_if(cvss >= 9) as critical, count_if(cvss >= 7 and cvss < 9) as high, count_if(cvss >= 4 and cvss < 7) as medium, count_if(cvss > 0 and cvss < 4) as low
          from (select cvss, case when contains(name, 'red') then concat('spring-', name) else name end as package, fixed > '3' as breaking from advisories where fixed is not null) group by 1)
""")
def fix_batches(t: Tables) -> DataFrame:
    package = F.when(F.col("name").contains("red"), F.concat(F.lit("spring-"), "name")).otherwise(F.col("name"))
    rows = t.advisories.where("fixed is not null")
    return O.fix_batches(rows.select(package.alias("package"), (F.col("fixed") > "3").alias("breaking"), severity_from_cvss(F.col("cvss")).alias("severity")))


@query("select image, count(*) as total, count_if(reachable) as reachable, count(*) - count_if(reachable) as unreachable, (count(*) - count_if(reachable)) / count(*) * 100 as noise from findings group by image")
def reachability_summary(t: Tables) -> DataFrame:
    return O.reachability_summary(t.findings)


def _scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.findings.where("scanned < '1995-06-01'"), t.findings.where("scanned >= '1995-06-01'")


_TWO = "a as (select image, cve, severity from findings where scanned < '1995-06-01'), b as (select image, cve, severity from findings where scanned >= '1995-06-01')"


@query(f"""
    with {_TWO}, sides as (select coalesce(x.image, y.image) as image, x.cve as old, y.cve as new from (select distinct image, cve from a) x full outer join (select distinct image, cve from b) y on x.image = y.image and x.cve = y.cve),
    sums as (select image, count_if(old is null) as added, count_if(new is null) as fixed, count_if(old is not null and new is not null) as unchanged from sides group by image)
    select *, case when added > fixed then 'WORSE' when added < fixed then 'BETTER' else 'UNCHANGED' end as trend from sums
""")
def scan_diff(t: Tables) -> DataFrame:
    return O.scan_diff(*_scans(t))


@query(f"""
    with {_TWO} select image, sum(s)::bigint as total, sum(case when severity = 'CRITICAL' then s else 0 end)::bigint as critical, sum(case when severity = 'HIGH' then s else 0 end)::bigint as high,
        coalesce((select string_agg(distinct b.cve, ',' order by b.cve) from b where b.image = x.image and b.cve not in (select a.cve from a where a.image = x.image)), '') as added,
        coalesce((select string_agg(distinct a.cve, ',' order by a.cve) from a where a.image = x.image and a.cve not in (select b.cve from b where b.image = x.image)), '') as fixed
    from (select image, severity, -1 as s from a union all select image, severity, 1 as s from b) x group by image
""")
def baseline_delta(t: Tables) -> DataFrame:
    return O.baseline_delta(*_scans(t)).withColumn("added", F.concat_ws(",", "added")).withColumn("fixed", F.concat_ws(",", "fixed"))


@query("""
    with x as (select image, count(*) as total, count_if(severity = 'CRITICAL') as critical from findings group by image)
    select a.image, case when a.total <> b.total then case when a.total < b.total then a.image else b.image end when a.critical < b.critical then a.image when b.critical < a.critical then b.image end as better
    from x a join x b on b.image = a.image + 1
""")
def image_compare(t: Tables) -> DataFrame:
    """Each image against the next."""
    a = O.findings_summary(t.findings).select("image", "total", "critical")
    b = a.select((F.col("image") - 1).alias("image"), F.col("total").alias("t2"), F.col("critical").alias("c2"))
    total, crit, t2, c2 = (F.col(x) for x in ("total", "critical", "t2", "c2"))
    first, second = F.col("image"), F.col("image") + 1
    better = F.when(total < t2, first).when(total > t2, second).when(crit < c2, first).when(c2 < crit, second)
    return a.join(b, "image").select("image", better.alias("better"))


@query("select f.cve, f.package, f.installed from (select distinct cve, package, installed from findings) f where not exists (select 1 from advisories a where a.cve = f.cve and a.advisory_key % 2 = 0)")
def new_tickets(t: Tables) -> DataFrame:
    known = t.findings.join(t.advisories.where("advisory_key % 2 = 0").select("cve"), "cve", "left_semi")
    return O.anti_new(t.findings.select("cve", "package", "installed").distinct(), known, ["cve", "package", "installed"])


@query("""
    select image, layer, cve, package from findings f where tool = 'trivy' union all
    select image, layer, cve, package from findings f where tool = 'native' and not exists (select 1 from findings g where g.tool = 'trivy' and g.image = f.image and g.cve = f.cve and g.package = f.package)
""")
def merge_native_findings(t: Tables) -> DataFrame:
    rows = t.findings.select("image", "layer", "cve", "package", "tool")
    trivy, native = rows.where("tool = 'trivy'"), rows.where("tool = 'native'")
    return trivy.unionByName(O.anti_new(native, trivy, ["image", "cve", "package"])).drop("tool")


@query("""
    select image, layer, cve, tool, rank from (select image, layer, cve, tool, row_number() over (partition by image order by cvss desc, cve, layer, tool, package) as rank from findings)
""")
def rank_findings(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("image").orderBy(F.desc("cvss"), "cve", "layer", "tool", "package")
    return t.findings.select(*KEYS, F.row_number().over(order).alias("rank"))


@query(f"""
    select image, cve, place from (select image, cve, row_number() over (partition by image order by is_kev desc, rank desc, cve) as place
        from (select distinct image, cve, is_kev, {_RANK} as rank from findings)) where place <= 5
""")
def fix_order(t: Tables) -> DataFrame:
    """KEV first, then severity; the first five of each image."""
    from pyspark.sql import Window as W

    from depsift.functions.severity import severity_rank

    rows = t.findings.select("image", "cve", "is_kev", severity_rank(F.col("severity")).alias("rank")).distinct()
    order = W.partitionBy("image").orderBy(F.desc("is_kev"), F.desc("rank"), "cve")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 5").select("image", "cve", "place")


@query("select image, cve, package, layer, tool from (select *, row_number() over (partition by image, cve, package order by layer, tool_order) as place from findings) where place = 1")
def first_seen_dedupe(t: Tables) -> DataFrame:
    first = F.min_by(F.struct("layer", "tool"), F.struct("layer", "tool_order"))
    return t.findings.groupBy("image", "cve", "package").agg(first.alias("f")).select("image", "cve", "package", "f.*")


@query("select image, layer, array_to_string(list_sort(list(distinct package)), ',') as packages from findings group by 1, 2")
def layer_packages(t: Tables) -> DataFrame:
    return t.findings.groupBy("image", "layer").agg(F.concat_ws(",", F.array_sort(F.collect_set("package"))).alias("packages"))


@query("""
    select image, concat_ws('; ', c, h, k) as pci, concat_ws('; ', c, h, k) as hipaa, concat_ws('; ', c, k) as soc2, case when s >= 90 and n = 0 then 'PASS' when s >= 70 then 'WARNING' else 'FAIL' end as overall
    from (select image, count(*) as n, case when count_if(severity = 'CRITICAL') > 0 then count_if(severity = 'CRITICAL') || ' critical vulnerabilities present' end as c,
          case when count_if(severity = 'HIGH') > 0 then count_if(severity = 'HIGH') || ' high severity vulnerabilities' end as h, case when count_if(is_kev) > 0 then count_if(is_kev) || ' known exploited vulnerabilities (CISA KEV)' end as k,
          greatest(0, 100 - 20 * count_if(severity = 'CRITICAL') - 10 * count_if(severity = 'HIGH') - 5 * count_if(severity = 'MEDIUM') - 2 * count_if(severity = 'LOW')) as s from findings group by 1)
""")
def compliance_status(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("critical", "high", "medium", "low")]
    status = O.compliance_status(*c[:2], F.col("kev"), F.col("total"), O.security_score(*c))
    rows = O.findings_summary(t.findings).select("image", status.alias("s")).select("image", "s.*")
    return rows.select("image", *[F.array_join(x, "; ").alias(x) for x in ("pci", "hipaa", "soc2")], "overall")


@query(f"select image, case when critical > 0 then 'CRITICAL' when high > 0 then 'HIGH' when medium > 5 then 'MEDIUM' else 'LOW' end as risk from (select image, {COUNTS} from findings group by 1)")
def scan_risk_level(t: Tables) -> DataFrame:
    return O.findings_summary(t.findings).select("image", O.scan_risk_level(F.col("critical"), F.col("high"), F.col("medium")).alias("risk"))
