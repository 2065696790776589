"""Queries on upgrades: impact, differences, plans and effort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.functions import upgrades as U
from depsift.functions.severity import fix_urgency, risk_level
from depsift.operators import match
from depsift.operators import upgrades as O
from depsift.queries.core import ranges_of
from depsift.queries.registry import Tables, query

_P = lambda v, n: f"try_cast(split_part({v}, '.', {n}) as bigint)"
_A, _B, _M, _N = _P("c.version", 1), _P("a.fixed", 1), _P("c.version", 2), _P("a.fixed", 2)
_PAIR = "from components c join advisories a on a.advisory_key = c.component_id where a.fixed is not null"


def pairs(t: Tables) -> DataFrame:
    return t.components.join(t.advisories.select(F.col("advisory_key").alias("component_id"), "fixed", "cvss", "cve", "summary"), "component_id")


@query(f"""
    select c.component_id, case when {_B} > {_A} then true when {_B} = {_A} then c.component_id % 5 = 4 and {_A} = 0 and {_N} > {_M} end as breaking,
        case when {_B} > {_A} then case when c.component_id % 7 = 0 and {_A} = 2 and {_B} = 3 then 'Vue 2→3 has major API changes. Migration guide: https://v3-migration.vuejs.org/'
                when c.component_id % 7 = 1 then 'Angular ' || {_A} || '→' || {_B} || ' migration guide: https://update.angular.io/'
                when c.component_id % 5 = 4 and {_A} = 0 then 'Pre-1.0 Rust crate: ' || c.version || '→' || a.fixed || ' may have breaking changes in minor versions'
                when c.component_id % 5 = 3 and {_B} >= 2 then 'Go module major version ' || {_A} || '→' || {_B} || '. Update import paths to /v' || {_B}
                else 'Major version upgrade ' || {_A} || '→' || {_B} || ' may require code changes' || case c.component_id % 5 when 3 then '. Go modules use v2+ for breaking changes (import path changes).'
                    when 4 then '. Rust crates follow semver. Pre-1.0 allows breaking changes in minor versions.' else '' end end
             when {_B} = {_A} then case when c.component_id % 5 = 4 and {_A} = 0 and {_N} > {_M} then 'Pre-1.0 Rust: 0.' || {_M} || '→0.' || {_N} || ' may contain breaking changes'
                when {_N} > {_M} + 5 then 'Minor version jump ' || {_A} || '.' || {_M} || '→' || {_B} || '.' || {_N} || ' - review changelog' else 'Patch update - low risk' end end as note {_PAIR}
""")
def upgrade_impact(t: Tables) -> DataFrame:
    name = F.expr("case component_id % 7 when 0 then 'vue' when 1 then '@angular/core' else name end")
    eco = F.expr("case component_id % 5 when 3 then 'Go' when 4 then 'Rust' end")
    rows = pairs(t).where("fixed is not null")
    return rows.select("component_id", U.upgrade_impact(name, eco, F.col("version"), F.col("fixed")).alias("u")).select("component_id", "u.*")


@query("""
    select a.cve, concat_ws('. ', case when cvss >= 9 then 'CRITICAL severity - immediate action required' when cvss >= 7 then 'HIGH severity - fix as soon as possible'
            when cvss >= 4 then 'MEDIUM severity - schedule fix in near term' when cvss > 0 then 'LOW severity - fix when convenient' else 'Unknown severity' end,
        case when k.cve is not null then 'Listed in CISA KEV (Known Exploited Vulnerabilities) - actively exploited in the wild' end,
        case when e.epss >= 0.9 then 'Very high' when e.epss >= 0.5 then 'High' when e.epss >= 0.1 then 'Moderate' end || printf(' exploit probability (EPSS: %.1f%%)', e.epss * 100),
        case when cvss >= 9 then 'Very high CVSS score: ' when cvss >= 7 then 'High CVSS score: ' end || replace(cast(cvss as string), '.0', ''), 'Impact: ' || summary) as why
    from advisories a left join epss e on e.cve = a.cve left join kev k on k.cve = a.cve
""")
def why_fix(t: Tables) -> DataFrame:
    from depsift.functions.severity import severity_from_cvss

    rows = match.enrich_epss_kev(t.advisories, t.epss, t.kev)
    return rows.select("cve", U.why_fix(severity_from_cvss(F.col("cvss")), F.col("is_kev"), F.col("epss"), F.col("cvss"), F.col("summary")).alias("why"))


@query(f"""
    select c.component_id, case when {_B} > {_A} then 'Major version upgrade (' || c.version || ' → ' || a.fixed || ') - expect breaking changes. Review the changelog and test thoroughly before upgrading.'
        when {_N} > {_M} then 'Minor version upgrade (' || c.version || ' → ' || a.fixed || ') - may include new features and deprecations. Review release notes for details.'
        else 'Version upgrade (' || c.version || ' → ' || a.fixed || ') - review the changelog for compatibility information.' end as note {_PAIR}
""")
def version_change_note(t: Tables) -> DataFrame:
    return pairs(t).where("fixed is not null").select("component_id", U.version_change_note(F.col("version"), F.col("fixed")).alias("note"))


_GRAPHS = """old as (select l_orderkey as upgrade, cast(l_partkey % 50 as string) as name, cast(max(l_suppkey % 3) as string) as version from lineitem where l_linenumber % 4 > 0 group by 1, 2),
    fresh as (select l_orderkey as upgrade, cast(l_partkey % 50 as string) as name, cast(max(l_suppkey % 3 + l_linenumber % 2) as string) as version from lineitem where l_linenumber % 5 > 0 group by 1, 2),
    diff as (select coalesce(o.upgrade, n.upgrade) as upgrade, coalesce(o.name, n.name) as name, case when o.name is null then 'NewDependency' when n.name is null then 'Removed' else 'VersionAlignment' end as reason,
        coalesce(o.version, 'none') as from_version, coalesce(n.version, 'removed') as to_version, case when o.name is null then 'Low' when n.name is null then 'High' end as risk,
        case when n.name is null then 1 else 0 end as breaking from old o full outer join fresh n on o.upgrade = n.upgrade and o.name = n.name where o.version is distinct from n.version),
    known as (select upgrade, name, reason, coalesce(risk, case when name::int % 3 = 0 then 'Critical' else 'Medium' end) as risk, breaking + case when name::int % 7 = 0 then 1 else 0 end as breaking from diff),
    direct as (select o_orderkey as upgrade, case o_orderkey % 4 when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' else 'Critical' end as risk, o_orderkey % 3 as breaking from orders)"""
_ORDER = "list_position(['Low', 'Medium', 'High', 'Critical'], {0})"


def graph_diff(t: Tables) -> DataFrame:
    self_ = t.orders.select(F.col("o_orderkey").alias("upgrade"), F.lit("self").alias("name"), F.lit("1").alias("version"), F.lit("SELF").alias("relation"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("upgrade"), (F.col("l_partkey") % 50).cast("string").alias("name"), "l_suppkey", "l_linenumber", F.lit("INDIRECT").alias("relation"))
    old = rows.where("l_linenumber % 4 > 0").withColumn("version", F.expr("cast(l_suppkey % 3 as string)"))
    new = rows.where("l_linenumber % 5 > 0").withColumn("version", F.expr("cast(l_suppkey % 3 + l_linenumber % 2 as string)"))
    return O.dependency_diff(old.select(*self_.columns).unionByName(self_), new.select(*self_.columns))


def known_changes(t: Tables) -> DataFrame:
    number = F.col("name").cast("int")
    risk = F.coalesce("risk", F.when(number % 3 == 0, "Critical").otherwise("Medium"))
    return graph_diff(t).withColumn("risk", risk).withColumn("breaking", F.col("breaking") + F.when(number % 7 == 0, 1).otherwise(0))


def direct(t: Tables) -> DataFrame:
    risk = F.expr("case o_orderkey % 4 when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' else 'Critical' end")
    return t.orders.select(F.col("o_orderkey").alias("upgrade"), risk.alias("risk"), (F.col("o_orderkey") % 3).alias("breaking"))


@query(f"with {_GRAPHS} select * from diff")
def dependency_diff(t: Tables) -> DataFrame:
    return graph_diff(t)


@query(f"""
    with {_GRAPHS}, most as (select upgrade, max(greatest({_ORDER.format('risk')}, case when breaking > 0 then 2 else 1 end, case when reason = 'Removed' then 4 else 1 end)) as m from known group by 1)
    select d.upgrade, ['Low', 'Medium', 'High', 'Critical'][greatest({_ORDER.format('d.risk')}, case when d.breaking > 0 then 3 else 1 end, coalesce(m.m, 1))] as risk from direct d left join most m on m.upgrade = d.upgrade
""")
def upgrade_overall_risk(t: Tables) -> DataFrame:
    return O.upgrade_overall_risk(direct(t), known_changes(t))


@query(f"""
    with {_GRAPHS}, s as (select upgrade, sum([0.1, 0.5, 2.0, 4.0][{_ORDER.format('risk')}]::double + breaking * 0.5) as more, sum(breaking) as broken, count_if(reason = 'Removed') as removed, count_if(reason = 'NewDependency') as added from known group by 1)
    select d.upgrade, round(round(0.5 + [0.25, 1.0, 4.0, 8.0][{_ORDER.format('d.risk')}]::double + d.breaking * 0.5 + coalesce(s.more, 0), 6) * 4) / 4 as hours, coalesce(broken, 0)::bigint as broken,
           coalesce(removed, 0) as removed, coalesce(added, 0) as added from direct d left join s on s.upgrade = d.upgrade
""")
def upgrade_effort(t: Tables) -> DataFrame:
    return O.upgrade_effort(direct(t), known_changes(t))


@query("""
    with o as (select p_partkey as k, 'c' || p_partkey as class, ['m' || p_size % 3, 'm' || p_size % 5] as m, ['f' || p_size % 2] as f from part where p_partkey % 7 > 0),
    n as (select p_partkey as k, 'c' || p_partkey as class, ['m' || p_size % 4] as m, ['f' || p_size % 3] as f from part where p_partkey % 5 > 0),
    b as (select o.class, o.m as m0, n.m as m1, o.f as f0, n.f as f1 from o join n on o.class = n.class)
    select class, 'RemovedClass' as kind, class as signature from o where class not in (select class from n) union all select class, 'AddedClass', class from n where class not in (select class from o)
    union all select class, 'RemovedMethod', unnest(list_distinct(list_filter(m0, lambda x: not list_contains(m1, x)))) from b union all select class, 'AddedMethod', unnest(list_filter(m1, lambda x: not list_contains(m0, x))) from b
    union all select class, 'RemovedField', unnest(list_filter(f0, lambda x: not list_contains(f1, x))) from b union all select class, 'AddedField', unnest(list_filter(f1, lambda x: not list_contains(f0, x))) from b
""")
def api_diff(t: Tables) -> DataFrame:
    member = lambda p, n: F.concat(F.lit(p), (F.col("p_size") % n).cast("string"))
    name = F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("class")
    old = t.part.where("p_partkey % 7 > 0").select(name, F.array(member("m", 3), member("m", 5)).alias("methods"), F.array(member("f", 2)).alias("fields"))
    new = t.part.where("p_partkey % 5 > 0").select(name, F.array(member("m", 4)).alias("methods"), F.array(member("f", 3)).alias("fields"))
    return O.api_diff(old, new)


@query("select c.component_id, k.component_id as original, k.name as artifact, 1.0::double as confidence from components c join components k on k.component_id % 3 = 0 and md5(k.name) = md5(c.name)")
def shaded_class_match(t: Tables) -> DataFrame:
    print_ = F.md5(F.col("name").cast("binary")).alias("fingerprint")
    known = t.components.where("component_id % 3 = 0").select(print_, F.col("component_id").alias("class"), F.col("name").alias("artifact"))
    return O.shaded_class_match(t.components.select("component_id", print_), known).select("component_id", "original", "artifact", "confidence")


@query("""
    select c.component_id, r.original || substr(c.name, length(r.shaded) + 1) as original, 0.8::double as confidence from components c
    join (select distinct substr(name, 1, 5) as shaded, concat('org.', substr(name, 1, 5)) as original from components where component_id % 10 = 0) r on starts_with(c.name, r.shaded)
""")
def relocation_match(t: Tables) -> DataFrame:
    start = F.expr("substr(name, 1, 5)")
    relocations = t.components.where("component_id % 10 = 0").select(start.alias("shaded"), F.concat(F.lit("org."), start).alias("pattern")).distinct()
    return O.relocation_match(t.components.select("component_id", F.col("name").alias("class")), relocations).select("component_id", "original", "confidence")


@query("""
    select component_id as jar, case when component_id % 2 = 0 then 'pom:' || name when component_id % 3 = 0 then 'man:' || name when component_id % 5 = 0 then 'sum:' || name end as coordinates,
           case when component_id % 2 = 0 then 'pom' when component_id % 3 = 0 then 'manifest' when component_id % 5 = 0 then 'checksum' end as source from components
""")
def identify_artifacts(t: Tables) -> DataFrame:
    jar, sha = F.col("component_id").alias("jar"), F.md5(F.col("component_id").cast("string").cast("binary")).alias("sha")
    told = lambda n, p, *key: t.components.where(f"component_id % {n} = 0").select(*key, F.concat(F.lit(p), "name").alias("coordinates"))
    return O.identify_artifacts(t.components.select(jar, sha), told(2, "pom:", jar), told(3, "man:", jar), told(5, "sum:", sha)).select("jar", "coordinates", "source")


@query("select cve as advisory, name, fixed from advisories")
def first_fixed_version(t: Tables) -> DataFrame:
    return O.first_fixed_version(ranges_of(t.advisories))


@query("""
    select ecosystem, count(distinct cve) as total, count(fixed) as fixable, count_if(fixed is null) as unfixable,
           case when count(fixed) = 0 then 'No immediate fixes available' when count(fixed) <= 5 then 'Low (< 1 hour)' when count(fixed) <= 20 then 'Medium (1-4 hours)' else 'High (> 4 hours)' end as effort
    from advisories group by 1
""")
def remediation_summary(t: Tables) -> DataFrame:
    # advisories may share a CVE: each is met by a name of its own
    own = t.advisories.withColumn("cve", F.concat_ws("#", "cve", "advisory_key"))
    fixes = O.first_fixed_version(ranges_of(own)).join(own.select(F.col("cve").alias("advisory"), "ecosystem"), "advisory")
    return O.remediation_summary(fixes.withColumn("advisory", F.substring_index("advisory", "#", 1)), "ecosystem")


@query("""
    with f as (select component_id as package, case when size % 10 >= 8 then 'IMMEDIATE' when size % 10 >= 6 then 'HIGH' when size % 10 >= 4 then 'MEDIUM' else 'LOW' end as urgency from components),
    d as (select package, dst from f join (select distinct src, dst from edges) e on e.src = f.package where urgency = 'HIGH')
    select 'IMMEDIATE' as urgency, count(*) as n, 30 as minutes, 0::bigint as conflicts from f where urgency = 'IMMEDIATE' and package not in (select dst from edges) having count(*) > 0
    union all select 'HIGH', count(*), 60, (select count(distinct package) from d where dst in (select dst from d group by 1 having count(*) > 1)) from f where urgency = 'HIGH' having count(*) > 0
    union all select 'MEDIUM', count(*), 120, 0 from f where urgency in ('MEDIUM', 'LOW') having count(*) > 0
""")
def urgency_batches(t: Tables) -> DataFrame:
    level = risk_level((F.col("size") % 10) / 10.0)
    return O.urgency_batches(t.components.select(F.col("component_id").alias("package"), fix_urgency(level).alias("urgency")), t.edges)


def _os_tables(t: Tables, version) -> tuple[DataFrame, DataFrame]:
    packages = t.components.select((F.col("component_id") % 3).alias("release"), F.col("name").alias("package"), "component_id", version(F.col("version")).alias("installed"))
    a = F.col("advisory_key")
    fixes = t.advisories.select((a % 2).alias("release"), F.col("name").alias("package"), "cve", F.when(F.col("fixed").isNotNull(), version(F.col("fixed"))).alias("fixed"))
    return packages, fixes


@query("""
    with m as (select c.component_id % 3 as release, c.name as package, c.version as installed, a.cve, a.fixed, list_transform(string_split(a.fixed, '.'), lambda x: x::int) as key
        from components c join advisories a on a.name = c.name and a.advisory_key % 2 = c.component_id % 3
        where list_transform(string_split(c.version, '.'), lambda x: x::int) < list_transform(string_split(a.fixed, '.'), lambda x: x::int))
    select release, package, '1:' || installed || '-2' as installed, '1:' || arg_max(fixed, key) || '-2' as recommended, array_to_string(list_sort(list(distinct cve)), ',') as cves from m group by 1, 2, 3
""")
def os_upgrade_plan(t: Tables) -> DataFrame:
    packages, fixes = _os_tables(t, lambda v: F.concat(F.lit("1:"), v, F.lit("-2")))
    # a plan is of a version, not of those who have it
    found = match.os_match(packages.drop("component_id").distinct(), fixes, "debian")
    return O.os_upgrade_plan(found, "debian").withColumn("cves", F.concat_ws(",", "cves"))


@query("""
    with r as (select user_id as package, event_id, row_number() over (partition by user_id order by event_id desc) - 1 as position, count(*) over (partition by user_id) as n from events),
    w as (select * from r where position >= 1 and position < least(n, 6) and n > 6)
    select package, 'v' || event_id as version, 'first ' || event_id as description from w where event_id % 2 = 0 union all select package, 'v' || event_id, 'second' from w where event_id % 2 = 0
    union all select package, 'v' || event_id, 'inline' from w where event_id % 3 = 0
""")
def release_breaking_changes(t: Tables) -> DataFrame:
    """Of the packages with over six releases, from the seventh newest to the second."""
    from pyspark.sql import Window as W

    version = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    per, order = W.partitionBy("user_id"), W.partitionBy("user_id").orderBy(F.desc("event_id"))
    body = F.expr("""concat('# Notes\\n- none\\n', if(event_id % 2 = 0, concat('## Breaking changes\\n- first ', event_id, '\\ntext\\n 2. second\\n# Fixes\\n- other\\n'), ''),
        if(event_id % 3 = 0, 'now **BREAKING**: inline\\n', ''))""")
    rows = t.events.select(F.col("user_id").alias("package"), version.alias("version"), body.alias("body"), (F.row_number().over(order) - 1).alias("position"), F.count("*").over(per).alias("n"), "event_id", "user_id")
    pick = lambda k: F.max(F.when(F.col("position") == k, F.col("version"))).over(per)
    rows = rows.withColumn("old", pick(6)).withColumn("new", pick(1)).where("n > 6").drop("event_id", "user_id", "n")
    return O.release_breaking_changes(rows, "old", "new")
