"""Queries on threat rules, feeds, look-alike names and suspicious changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.functions import threats as T
from depsift.functions.severity import severity_from_cvss
from depsift.operators import threats as O
from depsift.queries.registry import Tables, query


@query("""
    select component_id, component_id % 7 in (0, 1, 2) as hit from components
""")
def protestware(t: Tables) -> DataFrame:
    name = F.expr("case component_id % 7 when 0 then 'Colors' when 1 then 'node-ipc' when 2 then 'es5-ext' when 3 then 'colors' else name end")
    version = F.expr("case component_id % 7 when 0 then '1.4.1' when 1 then '11.0.0' when 2 then '0.10.60' when 3 then '1.4.0' else '1.4.1' end")
    return t.components.select("component_id", T.protestware(name, version).alias("hit"))


@query("""
    select component_id, case component_id % 6 when 0 then 'High' when 1 then 'Critical' when 2 then 'Medium' when 3 then 'Critical' when 4 then 'None' else 'Critical' end as level,
           case component_id % 6 when 0 then 'Network: Direct IP address connection' when 1 then 'Filesystem: SSH directory access,Filesystem: SSH private key access' when 2 then 'Execution: Process execution (exec)'
               when 3 then 'Network: Tunnel service usage,Env exfiltration: Shell environment variable' when 4 then '' else 'Execution: Dynamic code evaluation (eval),Crypto: Mining pool connection' end as evidence
    from components
""")
def scan_scripts(t: Tables) -> DataFrame:
    text = F.expr("""concat('run ', name, case component_id % 6 when 0 then ' http://10.0.0.1/x' when 1 then ' cat ~/.ssh/id_rsa' when 2 then ' exec (y)' when 3 then ' ngrok $HOME'
        when 4 then ' echo $HOME' else ' eval(z) stratum+tcp://p' end)""")
    rows = t.components.select("component_id", T.scan_scripts(text).alias("s"))
    return rows.select("component_id", "s.level", F.array_join("s.evidence", ",").alias("evidence"))


@query("""
    select component_id, component_id % 4 as evals, case when component_id % 3 = 0 then 21 else 1 end as escapes, case when component_id % 5 = 0 then 4 else 0 end as blobs,
           case when component_id % 2 = 0 then 6 else 0 end as long_lines,
           (case when component_id % 3 = 0 then 1 else 0 end + case when component_id % 5 = 0 then 1 else 0 end + case when component_id % 2 = 0 then 1 else 0 end) >= 2 as obfuscated
    from components
""")
def scan_obfuscation(t: Tables) -> DataFrame:
    source = F.expr("""concat(repeat('eval(1);', cast(component_id % 4 as int)), repeat('\\\\x4a', if(component_id % 3 = 0, 21, 1)),
        repeat(concat('!', repeat('A', 60)), if(component_id % 5 = 0, 4, 0)), repeat(concat('\\n', repeat('- ', 300)), if(component_id % 2 = 0, 6, 0)))""")
    rows = t.components.select("component_id", T.scan_obfuscation(source).alias("s"))
    return rows.select("component_id", "s.evals", "s.escapes", "s.blobs", "s.long_lines", "s.obfuscated")


@query("""
    select image, count(*) as files, count_if(layer % 3 = 0) as programs from findings group by image
""")
def binary_blobs(t: Tables) -> DataFrame:
    file = F.concat("package", F.expr("case layer % 3 when 0 then '.DLL' when 1 then '.dll.js' else '.py' end"))
    rows = t.findings.groupBy("image").agg(F.collect_list(file).alias("files"))
    return rows.select("image", F.size("files").cast("long").alias("files"), F.size(T.binary_blobs(F.col("files"))).cast("long").alias("programs"))


@query("select cve, advisory_key % 17 = 0 as malicious from advisories")
def malicious_text(t: Tables) -> DataFrame:
    return t.advisories.select("cve", T.malicious_text(F.col("summary"), F.col("ghsa")).alias("malicious"))


@query("select name, ecosystem, ghsa as id, fixed as versions, summary as description, count(*) over (partition by ecosystem) as in_ecosystem from advisories where contains(summary, 'malicious code')")
def malicious_db(t: Tables) -> DataFrame:
    affected = F.array(F.struct("name", "ecosystem", F.array_compact(F.array("fixed")).alias("versions")), F.struct(F.lit("x").alias("name"), F.lit("y").alias("ecosystem"), F.array("cve").alias("versions")))
    rows = O.malicious_db(t.advisories.select(F.col("ghsa").alias("id"), "summary", F.lit(None).cast("string").alias("details"), affected.alias("affected")))
    rows = rows.join(O.malicious_stats(rows).withColumnRenamed("packages", "in_ecosystem"), "ecosystem")
    return rows.select("name", "ecosystem", "id", F.get("versions", F.lit(0)).alias("versions"), "description", "in_ecosystem")


@query("""
    with m as (select component_id, case when component_id % 2 = 0 then 0 else 1 end as a, case when component_id % 3 = 1 then 0 else 1 end as b,
                      case when component_id % 10 in (1, 3, 7, 9) then 1 else 0 end as c, case when component_id % 60 < 3 then 1 else 0 end as d,
                      component_id % 7 = 0 as old, component_id % 6 = 0 as one, component_id % 4 = 0 or license is null or license like '%GPL%' as odd, component_id % 60 < 10 and component_id % 3 = 0 as jump from components)
    select component_id, case when a + b + c + d >= 2 then 15 else 0 end + case when old then 20 else 0 end + case when one then 10 else 0 end + case when odd then 15 else 0 end
        + case when jump then 25 else 0 end as score from m
""")
def package_risk(t: Tables) -> DataFrame:
    rows = t.components.selectExpr(
        "component_id", "case when component_id % 2 = 0 then 'u' end as repository_url", "case component_id % 3 when 0 then 'short' when 1 then 'a long description' end as description",
        "case when component_id % 2 = 0 or component_id % 5 = 0 then 'h' end as homepage_url", "component_id % 60 as total_versions", "case when component_id % 4 > 0 then license end as license",
        "if(component_id % 6 = 0, array('a'), array('a', 'b')) as maintainers", "20000 as weekly_downloads", "if(component_id % 3 = 0, '51.0.0', '50.9.9') as version",
        "if(component_id % 7 = 0, date'2022-01-01', date'2024-01-01') as last_publish_date", "date'2020-01-01' as first_publish_date",
    )
    risk = T.package_risk({c: F.col(c) for c in rows.columns}, F.lit("2024-06-01").cast("date"))
    return rows.select("component_id", risk["score"].alias("score"))


@query("""
    select part.p_partkey as component_id, case when p_size % 3 = 0 and p_partkey % 2 = 0 then 'High' when p_size % 3 = 0 or p_partkey % 2 = 0 then 'Medium' end as risk from part
""")
def suspicious_changes(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("component_id"), T.suspicious_changes(F.expr("if(p_size % 3 = 0, p_size + 1, 0)"), F.expr("if(p_partkey % 2 = 0, 2, 0)")).alias("risk"))


@query("""
    select c.component_id, concat_ws(',', size::double, price::double, case when component_id % 2 = 0 then '1.0' else '0.0' end) as vector,
           array_to_string([coalesce(a.cvss, 0), size::double, (price > 1500)::int::double, coalesce(e.epss, 0), (k.cve is not null)::int::double,
               case when a.cvss >= 9 then 3.0 when a.cvss >= 7 then 2.0 when a.cvss >= 4 then 1.0 else 0.0 end, case brand when 'Brand#1' then 1.0 when 'Brand#2' then 2.0 when 'Brand#3' then 3.0 when 'Brand#4' then 4.0 else 0.0 end,
               (size > 25)::int::double], ',') as flaw,
           array_to_string([size * 3.0::double, price::double, (a.cve is not null)::int::double, size::double, (price < 1200)::int::double, size / 50.0::double, 0.0::double, 7.0::double], ',') as dependency
    from components c left join advisories a on a.advisory_key = c.component_id left join epss e on e.cve = a.cve left join kev k on k.cve = a.cve
""")
def feature_vector(t: Tables) -> DataFrame:
    """Values of any columns, and the layouts of flaws and dependencies."""
    a = t.advisories.select(F.col("advisory_key").alias("component_id"), "cve", "cvss").join(t.epss.select("cve", "epss"), "cve", "left").join(t.kev.select("cve", F.lit(True).alias("kev")), "cve", "left")
    rows, c = t.components.join(a, "component_id", "left"), F.col
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("Brand#1", "rce", "Brand#2", "XSS", "Brand#3", "SQLi", "Brand#4", "CSRF")]), c("brand"))
    level = severity_from_cvss(c("cvss"))
    flaw = T.vulnerability_features(c("cvss"), c("size"), c("price") > 1500, c("epss"), c("kev"), level, kind, c("size") > 25)
    dependency = T.dependency_features(c("size") * 3, c("price"), c("cve").isNotNull(), c("size"), c("price") < 1200, c("size") / 50.0, F.lit(None).cast("double"), F.lit(7))
    text = lambda v: F.array_join(v.cast("array<string>"), ",")
    return rows.select("component_id", text(T.feature_vector(c("size"), c("price"), c("component_id") % 2 == 0)).alias("vector"), text(flaw).alias("flaw"), text(dependency).alias("dependency"))


_FEATURES = "select component_id, component_id % 150 as transitive, size % 12 as vulns, (component_id % 10) / 10.0 as maintainer, component_id % 70 as releases, (component_id % 20) / 20.0 as popularity from components"
_FEATURES_SQL = _FEATURES.replace("(component_id % 10) / 10.0", "(component_id % 10)::double / 10.0").replace("(component_id % 20) / 20.0", "(component_id % 20)::double / 20.0")


def features(t: Tables) -> DataFrame:
    text = _FEATURES.replace("(component_id % 10)", "cast(component_id % 10 as double)").replace("(component_id % 20)", "cast(component_id % 20 as double)")
    return t.spark.sql(text.replace("from components", "from {components}").replace("/ 10.0", "/ 10.0D").replace("/ 20.0", "/ 20.0D"), components=t.components)


@query(f"""
    with f as ({_FEATURES_SQL}), s as (
        select component_id, 'UnusualTransitiveCount' as kind, least(transitive / 100.0::double, 1.0::double) as score from f where transitive > 100
        union all select component_id, 'HighVulnerabilityCount', least(vulns / 10.0::double, 1.0::double) from f where vulns > 5
        union all select component_id, 'LowMaintainerScore', 1.0::double - maintainer from f where maintainer < 0.3
        union all select component_id, 'UnusualReleasePattern', case when releases < 2 then (2.0::double - releases) / 2.0::double else (releases - 52.0::double) / releases end from f where releases < 2 or releases > 52
        union all select component_id, 'LowPopularity', 1.0::double - popularity from f where popularity < 0.1)
    select component_id, kind, round(score, 6) as score from s union all select component_id, 'MultipleSignals', count(*) / 5.0::double from s group by 1 having count(*) >= 2
""")
def detect_anomalies(t: Tables) -> DataFrame:
    found = T.detect_anomalies(*[F.col(c) for c in ("transitive", "vulns", "maintainer", "releases", "popularity")])
    return features(t).select("component_id", F.explode(found).alias("a")).select("component_id", "a.kind", F.round("a.score", 6).alias("score"))


@query(f"""
    with f as ({_FEATURES_SQL}) select round(avg(transitive) + 2 * stddev_samp(transitive), 6) as max_transitive, round(avg(vulns) + 2 * stddev_samp(vulns), 6) as max_vulns, 0.3::double as min_maintainer,
        round(avg(releases) - 2 * stddev_samp(releases), 6) as min_releases, round(avg(releases) + 2 * stddev_samp(releases), 6) as max_releases, 0.1::double as min_popularity from f
""")
def train_anomaly_thresholds(t: Tables) -> DataFrame:
    bounds = O.train_anomaly_thresholds(features(t))
    return bounds.select(*[F.round(c, 6).alias(c) for c in bounds.columns])


@query("""
    with feed as (select advisory_key, case advisory_key % 3 when 0 then name when 1 then concat(substr(name, 1, 4), '*') else concat('*', substr(name, length(name) - 4)) end as pattern from advisories)
    select c.component_id, f.advisory_key as entry from components c join feed f on c.name = f.pattern or (contains(f.pattern, '*') and starts_with(c.name, split_part(f.pattern, '*', 1)) and ends_with(c.name, split_part(f.pattern, '*', 2)))
""")
def feed_lookup(t: Tables) -> DataFrame:
    pattern = F.expr("case advisory_key % 3 when 0 then name when 1 then concat(substr(name, 1, 4), '*') else concat('*', substr(name, length(name) - 4)) end")
    feed = t.advisories.select(pattern.alias("pattern"), F.col("advisory_key").alias("entry"))
    return O.feed_lookup(t.components.select("component_id", "name"), feed).select("component_id", "entry")


@query("""
    select 'feeds' as measure, count(*) as n from supplier union all select 'enabled', count_if(s_suppkey % 3 > 0) from supplier union all select 'threats', count(*) from advisories
    union all select case when cvss >= 7 then 'high' else 'low' end, count(*) from advisories group by 1
""")
def feed_stats(t: Tables) -> DataFrame:
    return O.feed_stats(t.supplier.select((F.col("s_suppkey") % 3 > 0).alias("enabled")), t.advisories.select(F.when(F.col("cvss") >= 7, "high").otherwise("low").alias("severity")))


@query("""
    select component_id, case when component_id % 2 = 0 then 'Critical' else 'High' end as level from components
    where (component_id % 10 in (0, 6) and component_id % 3 > 0) or (component_id % 10 = 5 and component_id % 3 < 2)
""")
def dependency_confusion(t: Tables) -> DataFrame:
    name = F.concat(F.lit("inner-"), F.col("component_id").cast("string"))
    registry = F.expr("case component_id % 3 when 0 then 'NpmRegistry' when 1 then 'PyPI' else 'Corporate' end")
    internal = t.components.where("component_id % 10 in (0, 5, 6)").select(name.alias("name"), F.when(F.col("component_id") % 2 == 0, "NpmRegistry").alias("expected"))
    return O.dependency_confusion(t.components.select("component_id", name.alias("name"), registry.alias("registry")), internal).select("component_id", "level")


@query("""
    with n as (select distinct name from components where name <> ''), k as (select distinct name as known from components where component_id % 4 = 0),
    p as (select name, known, levenshtein(name, known) as d, 1 - levenshtein(name, known)::double / greatest(length(name), length(known)) as s from n join k on name <> known),
    letters as (select *, [x for x in list_transform(range(1, length(name) + 1), lambda i: case when name[i] <> known[i] then known[i] || name[i] end) if x is not null] as diffs,
                length(name) = length(known) as same from p),
    scored as (select name, known, case when s > 0.7 then s * 50 else 0 end
        + case when same and len(diffs) = 1 and list_contains({keyboard}, diffs[1]) then 30 else 0 end
        + case when same and len(list_intersect(diffs, {alike})) > 0 then 25 else 0 end
        + case when regexp_matches(name, '[01]') then 10 else 0 end + case when contains(name, '--') then 10 else 0 end + case when contains(name, '_') and contains(name, '-') then 10 else 0 end
        + case when starts_with(name, known) or ends_with(name, known) then 15 else 0 end + case when replace(name, '-', '_') = replace(known, '-', '_') then 20 else 0 end as score from letters)
    select name, known, round(score, 6) as score, case when score > 80 then 'Critical' when score > 60 then 'High' else 'Medium' end as level
    from scored where score > 40 qualify row_number() over (partition by name order by score desc, known) = 1
""".replace("{keyboard}", "[" + ", ".join(f"'{k}{x}'" for k, xs in O.KEYBOARD.items() for x in xs) + "]")
   .replace("{alike}", "[" + ", ".join(f"'{k}{x}'" for k, xs in O.LOOK_ALIKES.items() for x in xs) + "]"))
def typosquat_full(t: Tables) -> DataFrame:
    found = O.typosquat_full(t.components, t.components.where("component_id % 4 = 0"))
    return found.select("name", "known", F.round("score", 6).alias("score"), "level")


@query("""
    with a as (select distinct user_id as package, concat(event_type, '-', cast(event_id % 50 as string)) as description from events), b as (select distinct user_id as package, concat(event_type, '-', cast(event_id * 3 % 50 as string)) as description from events)
    select *, 'new' as change from (select * from b except select * from a) union all select *, 'resolved' as change from (select * from a except select * from b)
""")
def threat_delta(t: Tables) -> DataFrame:
    """Every event tells a threat in the poll before and one in the poll after; all packages are watched."""
    told = lambda n: t.events.select(F.col("user_id").alias("package"), F.expr(f"concat(event_type, '-', cast({n} % 50 as string))").alias("description"))
    return O.threat_delta(told("event_id"), told("event_id * 3"), t.events.select(F.col("user_id").alias("package")))


@query("""
    with m as (select user_id as package, ts, event_id, concat('u@', event_type, '.org') as email, event_id % 60 as age from events),
    r as (select *, row_number() over (partition by package order by ts desc, event_id desc) as place, count(*) over (partition by package) as n from m),
    s as (select a.package, case when a.email <> b.email then 1 else 0 end + case when a.age < 30 and a.n > 1 then 1 else 0 end as signals from r a left join r b on b.package = a.package and b.place = 2 where a.place = 1)
    select package, case when signals = 2 then 'High' else 'Medium' end as risk from s where signals > 0
""")
def maintainer_change(t: Tables) -> DataFrame:
    email = F.concat(F.lit("u@"), "event_type", F.lit(".org"))
    rows = t.events.select(F.col("user_id").alias("package"), F.struct("ts", "event_id").alias("at"), email.alias("email"), (F.col("event_id") % 60).alias("account_age_days"))
    return O.maintainer_change(rows).select("package", "risk")


@query("""
    with r as (select user_id as package, event_id % 5 as major, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events)
    select a.package, concat('v', b.major, '.0.1') as old, concat('v', a.major, '.0.1') as new from r a join r b on b.package = a.package and b.place = 2 where a.place = 1 and a.major > b.major + 1
""")
def version_jump(t: Tables) -> DataFrame:
    version = F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"), F.lit(".0.1"))
    return O.version_jump(t.events.select(F.col("user_id").alias("package"), F.struct("ts", "event_id").alias("at"), version.alias("version")))


@query("""
    select user_id as package, count(*) as n from events where ts <= timestamp '2024-01-15' and ts > timestamp '2024-01-14' group by 1 having count(*) >= 3
""")
def release_burst(t: Tables) -> DataFrame:
    return O.release_burst(t.events.select(F.col("user_id").alias("package"), F.col("ts").alias("at")), F.lit("2024-01-15").cast("timestamp"))
