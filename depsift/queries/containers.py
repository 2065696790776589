"""Queries on images, distributions, licences and reachability of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators import containers as O
from depsift.operators import licences as L
from depsift.queries.registry import Tables, query

_NUMS = "list_transform(string_split({0}, '.'), lambda x: x::int)"


@query("""
    with l as (select distinct l_orderkey as image, l_linenumber as layer, case l_partkey % 3 when 0 then 'org:p' || l_partkey % 40 when 1 then 'p' || l_partkey % 40 else 'lib' || l_partkey % 40 || '-dev' end as package from lineitem),
    f as (select distinct l_orderkey as image, 'CVE-' || l_partkey % 30 as cve, case when l_partkey % 4 = 0 then 'lib' || l_partkey % 40 else 'p' || l_partkey % 40 end as package from lineitem),
    eq as (select distinct f.*, l.layer from f join l on l.image = f.image and (l.package = f.package or split_part(l.package, ':', 2) = f.package)),
    rest as (select * from f where not exists (select 1 from eq where eq.image = f.image and eq.package = f.package)),
    near as (select distinct r.*, l.layer from rest r join l on l.image = r.image and (contains(l.package, r.package) or contains(r.package, l.package))),
    every as (select * from eq union all select * from near union all select r.*, null from rest r where not exists (select 1 from near where near.image = r.image and near.package = r.package))
    select image, layer, cve, min(package) as package from every group by 1, 2, 3
""")
def layer_attribution(t: Tables) -> DataFrame:
    package = F.expr("case l_partkey % 3 when 0 then concat('org:p', l_partkey % 40) when 1 then concat('p', l_partkey % 40) else concat('lib', l_partkey % 40, '-dev') end")
    layers = t.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer"), package.alias("package"))
    asked = F.expr("case when l_partkey % 4 = 0 then concat('lib', l_partkey % 40) else concat('p', l_partkey % 40) end")
    findings = t.lineitem.select(F.col("l_orderkey").alias("image"), F.concat(F.lit("CVE-"), (F.col("l_partkey") % 30).cast("string")).alias("cve"), asked.alias("package"))
    return O.layer_attribution(layers, findings.distinct())


_OS = "from components c join advisories a on a.name = c.name and a.advisory_key % 2 = c.component_id % 3"


def _os(t: Tables, version) -> tuple[DataFrame, DataFrame]:
    packages = t.components.select((F.col("component_id") % 3).alias("release"), "name", "component_id", version(F.col("version")).alias("installed"))
    key = F.col("advisory_key")
    return packages, t.advisories.select((key % 2).alias("release"), "name", "cve", "ghsa", F.when(F.col("fixed").isNotNull(), version(F.col("fixed"))).alias("fixed"), key.alias("key"))


@query(f"""
    select c.component_id, unnest([a.cve, a.ghsa]) as cve, 'UNKNOWN' as severity {_OS} where {_NUMS.format('c.version')} < {_NUMS.format('a.fixed')} or (c.version = a.fixed and c.component_id % 2 = 0)
""")
def os_match_alpine(t: Tables) -> DataFrame:
    """Installed releases of a fixed version are older in half of the cases."""
    packages, fixes = _os(t, lambda v: v)
    packages = packages.withColumn("installed", F.concat("installed", F.expr("if(component_id % 2 = 0, '-r9', '-r10')")))
    fixes = fixes.where("fixed is not null").select("release", "name", F.concat("fixed", F.lit("-r10")).alias("fixed"), F.array("cve", "ghsa").alias("cves"))
    return O.os_match_alpine(packages, fixes).select("component_id", "cve", "severity")


@query(f"""
    select c.component_id, a.cve, case when a.fixed is null then 'UNKNOWN' else ['HIGH', 'MEDIUM', 'LOW', 'UNKNOWN', 'HIGH'][a.advisory_key % 5 + 1] end as severity {_OS}
    where a.advisory_key % 7 > 0 and (a.fixed is null or (c.component_id % 4 = 0 and {_NUMS.format('c.version')} <= {_NUMS.format('a.fixed')}) or (c.component_id % 4 > 0 and {_NUMS.format('c.version')} < {_NUMS.format('a.fixed')}))
""")
def os_match_debian(t: Tables) -> DataFrame:
    """Every fourth installed version is a release candidate, before its release."""
    packages, fixes = _os(t, lambda v: F.concat(F.lit("1:"), v))
    packages = packages.withColumn("installed", F.concat("installed", F.expr("if(component_id % 4 = 0, '~rc1-1', '-2')")))
    packages = packages.withColumn("source", F.when(F.col("component_id") % 2 == 0, F.col("name"))).withColumn("name", F.when(F.col("component_id") % 2 == 0, F.lit("lib")).otherwise(F.col("name")))
    status = F.expr("case when key % 7 = 0 then 'resolved' when key % 2 = 0 then 'open' else 'undetermined' end")
    urgency = F.expr("case key % 5 when 0 then 'high' when 1 then 'medium' when 2 then 'low' when 4 then 'critical' end")
    fixes = fixes.select("release", F.col("name").alias("package"), "cve", status.alias("status"), urgency.alias("urgency"), F.concat("fixed", F.lit("-2")).alias("fixed"))
    return O.os_match_debian(packages, fixes).select("component_id", "cve", "severity")


@query("""
    select c.component_id, a.cve, a.fixed from components c join advisories a on a.name = c.name
    where a.advisory_key % 3 in (0, 1) and ((c.component_id % 4 = 0 and a.advisory_key % 2 = 0) or (c.component_id % 4 = 1 and a.advisory_key % 2 = 1))
""")
def os_match_ubuntu(t: Tables) -> DataFrame:
    version = F.expr("case component_id % 4 when 0 then '22.04' when 1 then '24.04' when 2 then '99.99' else '20.04' end")
    packages = t.components.select("component_id", "name", F.lit(None).cast("string").alias("source"), version.alias("version_id"))
    status = F.expr("case advisory_key % 3 when 0 then 'needed' when 1 then 'pending' else 'released' end")
    fixes = t.advisories.select(F.expr("if(advisory_key % 2 = 0, 'jammy', 'noble')").alias("release"), F.col("name").alias("package"), "cve", status.alias("status"), "fixed")
    return O.os_match_ubuntu(packages, fixes).select("component_id", "cve", "fixed")


@query(f"""
    select c.component_id, a.cve, case a.advisory_key % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'CRITICAL' end as severity, a.fixed || '-25.el7_9' as fixed from components c join advisories a on a.name = c.name
    where a.fixed is not null and ({_NUMS.format('c.version')} < {_NUMS.format('a.fixed')} or (c.version = a.fixed and c.component_id % 2 = 0))
""")
def os_match_redhat(t: Tables) -> DataFrame:
    installed = F.concat("version", F.expr("if(component_id % 2 = 0, '-9.el7_9', '-25.el7_9')"))
    severity = F.expr("case advisory_key % 3 when 0 then 'important' when 1 then 'moderate' else 'Critical' end")
    fixes = t.advisories.where("fixed is not null").select("cve", severity.alias("severity"), F.array(F.concat_ws("-", "name", "fixed", F.lit("25.el7_9")), F.lit("odd")).alias("affected"))
    return O.os_match_redhat(t.components.select("component_id", "name", installed.alias("installed")), fixes).select("component_id", "cve", "severity", "fixed")


@query("select image, layer, cve, tool, case when advisory % 4 = 0 then null else advisory % 3 = 0 end as reachable from (select image, layer, cve, tool, cast(substr(cve, 10) as bigint) as advisory from findings)")
def attach_reachability(t: Tables) -> DataFrame:
    """Half of the packages are known by their own names, half by names without scope and colon."""
    number = F.substring("cve", 10, 20).cast("long")
    rows = t.findings.select("image", "layer", "cve", "tool", F.concat(F.lit("@o:"), number.cast("string")).alias("package"))
    key = number  # of an advisory's CVE, as findings are known by
    name = F.when(key % 2 == 0, F.concat(F.lit("@o:"), key.cast("string"))).otherwise(F.concat(F.lit("o/"), key.cast("string")))
    known = t.advisories.where(key % 4 > 0).select(name.alias("package"), (key % 3 == 0).alias("reachable"))
    return O.attach_reachability(rows, known, []).select("image", "layer", "cve", "tool", "reachable")


@query("select component_id, component_id % 4 in (1, 2) or (component_id % 4 = 3 and component_id % 5 = 0) as reachable from components")
def package_reachable(t: Tables) -> DataFrame:
    n = F.col("component_id").cast("string")
    eco = F.expr("case component_id % 4 when 0 then 'npm' when 1 then 'npm' when 2 then 'Python' else 'Go' end")
    package = F.expr("case component_id % 4 when 2 then concat('py-', component_id) when 3 then concat('org/g', component_id) else concat('@s/n', component_id) end")
    ids = F.expr("""case component_id % 4 when 1 then concat('a/node_modules/@s/n', component_id, '/lib/x.js:run') when 2 then concat('app.py_', component_id, '.main')
        when 3 then if(component_id % 5 = 0, concat('github.com/org/g', component_id, '.Serve'), concat('github.com/xorg/g', component_id, '.Serve')) else concat('src/', component_id) end""")
    return O.package_reachable(t.components.select("component_id", eco.alias("ecosystem"), package.alias("package")), t.components.select(ids.alias("id"))).select("component_id", "reachable")


@query("select component_id, component_id % 7 in (0, 1, 2, 3) as entrypoint from components")
def mark_entrypoints(t: Tables) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("component_id") % 7 + 1).cast("int"))
    name, owner = pick("main", "doGet", "list", "find", "main", "doGet", "list"), pick("App", "MyServlet", "UserController", "UserService", "App", "Plain", "UserController")
    descriptor = pick("([Ljava/lang/String;)V", "()V", "()V", "()V", "()V", "()V", "()V")
    public = F.col("component_id") % 7 < 6
    return t.components.select("component_id", O.is_entrypoint(name, owner, descriptor, public, F.lit(True)).alias("entrypoint"))


@query("select distinct l_orderkey as project from lineitem where l_partkey % 11 = 0")
def requires_rescan(t: Tables) -> DataFrame:
    path = F.expr("case when l_partkey % 11 = 0 then concat('a/b', l_partkey, '/pom.xml') else concat('src/pom.xml/', l_partkey, '.java') end")
    return O.requires_rescan(t.lineitem.select(F.col("l_orderkey").alias("project"), path.alias("path")), "project")


@query("select ecosystem, count(*) as total, count_if(component_id % 3 = 0) as found from components group by 1")
def enrich_metadata(t: Tables) -> DataFrame:
    purl = F.concat(F.lit("pkg:x/"), F.col("component_id").cast("string")).alias("purl")
    rows = O.enrich_metadata(t.components.select(purl, "ecosystem"), t.components.where("component_id % 3 = 0").select(purl, "price"))
    return rows.groupBy("ecosystem").agg(F.count("*").alias("total"), F.count_if("found").alias("found"))


@query("""
    select image, layer, cve, tool, case when severity <> 'UNKNOWN' then severity when n % 3 = 0 then 'HIGH' when n % 3 = 1 then 'LOW' else 'UNKNOWN' end as severity
    from (select *, cast(substr(cve, 10) as bigint) % 2 + layer as m, cast(substr(cve, 10) as bigint) // 303 as n from findings)
""")
def fill_unknown_severity(t: Tables) -> DataFrame:
    number = F.substring("cve", 10, 20).cast("long")
    turn = F.floor(number / 303) % 3
    own = t.advisories.where(turn < 2).select(F.col("cve").alias("id"), F.when(turn == 0, "MEDIUM").otherwise("LOW").alias("severity"))
    distro = t.advisories.where(turn == 0).select(F.concat(F.lit("DSA-"), "cve").alias("id"), F.lit("HIGH").alias("severity"))
    return O.fill_unknown_severity(t.findings, own.unionByName(distro)).select("image", "layer", "cve", "tool", "severity")


@query("select component_id, case component_id % 4 when 0 then 'Apache-2.0' when 1 then 'BSD-2-Clause' when 2 then 'GPL-3.0-only' end as license from components")
def normalize_license(t: Tables) -> DataFrame:
    name = F.expr("case component_id % 4 when 0 then 'ASL 2.0' when 1 then 'Simplified BSD License' when 2 then 'GPLv3' else 'gplv3' end")
    return t.components.select("component_id", L.normalize_license(name).alias("license"))


@query("""
    select component_id, case when license like 'AGPL%' then 'StrongCopyleft' when license like 'GPL%' then 'Copyleft' when license is not null then 'Permissive' end as category,
           case when license is not null then true end as osi, license like '%GPL%' as copyleft from components
""")
def license_info(t: Tables) -> DataFrame:
    return t.components.select("component_id", L.license_info(F.col("license")).alias("i")).select("component_id", "i.category", "i.osi", "i.copyleft")


@query("""
    select component_id, case license when 'MIT' then 'Attribution,NoWarranty' when 'Apache-2.0' then 'Attribution,PatentGrant,NoticeFile,NoWarranty' when 'BSD-3-Clause' then 'Attribution,Trademark,NoWarranty'
        when 'GPL-3.0-only' then 'Disclosure,Attribution,Copyleft,PatentGrant,SourceCodeDistribution' when 'AGPL-3.0-only' then 'Disclosure,NetworkUse,Attribution,Copyleft,SourceCodeDistribution' else '' end as kinds,
        coalesce(license in ('GPL-3.0-only', 'AGPL-3.0-only'), false) as high from components
""")
def license_obligations(t: Tables) -> DataFrame:
    rows = t.components.select("component_id", L.license_obligations(F.col("license")).alias("o"))
    return rows.select("component_id", F.array_join("o.kind", ",").alias("kinds"), F.exists("o", lambda x: x["severity"] == "HIGH").alias("high"))


@query("""
    with d as (select pc.project, c.license from project_components pc join components c on c.component_id = pc.component_id),
    g as (select project, license, 'copyleft' as g, 'High' as risk from d where license like '%GPL%' union all select project, license, 'network copyleft', 'Critical' from d where license like 'AGPL%'
          union all select project, 'Unknown', 'unknown', 'High' from d where license is null)
    select project, g as "group", risk, count(*) as n, array_to_string(list_sort(list(distinct license)), ',') as licences from g group by 1, 2, 3
""")
def license_contamination(t: Tables) -> DataFrame:
    rows = L.license_contamination(t.project_components.join(t.components.select("component_id", "license"), "component_id"), "project")
    return rows.withColumn("licences", F.concat_ws(",", "licences"))
