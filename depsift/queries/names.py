"""Queries on package names, URLs and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.functions import names as N
from depsift.operators import match
from depsift.queries.registry import Tables, query

_C = lambda *names: [F.col(n) for n in names]

_TYPE = """case ecosystem when 'npm' then 'npm' when 'Python' then 'pypi' when 'Go' then 'golang' when 'Rust' then 'cargo' when 'Ruby' then 'gem'
    when 'PHP' then 'composer' when 'Maven' then 'maven' when 'Gradle' then 'maven' else ecosystem end"""
_REGISTRY = "(namespace = 'crates.io' or namespace = 'rubygems.org' or namespace like 'packagist.org%')"
_PURL = f"""'pkg:' || {_TYPE} || '/' || case when namespace is null or {_REGISTRY} then name
    when ecosystem in ('Maven', 'Gradle') and contains(name, ':') then namespace || '/' || split_part(name, ':', 2) else namespace || '/' || name end || '@' || version"""


@query(f"select package_id, {_PURL} as purl from packages")
def purl(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.package_url(*_C("ecosystem", "namespace", "name", "version")).alias("purl"))


@query(f"""
    select package_id, case when package_id % 10 > 0 then {_TYPE} end as system,
           case when package_id % 10 > 0 then regexp_extract({_PURL}, '^pkg:[^/]*/(.*)@', 1) end as name, case when package_id % 10 > 0 then version end as version from packages
""")
def parse_purl(t: Tables) -> DataFrame:
    """Every tenth has no version and is no package URL here."""
    url = N.package_url(*_C("ecosystem", "namespace", "name", "version"))
    asked = F.when(F.col("package_id") % 10 == 0, F.substring_index(url, "@", 1)).otherwise(url)
    scoped = F.col("namespace").startswith("@") & (F.col("package_id") % 10 > 0)  # a scope holds an @ itself
    rows = t.packages.select("package_id", F.when(scoped, F.replace(asked, F.lit("/@"), F.lit("/%40"))).otherwise(asked).alias("u"))
    rows = rows.select("package_id", N.parse_purl(F.col("u")).alias("p")).select("package_id", "p.*")
    return rows.withColumn("name", F.replace("name", F.lit("%40"), F.lit("@")))


_MAVEN = """case when namespace is not null then 'https://repo1.maven.org/maven2/' || replace(namespace, '.', '/') || '/' || name || '/' || version || '/' || name || '-' || version
    when contains(name, ':') then 'https://repo1.maven.org/maven2/' || replace(split_part(name, ':', 1), '.', '/') || '/' || split_part(name, ':', 2) || '/' || version || '/' || split_part(name, ':', 2) || '-' || version end"""
_SCOPED = "case when namespace is null then name else namespace || '/' || name end"


@query(f"""
    select package_id, case ecosystem when 'Maven' then {_MAVEN} || '.jar' when 'npm' then 'https://registry.npmjs.org/' || {_SCOPED} || '/-/' || name || '-' || version || '.tgz'
        when 'Python' then 'https://pypi.org/project/' || name || '/' || version || '/' when 'Rust' then 'https://crates.io/crates/' || name || '/' || version
        when 'Go' then 'https://proxy.golang.org/' || {_SCOPED} || '/@v/' || version || '.zip' when 'Ruby' then 'https://rubygems.org/gems/' || name || '/versions/' || version
        when 'PHP' then case when namespace is not null then 'https://packagist.org/packages/' || namespace || '/' || name || '#' || version end end as url from packages
""")
def download_url(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.download_url(*_C("ecosystem", "namespace", "name", "version")).alias("url"))


@query(f"""
    select package_id, case ecosystem when 'Maven' then {_MAVEN} || '.jar.sha256' when 'npm' then 'https://registry.npmjs.org/' || {_SCOPED} || '/' || version
        when 'Python' then 'https://pypi.org/pypi/' || name || '/' || version || '/json' when 'Rust' then 'https://crates.io/api/v1/crates/' || name || '/' || version
        when 'Go' then 'https://proxy.golang.org/' || {_SCOPED} || '/@v/' || version || '.info' when 'Ruby' then 'https://rubygems.org/api/v1/versions/' || name || '.json'
        when 'PHP' then case when namespace is not null then 'https://repo.packagist.org/p2/' || namespace || '/' || name || '.json' end end as url from packages
""")
def checksum_url(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.checksum_url(*_C("ecosystem", "namespace", "name", "version")).alias("url"))


_OSV = """case ecosystem when 'Python' then 'PyPI' when 'Rust' then 'crates.io' when 'Ruby' then 'RubyGems' when 'PHP' then 'Packagist' when 'Gradle' then 'Maven' else ecosystem end"""
_OSV_NAME = "case when namespace is null or ecosystem in ('Maven', 'Gradle') or contains(namespace, '.') then name else namespace || '/' || name end"


@query(f"select package_id, {_OSV} as ecosystem from packages")
def osv_ecosystem(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.osv_ecosystem(F.col("ecosystem")).alias("ecosystem"))


@query(f"select package_id, {_OSV_NAME} as name from packages")
def osv_name(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.osv_name(*_C("ecosystem", "namespace", "name")).alias("name"))


@query(f"""
    with asked as (select package_id, {_OSV} as ecosystem, {_OSV_NAME} as name from packages)
    select p.package_id, case when a.advisory_key % 2 = 0 then a.cve else a.ghsa end as id,
           case when a.advisory_key % 5 = 0 then 'MEDIUM' when a.cvss >= 9 then 'CRITICAL' when a.cvss >= 7 then 'HIGH' when a.cvss >= 4 then 'MEDIUM' else 'LOW' end as severity, a.fixed
    from asked p join advisories a on a.ecosystem = p.ecosystem and a.name = p.name
""")
def batch_lookup(t: Tables) -> DataFrame:
    key, none = F.col("advisory_key"), F.lit(None).cast("string")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"))
    affected = F.array(F.array(event(F.col("introduced"), none), event(none, F.col("fixed"))))
    advisories = t.advisories.select(
        F.col("ghsa").alias("id"), F.when(key % 2 == 0, F.array(F.lit("X-1"), "cve")).otherwise(F.array(F.lit("X-1"))).alias("aliases"), "ecosystem", "name",
        affected.alias("ranges"), F.when(key % 5 > 0, F.col("cvss").cast("string")).alias("score"),
    )
    return match.batch_lookup(t.packages, advisories).select("package_id", "id", "severity", "fixed")


@query("""
    select package_id, case package_id % 8 when 0 then 'Maven' when 1 then 'Maven' when 2 then 'Go' when 3 then 'npm' when 4 then 'RubyGems' when 5 then 'Packagist' when 6 then 'PyPI' else 'npm' end as ecosystem,
           case package_id % 8 when 0 then 1.0 when 2 then 0.95 when 3 then 0.9 when 5 then 0.8 when 4 then 0.6 when 6 then 0.6 else 0.5 end::double as confidence from packages
""")
def detect_ecosystem(t: Tables) -> DataFrame:
    word = F.expr("concat('w', cast(package_id as string))")
    name = F.expr("""case package_id % 8 when 0 then concat('org.x:w', package_id) when 1 then concat('com.w', package_id) when 2 then concat('github.com/o/w', package_id)
        when 3 then concat('@s/w', package_id) when 4 then concat('w', package_id, '-rails') when 5 then 'symfony/console' when 6 then concat('w-', package_id) end""")
    rows = t.packages.select("package_id", F.coalesce(name, word).alias("n"))
    return rows.select("package_id", N.detect_ecosystem(F.col("n")).alias("ecosystem"), N.detection_confidence(F.col("n")).alias("confidence"))


@query("select package_id, array_to_string(list_transform(string_split(name || '_ ' || version, ''), lambda c: case when regexp_matches(c, '[\\p{L}\\p{N}.-]') then c else '-' end), '') as id from packages")
def spdx_id(t: Tables) -> DataFrame:
    return t.packages.select("package_id", N.spdx_id(F.concat("name", F.lit("_ "), "version")).alias("id"))


@query("""
    select component_id, component_id % 5 in (0, 1, 2) as jvm, component_id % 5 in (1, 2) or (component_id % 5 = 4 and component_id % 2 = 0) as entrypoint from components
""")
def bazel_rule_class(t: Tables) -> DataFrame:
    kind = F.expr("case component_id % 5 when 0 then 'kt_jvm_library' when 1 then 'java_binary' when 2 then 'scala_test' when 3 then 'py_library' end")
    target = F.concat(F.lit("//app:"), "name", F.expr("if(component_id % 2 = 0, '_test', '_lib')"))
    return t.components.select("component_id", N.bazel_rule_class(kind, target).alias("c")).select("component_id", "c.*")


_COMMAND = """case l_linenumber % 6 when 0 then concat('COPY a', cast(l_partkey as string)) when 1 then 'RUN apt-get install java' when 2 then 'RUN apk add curl' when 3 then 'ENV java'
    when 4 then 'ADD java /yum' else 'RUN fedora busybox' end"""


@query("""
    select l_orderkey as image, l_linenumber as layer, case l_linenumber % 6 when 0 then 'Application files' when 1 then 'Java runtime' when 2 then 'Base OS packages' when 3 then 'Configuration'
        when 4 then 'Application files' else 'Base OS packages' end as kind from lineitem
""")
def layer_kind(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer"), N.layer_kind(F.expr(_COMMAND)).alias("kind"))


@query("""
    select l_orderkey as image, l_linenumber as layer, case l_linenumber % 6 when 1 then 'debian' when 2 then 'alpine' when 4 then 'centos/rhel' when 5 then 'fedora' end as base from lineitem
""")
def base_image(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer"), N.base_image(F.expr(_COMMAND)).alias("base"))


@query("select package_id, package_id % 7 in (0, 1, 2) as suspicious from packages")
def confusion_version(t: Tables) -> DataFrame:
    v = F.expr("case package_id % 7 when 0 then '1000.1.0' when 1 then '1.9990.2' when 2 then '20240101120000.1' when 3 then '998.99.1' when 4 then 'v2' else version end")
    return t.packages.select("package_id", N.confusion_version(v).alias("suspicious"))


@query("""
    select package_id, case package_id % 6 when 0 then 'Medium' when 1 then 'Medium,Low' when 2 then 'Medium' when 3 then 'Low' else '' end as levels from packages
""")
def suspicious_version_name(t: Tables) -> DataFrame:
    version = F.expr("case package_id % 6 when 0 then '1.2.3-aaaaaaaaaaaaaaaaaaaaaaa' when 1 then '1.2 3' when 2 then '1.2_3' else version end")
    name = F.expr("case when package_id % 6 in (1, 3) then 'pkg-backdoor' else 'plain' end")
    return t.packages.select("package_id", F.array_join(N.suspicious_version_name(name, version), ",").alias("levels"))


@query("select package_id, case package_id % 5 when 0 then 'Critical' when 1 then 'High' when 2 then 'Critical,High' else '' end as levels from packages")
def name_threats(t: Tables) -> DataFrame:
    name = F.expr("case package_id % 5 when 0 then 'My-Trojan' when 1 then 'internal-x' when 2 then 'company-backdoor' when 3 then 'x-private-y' else 'Internal-z' end")
    return t.packages.select("package_id", F.array_join(N.name_threats(name), ",").alias("levels"))
