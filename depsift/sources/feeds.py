"""Readers of advisory feeds, bills of materials, scanner reports and package lists.

Each parser takes a DataFrame with a text column `value`, one document (or line) a row, and keeps the other
columns beside what it finds. Null, empty and malformed texts give no rows. `read` applies one to files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.functions.severity import normalize_severity, severity_from_cvss
from depsift.plans.lineage import cut

NVD_PAGE = "https://nvd.nist.gov/vuln/detail/"


def _json(docs: DataFrame, schema: str, *rows: str) -> tuple[DataFrame, list[str]]:
    """The document as struct `j`, then one row for each element of the nested arrays named in turn."""
    keep = [c for c in docs.columns if c != "value"]
    out = docs.select(*keep, F.from_json("value", schema).alias("j"))
    for path in rows:
        out = out.select(*keep, F.explode(path).alias("j"))
    return out, keep


def _none_if(c: Column, *values: str) -> Column:
    return F.when(~c.isin(*values), c)


def epss(lines: DataFrame, order: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """cve, epss, percentile; comments, the header and rows without two numbers go; of one cve the last by `order`, in each feed that columns `by` tell apart."""
    parts = F.split("value", ",")
    number = lambda i: F.expr(f"try_cast(trim(get(split(value, ','), {i})) as double)")
    rows = lines.where("value not like '#%'").select(
        *by,
        F.trim(F.get(parts, 0)).alias("cve"), number(1).alias("epss"), number(2).alias("percentile"), F.col(order).alias("o")
    ).where("cve <> '' and epss is not null and percentile is not null")
    return rows.groupBy(*by, "cve").agg(F.max_by(F.struct("epss", "percentile"), "o").alias("v")).select(*by, "cve", "v.epss", "v.percentile")


def kev(docs: DataFrame) -> DataFrame:
    """One row per exploited vulnerability of the catalogue."""
    fields = ("cveID", "vendorProject", "product", "vulnerabilityName", "dateAdded", "requiredAction", "dueDate")
    rows, keep = _json(docs, f"vulnerabilities array<struct<{', '.join(f'{f}: string' for f in fields)}>>", "j.vulnerabilities")
    names = ("cve", "vendor_project", "product", "name", "date_added", "required_action", "due_date")
    return rows.select(*keep, *[F.col(f"j.{f}").alias(n) for f, n in zip(fields, names)])


OSV = """id string, modified string, published string, aliases array<string>, summary string, details string,
    affected array<struct<package: struct<ecosystem: string, name: string>,
        ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>>>,
    references array<struct<type: string, url: string>>, severity array<struct<type: string, score: string>>, database_specific struct<severity: string>"""


def osv(docs: DataFrame) -> DataFrame:
    """Canonical advisories: id, aliases, affected (ecosystem, name, ranges), scores, severity and texts.

    Events that only limit a range are dropped. Severity follows a numeric CVSS 3 score, else a numeric CVSS 4
    score, else the database's word.
    """
    rows, keep = _json(docs, OSV)
    score = lambda kind: F.expr(f"try_cast(get(filter(j.severity, s -> s.type = '{kind}'), 0).score as double)")
    affected = F.expr("""transform(j.affected, a -> named_struct('ecosystem', a.package.ecosystem, 'name', a.package.name, 'ranges',
        transform(a.ranges, r -> named_struct('type', r.type, 'events',
            filter(r.events, e -> coalesce(e.introduced, e.fixed, e.last_affected) is not null)))))""")
    v3, v4 = score("CVSS_V3"), score("CVSS_V4")
    level = F.when(F.coalesce(v3, v4).isNotNull(), severity_from_cvss(F.coalesce(v3, v4), 0.1)).otherwise(normalize_severity(F.col("j.database_specific.severity")))
    return rows.where("j.id is not null").select(
        *keep, F.col("j.id").alias("id"), "j.aliases", affected.alias("affected"), v3.alias("cvss_v3"), v4.alias("cvss_v4"),
        level.alias("severity"), "j.summary", "j.details", F.expr("transform(j.references, r -> r.url)").alias("references"), "j.published", "j.modified",
    )


def affected_packages(advisories: DataFrame) -> DataFrame:
    """(advisory, ecosystem, name, ranges) of canonical advisories, as matching takes them."""
    rows = advisories.select(F.col("id").alias("advisory"), F.explode("affected").alias("a"))
    return rows.select("advisory", "a.ecosystem", "a.name", "a.ranges")


def vex(docs: DataFrame) -> DataFrame:
    """A row per statement and product; a statement without products has a null product and holds for all."""
    rows, keep = _json(docs, """timestamp string, statements array<struct<vulnerability: struct<`@id`: string>,
        products: array<struct<`@id`: string>>, status: string, justification: string>>""")
    rows = rows.select(*keep, "j.timestamp", F.posexplode("j.statements").alias("position", "s"))
    rows = rows.select(*keep, "timestamp", "position", "s", F.explode_outer("s.products").alias("p"))
    return rows.select(*keep, "timestamp", "position", F.col("s.vulnerability.@id").alias("cve"), F.col("p.@id").alias("product"), "s.status", "s.justification")


def sbom_format(text: Column) -> Column:
    """SPDX, CycloneDX, or null for any other text."""
    return F.when(text.contains('"spdxVersion"'), "SPDX").when(text.contains('"bomFormat"'), "CycloneDX")


def spdx(docs: DataFrame) -> DataFrame:
    """Packages of SPDX documents: name, version, purl, ecosystem, license.

    Without a purl the package is taken for a Maven one and a purl is made; a licence concluded goes before
    one declared, and NOASSERTION and NONE are no licence.
    """
    rows, keep = _json(docs, """packages array<struct<name: string, versionInfo: string, licenseConcluded: string, licenseDeclared: string,
        externalRefs: array<struct<referenceType: string, referenceLocator: string>>>>""", "j.packages")
    made = F.concat(F.lit("pkg:maven/"), "j.name", F.coalesce(F.concat(F.lit("@"), "j.versionInfo"), F.lit("")))
    purl = F.coalesce(F.expr("get(filter(j.externalRefs, r -> r.referenceType = 'purl'), 0).referenceLocator"), made)
    eco = F.regexp_extract(purl, "^pkg:([^/]+)/", 1)
    licence = F.coalesce(*[_none_if(F.col(f"j.{x}"), "NOASSERTION", "NONE") for x in ("licenseConcluded", "licenseDeclared")])
    return rows.select(*keep, "j.name", F.col("j.versionInfo").alias("version"), purl.alias("purl"), F.when(eco == "", "maven").otherwise(eco).alias("ecosystem"), licence.alias("license"))


def cyclonedx(docs: DataFrame) -> DataFrame:
    """Components of CycloneDX documents: name, version, purl, license (id or name of the first)."""
    rows, keep = _json(docs, """components array<struct<name: string, version: string, purl: string,
        licenses: array<struct<license: struct<id: string, name: string>>>>>""", "j.components")
    first = F.expr("get(j.licenses, 0).license")
    return rows.select(*keep, "j.name", "j.version", "j.purl", F.coalesce(first["id"], first["name"]).alias("license"))


def sarif(docs: DataFrame) -> DataFrame:
    """A row per result: rule, level, message, properties."""
    rows, keep = _json(docs, """runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>,
        properties: map<string, string>>>>>""", "j.runs", "j.results")
    return rows.select(*keep, F.col("j.ruleId").alias("rule"), "j.level", F.col("j.message.text").alias("message"), "j.properties")


def audit_log(lines: DataFrame) -> DataFrame:
    """Entries of a JSON-lines audit log; lines that do not parse are skipped."""
    schema = """timestamp string, timestamp_unix long, action string, result string, violation_count long, warning_count long,
        policy_source string, context struct<metadata: map<string, string>>, _bad string"""
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.select(*keep, F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return rows.where("j is not null and j._bad is null").select(*keep, "j.*").drop("_bad")


def trivy(docs: DataFrame) -> DataFrame:
    """Findings of Trivy reports; references are the NVD page and the first two given."""
    rows, keep = _json(docs, """Results array<struct<Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string,
        FixedVersion: string, Severity: string, Title: string, CVSS: map<string, struct<V3Score: double>>, References: array<string>>>>>""", "j.Results", "j.Vulnerabilities")
    refs = F.concat(F.array(F.concat(F.lit(NVD_PAGE), "j.VulnerabilityID")), F.slice(F.coalesce("j.References", F.array().cast("array<string>")), 1, 2))
    return rows.select(
        *keep, F.col("j.VulnerabilityID").alias("cve"), F.col("j.PkgName").alias("package"), F.col("j.InstalledVersion").alias("installed"),
        F.col("j.FixedVersion").alias("fixed"), normalize_severity(F.col("j.Severity")).alias("severity"), F.expr("j.CVSS['nvd'].V3Score").alias("cvss"),
        F.col("j.Title").alias("title"), refs.alias("references"),
    )


def grype(docs: DataFrame) -> DataFrame:
    """Findings of Grype reports, with the first fixed version and the first score."""
    rows, keep = _json(docs, """matches array<struct<vulnerability: struct<id: string, severity: string, fix: struct<versions: array<string>>,
        cvss: array<struct<metrics: struct<baseScore: double>>>>, artifact: struct<name: string, version: string>>>""", "j.matches")
    return rows.select(
        *keep, F.col("j.vulnerability.id").alias("cve"), F.col("j.artifact.name").alias("package"), F.col("j.artifact.version").alias("installed"),
        F.expr("get(j.vulnerability.fix.versions, 0)").alias("fixed"), normalize_severity(F.col("j.vulnerability.severity")).alias("severity"),
        F.expr("get(j.vulnerability.cvss, 0).metrics.baseScore").alias("cvss"),
    )


#: Version operators in the order in which they are looked for (fixed values).
OPERATORS = ("===", "==", "~=", ">=", "<=", ">", "<", "!=")


def requirements(lines: DataFrame) -> DataFrame:
    """name, operator, version of requirement lines; options, comments and blanks go, a bare name has null for both."""
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.withColumn("t", F.trim(F.regexp_replace("value", "[;#].*$", ""))).where("t <> '' and not t rlike '^(-e|-r|--)'")
    op = F.lit(None).cast("string")
    for o in reversed(OPERATORS):
        op = F.when(F.contains("t", F.lit(o)), o).otherwise(op)
    rows = rows.withColumn("operator", op)
    name = F.coalesce(F.expr("substring(t, 1, locate(operator, t) - 1)"), "t")
    version = F.expr("substring(t, locate(operator, t) + length(operator))")
    return rows.select(*keep, F.trim(name).alias("name"), "operator", F.trim(version).alias("version"))


def go_mod(docs: DataFrame) -> DataFrame:
    """Required modules after replacements: namespace, name, version (without its leading v)."""
    keep = [c for c in docs.columns if c != "value"]

    def stated(word: str) -> Column:
        blocks = F.array_join(F.regexp_extract_all("t", F.lit(rf"(?m)^\s*{word}\s*\(([^)]*)\)"), 1), "\n")
        lines = F.array_join(F.regexp_extract_all("t", F.lit(rf"(?m)^\s*{word}[ \t]+([^\s(].*)$"), 1), "\n")
        return F.transform(F.split(F.concat(blocks, F.lit("\n"), lines), "\n"), lambda x: F.split(F.trim(x), r"\s+"))

    rows = docs.withColumn("t", F.translate(F.regexp_replace("value", "//[^\n]*", ""), "\t\r", "  ")).select(*keep, stated("require").alias("r"), stated("replace").alias("s"))
    rows = rows.select(*keep, "s", F.explode("r").alias("r")).where("size(r) >= 2")
    new = "get(filter(s, x -> x[0] = r[0] and array_contains(x, '=>')), 0)"
    rows = rows.withColumn("at", F.expr(f"array_position({new}, '=>')")).withColumn("new", F.expr(new))
    module = F.coalesce(F.expr("get(new, cast(at as int))"), F.expr("r[0]"))
    version = F.coalesce(F.expr("get(new, cast(at as int) + 1)"), F.expr("r[1]"))
    rows = rows.select(*keep, module.alias("module"), F.regexp_replace(version, "^v", "").alias("version"))
    space = F.regexp_extract("module", "^(.*)/[^/]*$", 1)
    return rows.select(*keep, F.when(space != "", space).alias("namespace"), F.substring_index("module", "/", -1).alias("name"), "version")


def workflow_actions(docs: DataFrame) -> DataFrame:
    """Actions used by workflows: namespace, name (with its path), version; images and local actions go."""
    keep = [c for c in docs.columns if c != "value"]
    used = F.regexp_extract_all(F.regexp_replace("value", "[\"']", ""), F.lit(r"uses:\s*(\S+)"), 1)
    rows = docs.select(*keep, F.explode(used).alias("u")).where("u not like 'docker://%' and u not like './%' and u like '%/%' and length(u) - length(replace(u, '@', '')) = 1")
    path = F.substring_index("u", "@", 1)
    return rows.select(*keep, F.substring_index(path, "/", 1).alias("namespace"), F.regexp_replace(path, "^[^/]*/", "").alias("name"), F.substring_index("u", "@", -1).alias("version"))


def os_packages(docs: DataFrame, kind: str) -> DataFrame:
    """name, version, architecture, source of an `apk` or `dpkg` database; dpkg keeps installed packages only."""
    keep = [c for c in docs.columns if c != "value"]
    rows = docs.select(*keep, F.explode(F.split("value", r"\n\s*\n")).alias("t"))
    field = lambda f: _none_if(F.trim(F.regexp_extract("t", rf"(?m)^{f}:[ \t]*(.*)$", 1)), "")
    if kind == "dpkg":
        rows = rows.where(F.col("t").rlike(r"(?m)^Status:.*\sinstalled\s*$"))
    names = ("P", "V", "A", "o") if kind == "apk" else ("Package", "Version", "Architecture", "Source")
    source = F.lit(None).cast("string") if kind == "apk" else F.substring_index(field(names[3]), " ", 1)
    return rows.select(*keep, field(names[0]).alias("name"), field(names[1]).alias("version"), field(names[2]).alias("architecture"), source.alias("source")).where("name is not null and version is not null")


def alpine_secdb(docs: DataFrame) -> DataFrame:
    """package, fixed_version, cve of a security database; only ids of CVEs."""
    rows, keep = _json(docs, "packages array<struct<pkg: struct<name: string, secfixes: map<string, array<string>>>>>", "j.packages")
    rows = rows.select(*keep, F.col("j.pkg.name").alias("package"), F.explode("j.pkg.secfixes").alias("fixed_version", "ids"))
    return rows.select(*keep, "package", "fixed_version", F.explode("ids").alias("cve")).where("cve like 'CVE-%'")


def debian_tracker(docs: DataFrame) -> DataFrame:
    """cve, package, release, status, urgency, fixed_version of a tracker's nested maps."""
    keep = [c for c in docs.columns if c != "value"]
    schema = "map<string, map<string, struct<releases: map<string, struct<status: string, urgency: string, fixed_version: string>>>>>"
    rows = docs.select(*keep, F.explode(F.from_json("value", schema)).alias("package", "c"))
    rows = rows.select(*keep, "package", F.explode("c").alias("cve", "r")).select(*keep, "package", "cve", F.explode("r.releases").alias("release", "v"))
    return rows.select(*keep, "cve", "package", "release", "v.status", "v.urgency", "v.fixed_version")


def package_lock(docs: DataFrame) -> DataFrame:
    """namespace (scope), name, version, dependencies of an npm lock file's packages; the root is skipped."""
    keep = [c for c in docs.columns if c != "value"]
    parsed = F.from_json("value", "packages map<string, struct<version: string, dependencies: map<string, string>>>")
    rows = docs.select(*keep, F.explode(parsed["packages"]).alias("path", "p")).where("path <> ''")
    rows = rows.withColumn("path", F.regexp_replace("path", "^node_modules/", ""))
    scope = F.when(F.col("path").rlike("^@[^/]+/"), F.substring_index("path", "/", 1))
    name = F.when(scope.isNull(), F.col("path")).otherwise(F.regexp_replace("path", "^@[^/]+/", ""))
    return rows.select(*keep, scope.alias("namespace"), name.alias("name"), "p.version", F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")).alias("dependencies"))


NVD = """vulnerabilities array<struct<cve: struct<id: string, published: string, lastModified: string, descriptions: array<struct<lang: string, value: string>>,
    metrics: struct<cvssMetricV31: array<struct<cvssData: struct<baseScore: double>>>, cvssMetricV40: array<struct<cvssData: struct<baseScore: double>>>,
        cvssMetricV30: array<struct<cvssData: struct<baseScore: double>>>, cvssMetricV2: array<struct<cvssData: struct<baseScore: double>>>>,
    references: array<struct<url: string, tags: array<string>>>,
    configurations: array<struct<nodes: array<struct<cpeMatch: array<struct<vulnerable: boolean, criteria: string, versionStartIncluding: string,
        versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string>>>>>>>>>"""


def nvd(docs: DataFrame) -> DataFrame:
    """Canonical advisories of NVD documents, as `osv` gives them.

    The English description counts, else the first. Scores are taken in the order 3.1, 4.0, 3.0, 2; one of version 2
    stands in cvss_v3. Vulnerable products with a bound become packages vendor:product of the ecosystem CPE; an
    excluded start counts as introduced.
    """
    rows, keep = _json(docs, NVD, "j.vulnerabilities")
    rows = rows.select(*keep, F.col("j.cve").alias("c")).where("c.id is not null")
    score = lambda v: F.expr(f"get(c.metrics.cvssMetric{v}, 0).cvssData.baseScore")
    new, old = score("V31"), F.coalesce(score("V30"), score("V2"))
    v4 = F.when(new.isNull(), score("V40"))
    v3 = F.coalesce(new, F.when(v4.isNull(), old))
    event = "named_struct('introduced', {0}, 'fixed', {1}, 'last_affected', {2})"
    none = "cast(null as string)"
    start = "coalesce(m.versionStartIncluding, m.versionStartExcluding)"
    end = "if(m.versionEndExcluding is null, m.versionEndIncluding, null)"
    events = f"""array_compact(array(if({start} is null, null, {event.format(start, none, none)}),
        if(m.versionEndExcluding is null and m.versionEndIncluding is null, null, {event.format(none, 'm.versionEndExcluding', end)})))"""
    matches = "flatten(flatten(transform(c.configurations, x -> transform(x.nodes, n -> coalesce(n.cpeMatch, array())))))"
    affected = F.expr(f"""filter(transform(filter({matches}, m -> m.vulnerable and size(split(m.criteria, ':')) >= 5), m -> named_struct('ecosystem', 'CPE',
        'name', concat(split(m.criteria, ':')[3], ':', split(m.criteria, ':')[4]), 'ranges', array(named_struct('type', 'ECOSYSTEM', 'events', {events})))), a -> size(a.ranges[0].events) > 0)""")
    text = F.expr("coalesce(get(filter(c.descriptions, d -> d.lang = 'en'), 0), get(c.descriptions, 0)).value")
    level = F.when(F.coalesce(v3, v4).isNotNull(), severity_from_cvss(F.coalesce(v3, v4), 0.1))
    return rows.select(
        *keep, F.col("c.id").alias("id"), F.array().cast("array<string>").alias("aliases"), F.coalesce(affected, F.expr(f"filter({_NO_PACKAGES}, a -> false)")).alias("affected"),
        v3.alias("cvss_v3"), v4.alias("cvss_v4"), level.alias("severity"), F.lit(None).cast("string").alias("summary"), text.alias("details"),
        F.expr("transform(c.references, r -> r.url)").alias("references"), F.col("c.published").alias("published"), F.col("c.lastModified").alias("modified"),
    )


_NO_PACKAGES = """array(named_struct('ecosystem', '', 'name', '', 'ranges', array(named_struct('type', '', 'events',
    array(named_struct('introduced', cast(null as string), 'fixed', cast(null as string), 'last_affected', cast(null as string)))))))"""

GHSA = """id string, ghsaId string, summary string, description string, severity string, publishedAt string, updatedAt string,
    identifiers array<struct<type: string, value: string>>, references array<struct<url: string>>, cvss struct<score: double, vectorString: string>,
    vulnerabilities array<struct<package: struct<ecosystem: string, name: string>, vulnerableVersionRange: string, firstPatchedVersion: struct<identifier: string>>>"""


def ghsa(docs: DataFrame) -> DataFrame:
    """Canonical advisories of GHSA documents, as `osv` gives them.

    Aliases are identifiers of type CVE; a score goes before the word of severity. A range with >= in it or < in front,
    and no range at all, begin at 0: the lower bound is not read. The first patched version ends it.
    """
    rows, keep = _json(docs, GHSA)
    none = "cast(null as string)"
    begins = "v.vulnerableVersionRange is null or contains(v.vulnerableVersionRange, '>=') or startswith(v.vulnerableVersionRange, '<')"
    events = f"""array_compact(array(if({begins}, named_struct('introduced', '0', 'fixed', {none}, 'last_affected', {none}), null),
        if(v.firstPatchedVersion.identifier is null, null, named_struct('introduced', {none}, 'fixed', v.firstPatchedVersion.identifier, 'last_affected', {none}))))"""
    affected = F.expr(f"""transform(j.vulnerabilities, v -> named_struct('ecosystem', v.package.ecosystem, 'name', v.package.name, 'ranges',
        filter(array(named_struct('type', 'ECOSYSTEM', 'events', {events})), r -> size(r.events) > 0)))""")
    score = F.col("j.cvss.score")
    level = F.when(score.isNotNull(), severity_from_cvss(score, 0.1)).when(F.col("j.severity").isNotNull(), normalize_severity(F.col("j.severity")))
    return rows.where("coalesce(j.ghsaId, j.id) is not null").select(
        *keep, F.expr("coalesce(j.ghsaId, j.id)").alias("id"), F.expr("transform(filter(j.identifiers, i -> i.type = 'CVE'), i -> i.value)").alias("aliases"), affected.alias("affected"),
        score.alias("cvss_v3"), F.lit(None).cast("double").alias("cvss_v4"), level.alias("severity"), "j.summary", F.col("j.description").alias("details"),
        F.expr("transform(j.references, r -> r.url)").alias("references"), F.col("j.publishedAt").alias("published"), F.col("j.updatedAt").alias("modified"),
    )


THREAT = "id string, package string, affected_versions array<string>, threat_type string, severity string, description string, references array<string>, discovered string"
THREAT_NAMES = ("id", "package", "affected_versions", "threat_type", "severity", "description", "references", "discovered")


def threat_feed(docs: DataFrame, form: str = "json") -> DataFrame:
    """Entries of a custom threat feed: a JSON array, CSV lines, or OSV advisories (an entry per package).

    CSV lines have the columns id, package, versions, type, severity, description, references, discovered; versions and
    references are parted by ;. The header and lines without a package go.
    """
    keep = [c for c in docs.columns if c != "value"]
    if form == "json":
        rows = docs.select(*keep, F.explode(F.from_json("value", f"array<struct<{THREAT.replace(' string', ': string').replace(' array', ': array')}>>")).alias("j"))
        return rows.select(*keep, "j.*").where("package is not null")
    if form == "csv":
        line = ", ".join(f"{n} string" for n in THREAT_NAMES)
        rows = docs.select(*keep, F.from_csv("value", line).alias("j")).select(*keep, "j.*").where("package is not null and package <> '' and id <> 'id'")
        listed = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
        for c in ("affected_versions", "references"):
            rows = rows.withColumn(c, F.coalesce(listed(c), F.array().cast("array<string>")))
        return rows
    rows = osv(docs)
    fixes = F.expr("flatten(transform(a.ranges, r -> filter(transform(r.events, e -> e.introduced), x -> x is not null)))")
    rows = rows.select(*keep, "id", F.explode("affected").alias("a"), "severity", F.coalesce("summary", "details").alias("description"), "references", F.col("published").alias("discovered"))
    return rows.select(*keep, "id", F.col("a.name").alias("package"), fixes.alias("affected_versions"), F.lit("advisory").alias("threat_type"), "severity", "description", "references", "discovered")


SYFT = """artifacts array<struct<id: string, name: string, version: string, type: string, purl: string, locations: array<struct<path: string, layerID: string>>>>,
    artifactRelationships array<struct<parent: string, child: string, type: string>>"""


def syft(docs: DataFrame) -> DataFrame:
    """Packages of Syft reports, a row per package and layer: id, name, version, kind, purl, layer (null: none told)."""
    rows, keep = _json(docs, SYFT, "j.artifacts")
    layers = F.array_distinct(F.filter(F.transform("j.locations", lambda x: x["layerID"]), lambda x: x.isNotNull()))
    rows = rows.select(*keep, "j", F.explode_outer(layers).alias("layer"))
    return rows.select(*keep, "j.id", "j.name", "j.version", F.col("j.type").alias("kind"), "j.purl", "layer")


def syft_edges(docs: DataFrame) -> DataFrame:
    """(src, dst) by name of Syft's relationships `dependency-of` and `contains`, from parent to child."""
    rows, keep = _json(docs, SYFT)
    names = F.map_from_entries(F.expr("array_distinct(transform(j.artifacts, a -> named_struct('k', a.id, 'v', a.name)))"))
    rows = rows.withColumn("names", names).select(*keep, "names", F.explode("j.artifactRelationships").alias("r")).where("r.type in ('dependency-of', 'contains')")
    ends = rows.select(*keep, *[F.element_at("names", F.col(f"r.{c}")).alias(n) for c, n in (("parent", "src"), ("child", "dst"))])
    return ends.where("src is not null and dst is not null")


def secrets(lines: DataFrame) -> DataFrame:
    """Secrets that TruffleHog reports, a JSON line each: kind, severity (verified ones Critical), file, line, layer, description (20 characters)."""
    keep = [c for c in lines.columns if c != "value"]
    schema = "DetectorName string, DetectorType string, Verified boolean, Raw string, SourceMetadata struct<file: string, line: long, layer: string>"
    rows = lines.select(*keep, F.from_json("value", schema).alias("j")).where("j.DetectorName is not null")
    raw = F.col("j.Raw")
    shown = F.concat(F.substring(raw, 1, 20), F.when(F.length(raw) > 20, "...").otherwise(""))
    return rows.select(
        *keep, F.col("j.DetectorName").alias("kind"), F.col("j.DetectorType").alias("rule"), F.when(F.col("j.Verified"), "CRITICAL").otherwise("HIGH").alias("severity"),
        F.coalesce("j.SourceMetadata.file", F.lit("")).alias("file"), "j.SourceMetadata.line", "j.SourceMetadata.layer", shown.alias("description"),
    )


def layer_efficiency(docs: DataFrame) -> DataFrame:
    """Layers of Dive reports with their image's figures: score, image_bytes, wasted_bytes, position, digest, bytes, command."""
    rows, keep = _json(docs, """image struct<efficiencyScore: double, sizeBytes: long, inefficientBytes: long>,
        layer array<struct<digestId: string, sizeBytes: long, command: string>>""")
    rows = rows.select(*keep, "j.image", F.posexplode("j.layer").alias("position", "l"))
    return rows.select(
        *keep, F.col("image.efficiencyScore").alias("score"), F.col("image.sizeBytes").alias("image_bytes"), F.col("image.inefficientBytes").alias("wasted_bytes"), "position",
        F.col("l.digestId").alias("digest"), F.col("l.sizeBytes").alias("bytes"), "l.command",
    )


MAVEN_INSTALL = "artifacts map<string, struct<version: string, shasums: struct<jar: string>>>, dependencies map<string, array<string>>, repositories map<string, array<string>>"


def _maven_artifacts(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Parsed files, each under a number `doc`, and a row (doc, key, a) for each artifact; maps are never repeated beside their entries."""
    rows, keep = _json(cut(docs.withColumn("doc", F.monotonically_increasing_id())), MAVEN_INSTALL)
    return rows, rows.select(*keep, F.posexplode("j.artifacts").alias("at", "key", "a")), keep


def _first(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The first value, by `at`, of each key of a file."""
    return rows.groupBy("doc", "key").agg(F.min_by(value, "at").alias(name))


def maven_install(docs: DataFrame) -> DataFrame:
    """Components of maven_install.json: coordinates (group:artifact:version), group, name, version, sha256, repository.

    Artifacts without a version or a colon are skipped; the repository is the first that lists the artifact.
    """
    files, found, keep = _maven_artifacts(docs)
    listed = files.select("doc", F.posexplode("j.repositories").alias("at", "repository", "keys")).select("doc", "at", "repository", F.explode("keys").alias("key"))
    rows = found.where("a.version <> '' and key like '%:%'").join(_first(listed, F.col("repository"), "repository"), ["doc", "key"], "left")
    parts = F.split("key", ":")
    return rows.select(
        *[c for c in keep if c != "doc"], F.concat_ws(":", parts[0], parts[1], "a.version").alias("coordinates"), parts[0].alias("group"), parts[1].alias("name"), "a.version",
        F.col("a.shasums.jar").alias("sha256"), "repository",
    )


def maven_install_edges(docs: DataFrame) -> DataFrame:
    """(src, dst) of full coordinates that depend on each other; ends that the file does not hold go."""
    files, found, keep = _maven_artifacts(docs)
    versions = _first(found, F.col("a.version"), "version").where("version is not null").withColumnRenamed("key", "to")
    told = _first(files.select("doc", F.posexplode("j.dependencies").alias("at", "key", "to")), F.col("to"), "to")
    src = F.concat_ws(":", F.substring_index("key", ":", 2), "a.version")
    rows = found.where("a.version <> '' and key like '%:%'").select(*keep, "key", src.alias("src"))
    full = told.select("doc", F.col("key").alias("src"), F.col("to").alias("full"))
    rows = rows.join(full, ["doc", "src"], "left").join(told, ["doc", "key"], "left").select(*keep, "src", F.explode(F.coalesce("full", "to")).alias("to"))
    return rows.join(versions, ["doc", "to"]).select(*[c for c in keep if c != "doc"], "src", F.concat_ws(":", "to", "version").alias("dst"))


#: Parsers of line formats; all others take whole documents.
LINES = {"epss": epss, "audit_log": audit_log, "requirements": requirements, "secrets": secrets}
WHOLE = {f.__name__: f for f in (kev, osv, vex, spdx, cyclonedx, sarif, trivy, grype, go_mod, workflow_actions, alpine_secdb, debian_tracker, package_lock, nvd, ghsa, threat_feed, syft, syft_edges, layer_efficiency, maven_install, maven_install_edges)}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Parse the files under `path`, compressed ones included; whole documents carry their `file`."""
    if kind in ("apk", "dpkg"):
        return os_packages(_whole(spark, path), kind)
    if kind in WHOLE:
        return WHOLE[kind](_whole(spark, path))
    lines = spark.read.text(path)
    if kind == "epss":
        lines = lines.select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("pos"))
    return LINES[kind](lines)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
