"""Texts to write: bills of materials, reports, graphs and snapshots, as a column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.names import named, short_purl, spdx_id

#: Level of a result by priority (fixed values).
LEVELS = {"P0": "error", "P1": "error", "P2": "warning", "P3": "note", "P4": "note"}
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def _documents(rows: DataFrame, key: str, item: Column, wrap) -> DataFrame:
    """One JSON text per key; a document is one row, since a bill of materials is one file."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).select(key, F.to_json(wrap(F.col("items"))).alias("value"))


def cyclonedx(components: DataFrame, key: str = "project") -> DataFrame:
    """CycloneDX documents of (key, ecosystem, name, version, license), with hashes and distribution links where there are
    columns sha256 and url."""
    none = F.array().cast("array<struct<license: struct<id: string>>>")
    licences = F.when(F.col("license").isNull(), none).otherwise(F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    more = []
    if "sha256" in components.columns:
        more.append(F.when(F.col("sha256").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content")))).alias("hashes"))
    if "url" in components.columns:
        more.append(F.when(F.col("url").isNotNull(), F.array(F.struct(F.lit("distribution").alias("type"), "url"))).alias("externalReferences"))
    item = F.struct(F.lit("library").alias("type"), "name", "version", short_purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), licences.alias("licenses"), *more)
    return _documents(components, key, item, lambda x: F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), x.alias("components")))


def spdx_ref() -> Column:
    """Identifier of a package in SPDX documents."""
    return F.concat(F.lit("SPDXRef-"), spdx_id(F.concat_ws("-", "ecosystem", "name", "version")))


def spdx_package() -> Column:
    link = short_purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), link.alias("referenceLocator"))
    licence = F.coalesce("license", F.lit("NOASSERTION"))
    return F.struct(
        spdx_ref().alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"),
        licence.alias("licenseConcluded"), licence.alias("licenseDeclared"), F.array(ref).alias("externalRefs"),
    )


def spdx(components: DataFrame, key: str = "project", edges: DataFrame | None = None) -> DataFrame:
    """SPDX documents of (key, ecosystem, name, version, license), each describing its packages.

    edges has (key, src, dst) of identifiers as `spdx_ref` makes them: those whose both ends resolve become DEPENDS_ON.
    """
    link = lambda a, kind, b: F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    docs = components.groupBy(key).agg(F.array_sort(F.collect_list(spdx_package())).alias("items"))
    links = F.transform("items", lambda p: link(F.lit("SPDXRef-DOCUMENT"), "DESCRIBES", p["SPDXID"]))
    if edges is not None:
        ordered = F.array_sort(F.collect_list(link(F.col("src"), "DEPENDS_ON", F.col("dst"))))
        docs = docs.join(edges.groupBy(key).agg(ordered.alias("more")), key, "left")
        links = F.concat(links, F.coalesce("more", F.filter(links, lambda x: F.lit(False))))
    return docs.select(key, F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.col("items").alias("packages"), links.alias("relationships"))).alias("value"))


def spdx_of_components(components: DataFrame, key: str = "project") -> DataFrame:
    """`spdx` of rows (key, component_id, ecosystem, name, version, license, dsts): dsts are the components that this one depends on, null for none.

    Rows are dealt by key once, while they are narrow; texts are made behind that, where a document is written. There a row stands at its own
    component and at each of its dsts, so both ends of an edge meet by grouping a key's rows, without a join. Repeated rows count once, and
    ends that the key doesn't have are left out.
    """
    link = lambda a, kind, b: F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    package = F.struct("ecosystem", "name", "version", "license")
    stands = F.concat(F.array("component_id"), F.coalesce("dsts", F.array().cast(components.schema["dsts"].dataType)))
    rows = components.repartition(key).select(key, spdx_ref().alias("ref"), package.alias("package"), F.posexplode(stands).alias("end", "at"))
    met = rows.groupBy(key, "at").agg(
        F.collect_set(F.when(F.col("end") == 0, F.struct("ref", "package"))).alias("own"), F.collect_set(F.when(F.col("end") > 0, F.col("ref"))).alias("by")
    )
    met = met.select(key, "by", F.explode("own").alias("own")).select(key, "own.*", F.explode_outer("by").alias("by"))
    each = met.select(key, "package.*", F.when(F.col("by").isNotNull(), link(F.col("by"), "DEPENDS_ON", F.col("ref"))).alias("link"))
    docs = each.groupBy(key).agg(F.collect_set(F.struct(spdx_package().alias("p"), "license")).alias("items"), F.array_sort(F.collect_set("link")).alias("more"))
    docs = docs.select(key, F.transform(F.array_sort("items"), lambda x: x["p"]).alias("items"), "more")
    links = F.concat(F.transform("items", lambda p: link(F.lit("SPDXRef-DOCUMENT"), "DESCRIBES", p["SPDXID"])), "more")
    return docs.select(key, F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.col("items").alias("packages"), links.alias("relationships"))).alias("value"))


def spdx_tag_values(components: DataFrame) -> DataFrame:
    """The tag-value block of each package, beside the input's columns."""
    rows = components.withColumn("p", spdx_package())
    tags = (("PackageName", "name"), ("SPDXID", "SPDXID"), ("PackageVersion", "versionInfo"), ("PackageDownloadLocation", "downloadLocation"), ("PackageLicenseConcluded", "licenseConcluded"), ("PackageLicenseDeclared", "licenseDeclared"))
    lines = [F.concat(F.lit(f"{tag}: "), F.col(f"p.{field}")) for tag, field in tags]
    ref = F.concat(F.lit("ExternalRef: PACKAGE-MANAGER purl "), F.expr("p.externalRefs[0].referenceLocator"))
    return rows.withColumn("value", F.concat_ws("\n", *lines, ref)).drop("p")


def sarif(findings: DataFrame, key: str = "image") -> DataFrame:
    """Reports of (key, cve, package, installed, fixed, priority), one run each."""
    level = F.lit("note")
    for p, named in LEVELS.items():
        level = F.when(F.col("priority") == p, named).otherwise(level)
    fix = F.concat(F.lit("Fixed in "), "fixed")
    message = F.concat_ws(". ", F.concat_ws(" ", "cve", F.lit("affects"), "package", "installed"), fix)
    props = F.struct("package", "installed", "fixed", "priority")
    item = F.struct(F.col("cve").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), props.alias("properties"))
    rules = lambda x: F.transform(F.array_distinct(F.transform(x, lambda i: i["ruleId"])), lambda r: F.struct(r.alias("id")))
    run = lambda x: F.struct(F.struct(F.struct(F.lit("depsift").alias("name"), rules(x).alias("rules")).alias("driver")).alias("tool"), x.alias("results"))
    return _documents(findings, key, item, lambda x: F.struct(F.lit("2.1.0").alias("version"), F.array(run(x)).alias("runs")))


def union_sarif(*reports: DataFrame, key: str = "image") -> DataFrame:
    """One report of each key from those of several tools: their runs one behind the other, in order of the texts.

    Runs are taken by their key, wherever it stands in a report, and written as they are; a report without runs, or one that
    is no JSON, adds none.
    """
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    runs = F.coalesce(F.from_json("value", "runs array<string>")["runs"], F.array().cast("array<string>"))
    joined = F.array_join(F.filter(F.flatten(F.array_sort(F.collect_list(runs))), lambda r: r.isNotNull()), ",")
    return out.groupBy(key).agg(F.concat(F.lit('{"version":"2.1.0","runs":['), joined, F.lit("]}")).alias("value"))


# The file that a snapshot of an ecosystem names.
MANIFESTS = {"npm": "package.json", "PyPI": "requirements.txt", "Maven": "pom.xml", "Go": "go.mod", "crates.io": "Cargo.toml"}


def snapshot(packages: DataFrame, key: str = "project") -> DataFrame:
    """Per (key, ecosystem): the manifest's name, and a JSON map from name@version to purl and directness. Repeated packages are direct if one is."""
    rows = packages.groupBy(key, "ecosystem", "name", "version").agg(F.bool_or("direct").alias("direct"))
    relation = F.when(F.col("direct"), "direct").otherwise("indirect")
    entry = F.struct(F.concat_ws("@", "name", "version").alias("k"), F.struct(short_purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("package_url"), relation.alias("relationship"), F.lit("runtime").alias("scope")).alias("v"))
    entries = rows.groupBy(key, "ecosystem").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return entries.select(key, "ecosystem", named(F.col("ecosystem"), MANIFESTS).alias("manifest"), F.to_json(F.map_from_entries("e")).alias("value"))


def graph_lines(edges: DataFrame, form: str) -> DataFrame:
    """A `graphml` or `dot` line per edge (src, dst), with escaped ends; the frame around is the file's concern."""
    ends = [F.col(c).cast("string") for c in ("src", "dst")]
    if form == "graphml":
        for a, b in XML:
            ends = [F.replace(c, F.lit(a), F.lit(b)) for c in ends]
        line = F.concat(F.lit('<edge source="'), ends[0], F.lit('" target="'), ends[1], F.lit('"/>'))
    else:
        for a, b in (("\\", "\\\\"), ('"', '\\"')):
            ends = [F.replace(c, F.lit(a), F.lit(b)) for c in ends]
        line = F.concat(F.lit('"'), ends[0], F.lit('" -> "'), ends[1], F.lit('";'))
    return edges.select(line.alias("value"))


#: Fill colours of nodes by scope (fixed values); other scopes have the last.
COLOURS = {"compile": "lightblue", "runtime": "lightgreen", "test": "lightyellow"}


def graph_nodes(nodes: DataFrame, form: str) -> DataFrame:
    """A `graphml` or `dot` line per node (id, label, scope), escaped; dot nodes are coloured by scope."""
    ident, label = (F.col(c).cast("string") for c in ("id", "label"))
    for a, b in XML if form == "graphml" else (("\\", "\\\\"), ('"', '\\"')):
        ident, label = (F.replace(c, F.lit(a), F.lit(b)) for c in (ident, label))
    if form == "graphml":
        return nodes.select(F.concat(F.lit('<node id="'), ident, F.lit('"><data key="label">'), label, F.lit("</data></node>")).alias("value"))
    colour = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), F.col("scope")), F.lit("lightgray"))
    return nodes.select(F.concat(F.lit('"'), ident, F.lit('" [label="'), label, F.lit('", fillcolor="'), colour, F.lit('"];')).alias("value"))


def audit_lines(entries: DataFrame) -> DataFrame:
    """CSV lines of timestamp, user, action, details; fields with a comma, quote or line end are quoted."""
    field = lambda c: F.when(F.col(c).rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return entries.select(F.concat_ws(",", *[field(c) for c in ("timestamp", "user", "action", "details")]).alias("value"))


def audit_csv(entries: DataFrame, path: str) -> None:
    """timestamp, user, action, details as CSV files with a header."""
    entries.select("timestamp", "user", "action", "details").write.option("header", True).csv(path)
