"""Images, layers and distributions: attribution of findings, advisories of distributions, reachability of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.functions.names import PIECE, pieces
from depsift.functions.severity import normalize_severity
from depsift.functions.versions import apk_key, deb_key, rpm_key
from depsift.operators.match import older
from depsift.plans.lineage import cut
from depsift.plans.skew import paired_join


def contained(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., small, large) of rows with equal keys whose `large` name contains the `small` one; names are no longer than texts and not empty.

    A small name stands under its piece of PIECE letters (all of them, if it has fewer) that fewest large names have, and a large name under those of
    its pieces that are looked for. So names of one key meet by piece and never all with all, and the rows of a large key are split by pieces.
    """
    size = F.least(F.length("small"), F.lit(PIECE))
    asked = cut(small.where("small <> ''").select("small").distinct().withColumn("q", size).select("small", "q", F.explode(pieces(F.col("small"), F.col("q"))).alias("piece")))
    sizes = F.expr(f"sequence(1, least({PIECE}, greatest(1, length(large))))")
    held = large.where("large <> ''").select("large").distinct().withColumn("q", F.explode(sizes))
    held = held.select("large", "q", F.explode(pieces(F.col("large"), F.col("q"))).alias("piece"))
    held = cut(held.join(asked.select("q", "piece").distinct(), ["q", "piece"], "left_semi"))
    counts = held.groupBy("q", "piece").agg(F.count("*").alias("n"))
    under = asked.join(counts, ["q", "piece"], "left").groupBy("small").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "piece")).alias("k"))
    under = under.where("k.n > 0").select("small", "k.q", "k.piece")
    held = held.join(under.select("q", "piece").distinct(), ["q", "piece"], "left_semi")
    met = small.join(under, "small").join(large.join(held, "large"), [*keys, "q", "piece"])
    return met.where(F.contains(F.col("large"), F.col("small"))).select(*keys, "small", "large")


#: Packages of an image's layers that may stand in one array.
FEW = 64


def layer_attribution(layers: DataFrame, findings: DataFrame, few: int = FEW) -> DataFrame:
    """Findings with the layer of an image that brings their package; a null layer where none does.

    layers: image, layer, package; findings: image, cve, package and more. Names meet by equality first, the part
    after the last colon too; a finding that meets nothing so is attributed by substring, either way round. One row stays per (image,
    layer, cve), of the smallest package.

    An image of at most `few` packages by layer is an array that its findings look through, so all moves by image once; what larger ones have meets by
    joins (`_attributed`).
    """
    large = cut(layers.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > few).select("image"))
    found = None
    if not large.isEmpty():
        found = _attributed(layers.join(large, "image", "left_semi"), findings.join(large, "image", "left_semi"))
        layers, findings = layers.join(large, "image", "left_anti"), findings.join(large, "image", "left_anti")
    tail = lambda c: F.when(c.contains(":"), F.substring_index(c, ":", -1))
    by_image = layers.where("image is not null").groupBy("image").agg(F.collect_set(F.struct("package", tail(F.col("package")).alias("tail"), "layer")).alias("held"))
    own = F.col("package")
    rows = findings.withColumn("tail", tail(own)).join(by_image, "image", "left")
    equal = F.filter("held", lambda x: F.coalesce((x["package"] == own) | (x["tail"] == own) | (x["package"] == F.col("tail")) | (x["tail"] == F.col("tail")), F.lit(False)))
    whole = lambda x: (x["package"] != "") & (own != "")
    near = F.filter("held", lambda x: F.coalesce(whole(x) & (F.contains(x["package"], own) | F.contains(own, x["package"])), F.lit(False)))
    none = F.array(F.lit(None).cast(layers.schema["layer"].dataType))
    of = lambda c: F.array_distinct(F.transform(c, lambda x: x["layer"]))
    rows = rows.withColumn("equal", equal).withColumn("met", F.when(F.size("equal") > 0, of("equal")).otherwise(of(near)))
    rows = rows.withColumn("layer", F.explode(F.when(F.size("met") > 0, F.col("met")).otherwise(none))).drop("tail", "held", "equal", "met")
    return _first(rows if found is None else rows.unionByName(found), findings)


def _first(found: DataFrame, findings: DataFrame) -> DataFrame:
    more = [c for c in findings.columns if c not in ("image", "cve", "package")]
    first = F.min(F.struct("package", *more)).alias("f")
    return found.groupBy("image", "layer", "cve").agg(first).select("image", "layer", "cve", "f.*")


def _attributed(layers: DataFrame, findings: DataFrame) -> DataFrame:
    """`layer_attribution` by joins, each finding beside all layers that it meets: by equality, else by substring (`contained`)."""
    tail = F.when(F.col("package").contains(":"), F.substring_index("package", ":", -1))
    keys = lambda df: df.withColumn("key", F.explode(F.array_compact(F.array("package", tail))))
    known = layers.select("image", "layer", "package").distinct()
    by_key = keys(known).select("image", "key", "layer").distinct()
    rows = keys(findings).join(by_key, ["image", "key"]).drop("key").distinct()
    left = findings.join(rows.select("image", "package").distinct(), ["image", "package"], "left_anti")
    asked, names = left.select("image", "package").distinct(), known.select("image", "package").distinct()
    both = [x.select("image", F.col("package").alias(n)) for x in (asked, names) for n in ("small", "large")]
    inside = contained(both[0], both[3], ["image"]).select("image", F.col("small").alias("package"), F.col("large").alias("p"))
    around = contained(both[2], both[1], ["image"]).select("image", F.col("large").alias("package"), F.col("small").alias("p"))
    close = inside.unionByName(around).distinct().join(known.select("image", "layer", F.col("package").alias("p")), ["image", "p"]).drop("p").distinct()
    loose = left.join(close, ["image", "package"]).distinct()
    alone = left.join(close.select("image", "package").distinct(), ["image", "package"], "left_anti")
    return rows.unionByName(loose, allowMissingColumns=True).unionByName(alone.withColumn("layer", F.lit(None).cast(layers.schema["layer"].dataType)), allowMissingColumns=True)


#: Names of Ubuntu releases (fixed values).
UBUNTU = {"24.04": "noble", "23.10": "mantic", "22.04": "jammy", "20.04": "focal", "18.04": "bionic"}


def os_match_alpine(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed packages older than a fix, a row per CVE, severity UNKNOWN.

    packages: release, name, installed; advisories: release, name, fixed, cves (array).
    """
    rows = older(packages, advisories, ["release", "name"], apk_key)
    return rows.withColumn("cve", F.explode("cves")).drop("cves").withColumn("severity", F.lit("UNKNOWN"))


def os_match_debian(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages met by their source, else their name, in their release; only open and undetermined advisories count.

    packages: release, name, source, installed; advisories: release, package, cve, status, urgency, fixed. Without a
    fix a package is open with severity UNKNOWN; with one it must be older, and urgency tells the severity.
    """
    open_ = advisories.where("status in ('open', 'undetermined')")
    rows = older(packages.withColumn("package", F.coalesce("source", "name")), open_, ["release", "package"], deb_key, unfixed=True)
    u = F.col("urgency")
    level = F.when(F.col("fixed").isNull(), "UNKNOWN").when(u.isin("critical", "high"), "HIGH").when(u == "medium", "MEDIUM").when(u == "low", "LOW").otherwise("UNKNOWN")
    return rows.withColumn("severity", level).drop("package")


def os_match_ubuntu(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with a needed or pending advisory in their release's name, whatever the version; severity UNKNOWN.

    packages: version_id, name, source; advisories: release, package, cve, status, fixed.
    """
    release = F
    for version, name in UBUNTU.items():
        release = release.when(F.col("version_id") == version, name)
    rows = packages.withColumn("release", release).withColumn("package", F.coalesce("source", "name"))
    return paired_join(rows, advisories.where("status in ('needed', 'pending')"), ["release", "package"]).drop("package").withColumn("severity", F.lit("UNKNOWN"))


def nevra(text: Column) -> Column:
    """(name, version with its release) of name-version-release; null with fewer than two dashes."""
    part = lambda n: F.regexp_extract(text, r"^(.*)-([^-]*-[^-]*)$", n)
    return F.when(text.rlike(r"^.*-[^-]*-[^-]*$"), F.struct(part(1).alias("name"), part(2).alias("version")))


def os_match_redhat(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed packages older than a version that an advisory names, and the severity in common words.

    packages: name, installed; advisories: cve, severity, affected (array of name-version-release).
    """
    named = advisories.select("cve", normalize_severity(F.col("severity")).alias("severity"), F.explode("affected").alias("n")).withColumn("n", nevra(F.col("n")))
    named = named.select("cve", "severity", "n.name", F.col("n.version").alias("fixed"))
    return older(packages, named, ["name"], rpm_key)


def attach_reachability(findings: DataFrame, reachable: DataFrame, by: list[str]) -> DataFrame:
    """Findings with whether their package is reachable, by its name, else by the name without its leading @ and with
    : as /; null if neither is known. reachable: by..., package, reachable."""
    plain = F.replace(F.regexp_replace("package", "^@+", ""), F.lit(":"), F.lit("/"))
    known = reachable.groupBy(*by, "package").agg(F.bool_or("reachable").alias("r"))
    one = known.withColumnRenamed("r", "_exact")
    two = known.select(*by, F.col("package").alias("_plain"), F.col("r").alias("_loose"))
    rows = findings.join(one, [*by, "package"], "left").withColumn("_plain", plain).join(two, [*by, "_plain"], "left")
    return rows.withColumn("reachable", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_plain")


def package_reachable(packages: DataFrame, functions: DataFrame) -> DataFrame:
    """Packages with whether a reachable function belongs to them.

    packages: ecosystem, package; functions: id (of reachable ones). The package of a function is read off its id and
    met by equality: the one or two parts after node_modules/ for npm, the parts of dotted and slashed names for
    Python (- as _), and every run of whole parts of the import path for Go.
    """
    ids = functions.select("id").distinct()
    npm = ids.select(F.explode(F.regexp_extract_all("id", F.lit(r"node_modules/((?:@[^/]+/)?[^/:]+)"), 1)).alias("key"), F.lit("npm").alias("kind"))
    python = ids.select(F.explode(F.split("id", r"[./:]")).alias("key"), F.lit("Python").alias("kind"))
    path = "split(regexp_replace(id, '[.:][^/]*$', ''), '/')"
    runs = F.expr(f"flatten(transform(sequence(1, size({path})), i -> transform(sequence(i, size({path})), j -> array_join(slice({path}, i, j - i + 1), '/'))))")
    go = ids.select(F.explode(runs).alias("key"), F.lit("Go").alias("kind"))
    keys = npm.unionByName(python).unionByName(go).distinct().withColumn("reachable", F.lit(True))
    rows = packages.withColumn("kind", F.col("ecosystem")).withColumn("key", F.when(F.col("ecosystem") == "Python", F.replace("package", F.lit("-"), F.lit("_"))).otherwise(F.col("package")))
    return rows.join(keys, ["kind", "key"], "left").drop("kind", "key").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


# Methods of servlets, and words in class names of handlers.
SERVLET = ("doGet", "doPost", "doPut", "doDelete", "doHead", "doOptions", "doTrace", "service", "init", "destroy")


def is_entrypoint(name: Column, owner: Column, descriptor: Column, public: Column, static: Column) -> Column:
    """Whether a method can be called from outside: main, servlet methods, and public ones of handlers."""
    main = (name == "main") & static & (descriptor == "([Ljava/lang/String;)V")
    servlet = name.isin(*SERVLET) & (owner.contains("Servlet") | descriptor.contains("ServletRequest"))
    return public & (main | servlet | owner.rlike("Controller|Endpoint|Resource|Service"))


def requires_rescan(changes: DataFrame, by: str) -> DataFrame:
    """Groups of changed files (by, path) with a build or dependency file among them."""
    return changes.where(is_dependency_file(F.col("path"))).select(by).distinct()


# Names of build files and lock files.
BUILD_FILES = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "BUILD", "BUILD.bazel", "WORKSPACE", "WORKSPACE.bazel", "MODULE.bazel",
    "gradle.properties", "maven_install.json",
)
LOCK_FILES = ("gradle.lockfile", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "go.sum")


def is_dependency_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*BUILD_FILES, *LOCK_FILES)


def enrich_metadata(purls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Package URLs with the metadata known for them and whether there was any. metadata: purl, one row each, and more."""
    return purls.join(metadata.withColumn("found", F.lit(True)), "purl", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def fill_unknown_severity(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of severity UNKNOWN and a CVE take an advisory's: of a distribution's form of the id first, then the CVE.

    advisories: id, severity (not UNKNOWN to count). Other findings stay as they are.
    """
    known = advisories.where("severity <> 'UNKNOWN'").groupBy("id").agg(F.max("severity").alias("told"))
    asked = findings.where("severity = 'UNKNOWN' and cve like 'CVE-%'").select("cve").distinct()
    forms = [F.concat(F.lit(p), "cve") for p in ("ALPINE-", "DSA-", "USN-", "RHSA-", "")]
    hits = asked.select("cve", F.posexplode(F.array(*forms)).alias("at", "id")).join(known, "id").groupBy("cve").agg(F.min_by("told", "at").alias("told"))
    return findings.join(hits, "cve", "left").withColumn("severity", F.when(F.col("severity") == "UNKNOWN", F.coalesce("told", "severity")).otherwise(F.col("severity"))).drop("told")
