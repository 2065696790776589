"""Package names, URLs and kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Purl types and advisory ecosystems of the scanners' and advisories' names.
PURL_TYPES = {
    "PyPI": "pypi", "crates.io": "cargo", "Packagist": "composer",
    "Node.js/npm": "npm", "npm": "npm", "Python": "pypi", "pip": "pypi", "Go": "golang", "Rust": "cargo", "cargo": "cargo", "Ruby": "gem",
    "gem": "gem", "RubyGems": "gem", "PHP": "composer", "composer": "composer", "Maven": "maven", "Gradle": "maven",
    "Alpine": "apk", "Debian": "deb", "Rpm": "rpm",
}
OSV_ECOSYSTEMS = {
    "Node.js/npm": "npm", "npm": "npm", "Python": "PyPI", "pip": "PyPI", "Go": "Go", "Rust": "crates.io", "cargo": "crates.io", "Ruby": "RubyGems",
    "gem": "RubyGems", "PHP": "Packagist", "composer": "Packagist", "Maven": "Maven", "Gradle": "Maven",
}
#: Namespaces that name a registry (fixed values).
REGISTRIES = r"^(crates\.io|rubygems\.org|packagist\.org(/.*)?)$"
JVM = ("Maven", "Gradle")
NPM = ("Node.js/npm", "npm")
PYPI = ("Python", "pip")


def named(c: Column, values: dict[str, str]) -> Column:
    """The value of a name; the name itself if it has none."""
    out = F
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(c)


def _scoped(namespace: Column, name: Column) -> Column:
    return F.coalesce(F.concat(namespace, F.lit("/"), name), name)


def package_url(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """Package URL; Maven names lose a group in front of a colon where a namespace gives it, registries are no namespace."""
    artifact = F.when(namespace.isNotNull() & name.contains(":"), F.split(name, ":")[1]).otherwise(name)
    space = F.when(~namespace.rlike(REGISTRIES), namespace)
    path = F.when(ecosystem.isin(*JVM), _scoped(namespace, artifact)).when(ecosystem == "Go", _scoped(namespace, name)).otherwise(_scoped(space, name))
    return F.concat(F.lit("pkg:"), named(ecosystem, PURL_TYPES), F.lit("/"), path, F.lit("@"), version)


def short_purl(ecosystem: Column, name: Column, version: Column | None = None) -> Column:
    """Package URL of an advisory's ecosystem and whole name, with a version if there is one: groups and scopes part by /."""
    path = F.when(ecosystem.isin(*JVM), F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    bare = F.concat(F.lit("pkg:"), named(ecosystem, PURL_TYPES), F.lit("/"), path)
    return bare if version is None else F.concat(bare, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def parse_purl(purl: Column) -> Column:
    """(system, name with its namespace, version); null unless it begins with pkg: and has exactly one @."""
    part = lambda n: F.regexp_extract(purl, r"^pkg:([^/@]*)/?([^@]*)@([^@]*)$", n)
    whole = F.struct(part(1).alias("system"), part(2).alias("name"), part(3).alias("version"))
    return F.when(purl.rlike(r"^pkg:[^@]*@[^@]*$"), whole)


def _maven(namespace: Column, name: Column, version: Column, end: str) -> Column:
    parts = F.split(name, ":")
    group = F.coalesce(namespace, F.when(F.size(parts) == 2, parts[0]))
    artifact = F.when(namespace.isNotNull(), name).otherwise(F.get(parts, F.lit(1)))
    path = F.concat_ws("/", F.replace(group, F.lit("."), F.lit("/")), artifact, version, F.concat(artifact, F.lit("-"), version))
    return F.when(group.isNotNull(), F.concat(F.lit("https://repo1.maven.org/maven2/"), path, F.lit(end)))


def _formatted(text: str, **values: Column) -> Column:
    """The text with columns in place of {names}."""
    parts = []
    for at, x in enumerate(text.replace("}", "{").split("{")):
        parts.append(values[x] if at % 2 else F.lit(x))
    return F.concat(*parts)


def download_url(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """Registry page or archive of a package version; null where it can't be told."""
    scoped = _scoped(namespace, name)
    php = F.when(namespace.isNotNull() | name.contains("/"), scoped)
    url = lambda text: _formatted(text, scoped=scoped, bare=F.ltrim(name, F.lit("@")), name=name, php=php, version=version)
    return (
        F.when(ecosystem == "Maven", _maven(namespace, name, version, ".jar"))
        .when(ecosystem.isin(*NPM), url("https://registry.npmjs.org/{scoped}/-/{bare}-{version}.tgz"))
        .when(ecosystem.isin(*PYPI), url("https://pypi.org/project/{name}/{version}/"))
        .when(ecosystem == "Rust", url("https://crates.io/crates/{name}/{version}"))
        .when(ecosystem == "Go", url("https://proxy.golang.org/{scoped}/@v/{version}.zip"))
        .when(ecosystem == "Ruby", url("https://rubygems.org/gems/{name}/versions/{version}"))
        .when(ecosystem == "PHP", url("https://packagist.org/packages/{php}#{version}"))
    )


def checksum_url(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """Where a registry tells a version's checksum; null where it can't be told."""
    scoped = _scoped(namespace, name)
    php = F.when(namespace.isNotNull() | (F.size(F.split(name, "/")) == 2), scoped)
    url = lambda text: _formatted(text, scoped=scoped, name=name, php=php, version=version)
    return (
        F.when(ecosystem == "Maven", _maven(namespace, name, version, ".jar.sha256"))
        .when(ecosystem.isin(*NPM), url("https://registry.npmjs.org/{scoped}/{version}"))
        .when(ecosystem.isin(*PYPI), url("https://pypi.org/pypi/{name}/{version}/json"))
        .when(ecosystem == "Rust", url("https://crates.io/api/v1/crates/{name}/{version}"))
        .when(ecosystem == "Go", url("https://proxy.golang.org/{scoped}/@v/{version}.info"))
        .when(ecosystem == "Ruby", url("https://rubygems.org/api/v1/versions/{name}.json"))
        .when(ecosystem == "PHP", url("https://repo.packagist.org/p2/{php}.json"))
    )


def osv_ecosystem(ecosystem: Column) -> Column:
    return named(ecosystem, OSV_ECOSYSTEMS)


def osv_name(ecosystem: Column, namespace: Column, name: Column) -> Column:
    """Name as advisories know it: scopes are kept, namespaces with a dot are registries and go."""
    return F.when(ecosystem.isin(*JVM) | namespace.contains("."), name).otherwise(_scoped(namespace, name))


def spdx_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}.-]", "-")


# What a name alone says of its ecosystem.
GO_HOSTS = ("github.com/", "golang.org/", "go.uber.org/", "gopkg.in/", "k8s.io/", "sigs.k8s.io/", "cloud.google.com/", "google.golang.org/")
RUBY_NAMES = (
    "rails", "rake", "bundler", "sinatra", "puma", "rspec", "sidekiq", "devise", "pundit", "redis", "pg", "mysql2", "nokogiri", "capybara",
    "factory_bot", "rubocop", "activerecord", "activesupport", "actionpack",
)
PHP_VENDORS = (
    "symfony", "laravel", "phpunit", "doctrine", "guzzlehttp", "monolog", "psr", "composer", "league", "illuminate", "nesbot", "ramsey", "vlucas",
    "fzaninotto", "nikic", "swiftmailer", "twig", "sensio", "egulias", "webmozart", "friendsofphp", "phpseclib", "paragonie",
)


def detect_ecosystem(name: Column) -> Column:
    """Ecosystem by the shape of a name, first rule first; names of no shape of their own go by hyphens, then npm.

    Maven: a colon, a Java package, or no name. Go: a known host. npm: a scope. RubyGems: a suffix or a known gem.
    Packagist: a known vendor. PyPI: lower case with a hyphen.
    """
    any_prefix = lambda xs: F.reduce(F.array(*map(F.lit, xs)), F.lit(False), lambda a, x: a | name.startswith(x))
    go = any_prefix(GO_HOSTS)
    return (
        F.when(F.trim(name) == "", "Maven").when(name.contains(":") & ~name.startswith("github.com/"), "Maven")
        .when(any_prefix(("org.", "com.", "io.", "net.")), "Maven").when(go, "Go").when(name.rlike("^@.*/"), "npm")
        .when(name.rlike("-(rails|ruby|rb)$") | name.isin(*RUBY_NAMES), "RubyGems")
        .when(name.rlike("^[a-z-]+/[a-z-]+$") & F.split(name, "/")[0].isin(*PHP_VENDORS), "Packagist")
        .when(name.rlike("^[a-z0-9-]*-[a-z0-9-]*$"), "PyPI").otherwise("npm")
    )


def detection_confidence(name: Column) -> Column:
    """How sure the shape of a name is (fixed values)."""
    return (
        F.when(name.contains(":") & ~name.startswith("github.com/"), 1.0).when(name.rlike(r"^(github\.com|golang\.org|go\.uber\.org|gopkg\.in)/"), 0.95)
        .when(name.rlike("^@.*/"), 0.9).when(name.rlike("^(symfony|laravel)/[^/]*$"), 0.8).when(name.rlike("^[^@/]*/[^/]*$"), 0.6)
        .when(name.rlike("^[a-z0-9-]*-[a-z0-9-]*$"), 0.6).otherwise(0.5)
    )


# Rule kinds of JVM targets.
JVM_RULES = (
    "java_library", "java_binary", "java_test", "java_plugin", "java_import", "kotlin_library", "kotlin_jvm_library", "kt_jvm_library", "kt_jvm_binary",
    "kt_jvm_test", "kt_jvm_import", "scala_library", "scala_binary", "scala_test", "scala_import", "scala_macro_library",
)


def bazel_rule_class(kind: Column, target: Column) -> Column:
    """(jvm, entrypoint) of a build target; without a kind its name tells entrypoints."""
    by_name = target.rlike(r"_binary|_test|:main$|:test$")
    return F.struct(F.coalesce(kind.isin(*JVM_RULES), F.lit(False)).alias("jvm"), F.coalesce(kind.rlike("_(binary|test)$"), by_name).alias("entrypoint"))


def layer_kind(command: Column) -> Column:
    """What a layer's build command puts there, first rule first."""
    return (
        F.when(command.contains("COPY") | command.contains("ADD"), "Application files")
        .when(command.contains("RUN") & command.contains("java"), "Java runtime").when(command.contains("RUN"), "Base OS packages").otherwise("Configuration")
    )


# Words of build commands that tell the base image, in order.
BASES = (
    ("alpine", "alpine|apk add"), ("debian", "debian|apt-get"), ("ubuntu", "ubuntu"), ("centos/rhel", "centos|yum"), ("fedora", "fedora|dnf"), ("busybox", "busybox"),
)


def base_image(command: Column) -> Column:
    out = F
    for base, words in BASES:
        out = out.when(command.rlike(words), base)
    return out


def confusion_version(version: Column) -> Column:
    """Whether a version looks made to win a resolution: a major of 999 or more, or nines in a row."""
    major = F.split(version, r"\.")[0]
    return F.coalesce(F.when(major.rlike(r"^\d+$"), major.try_cast("long") >= 999), F.lit(False)) | version.contains("999")


def suspicious_version_name(name: Column, version: Column) -> Column:
    """Threat levels that a version (Medium) and a name (Low) ask for, as an array."""
    odd = (F.length(version) > 20) | ~version.rlike("^[A-Za-z0-9.+-]*$")
    bad = name.rlike("test-|tmp-|temp-|fake-|malicious-|-backdoor|-exploit|-hack|-pwn")
    return F.array_compact(F.array(F.when(odd, "Medium"), F.when(bad, "Low")))


def name_threats(name: Column, level: str = "full") -> Column:
    """Threat levels of a name: words of attacks (from `basic` on) and prefixes of internal packages (`full`)."""
    words = F.when(F.lower(name).rlike("malicious|backdoor|trojan"), "Critical") if level != "off" else F.lit(None).cast("string")
    inner = F.when(name.rlike("^(internal|company|private)-"), "High") if level == "full" else F.lit(None).cast("string")
    return F.array_compact(F.array(words, inner))


#: Letters of the pieces by which names are looked up.
PIECE = 3


def pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of `size` letters of a text that has at least so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))
