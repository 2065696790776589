"""Threat rules over texts, file lists and package metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("None", "Low", "Medium", "High", "Critical")

# Families of patterns in install scripts, with the threat level of a hit and what each pattern tells.
SCRIPT_PATTERNS = {
    "Network": ("High", (
        (r"https?://[^\s]+webhook[^\s]*", "Discord/Slack webhook exfiltration"), (r"https?://pastebin\.com", "Pastebin data exfiltration"),
        (r"https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "Direct IP address connection"), (r"curl\s+[^\|]*\|\s*(sh|bash)", "Remote script execution (curl | sh)"),
        (r"wget\s+[^\|]*\|\s*(sh|bash)", "Remote script execution (wget | sh)"), (r"dns\.query|dns\.resolve", "DNS exfiltration"), (r"ngrok|localtunnel", "Tunnel service usage"),
    )),
    "Filesystem": ("Critical", (
        (r"~/.ssh|\.ssh/", "SSH directory access"), (r"~/.aws|\.aws/credentials", "AWS credentials access"), (r"~/.npmrc|\.npmrc", "npm credentials access"),
        (r"~/.pypirc|\.pypirc", "PyPI credentials access"), (r"~/.gitconfig|\.git-credentials", "Git credentials access"), (r"/etc/passwd|/etc/shadow", "System password file access"),
        (r"\.env|\.env\.local", "Environment file access"), (r"id_rsa|id_ed25519|id_ecdsa", "SSH private key access"), (r"\.docker/config\.json", "Docker credentials access"),
        (r"\.kube/config", "Kubernetes config access"),
    )),
    "Execution": ("Medium", (
        (r"eval\s*\(", "Dynamic code evaluation (eval)"), (r"exec\s*\(", "Process execution (exec)"), (r"child_process", "Node.js child process spawning"),
        (r"subprocess|os\.system|os\.popen", "Python subprocess execution"), (r"Function\s*\(", "Dynamic function creation"),
        (r"Buffer\.from\([^)]+,\s*['\"]base64['\"]\)", "Base64 decode execution"), (r"atob\s*\(|btoa\s*\(", "Base64 encoding/decoding"),
        (r"\\x[0-9a-fA-F]{2}", "Hex-encoded strings"), (r"String\.fromCharCode", "Character code obfuscation"),
    )),
    "Crypto": ("Critical", (
        (r"stratum\+tcp://", "Mining pool connection"), (r"xmrig|xmr-stak|cpuminer", "Crypto miner binary"), (r"coinhive|cryptonight|monero", "Cryptocurrency mining"),
        (r"hashrate|getwork|submitwork", "Mining protocol keywords"), (r"wallet.*address|pool.*address", "Mining wallet configuration"),
    )),
    "Env exfiltration": ("Critical", (
        (r"process\.env", "Node.js environment access"), (r"os\.environ|os\.getenv", "Python environment access"), (r"ENV\[|ENV\.fetch", "Ruby environment access"),
        (r"\$\{?[A-Z_]+\}?", "Shell environment variable"), (r"getenv\(", "C/PHP environment access"),
    )),
}
#: Words of advisories on malicious packages (fixed values).
MALICIOUS_WORDS = (
    "malicious", "backdoor", "trojan", "malware", "cryptocurrency miner", "cryptominer", "ransomware", "supply chain attack", "compromised", "typosquat",
    "dependency confusion", "package takeover",
)
#: File endings of programs (fixed values).
PROGRAMS = r"(?i)\.(exe|dll|so|dylib|bin|com|bat|cmd|msi|app|dmg|deb|rpm|apk)$"
# Packages whose authors shipped a protest, with the versions.
PROTESTS = {
    "colors": ("1.4.1", "1.4.2", "1.4.44-liberty-2"),
    "faker": ("6.6.6",),
    "node-ipc": ("10.1.1", "10.1.2", "10.1.3", "11.0.0", "11.1.0"),
    "event-source-polyfill": ("1.0.26", "1.0.27", "1.0.28"),
    "es5-ext": ("0.10.53", "0.10.54", "0.10.55", "0.10.56", "0.10.57", "0.10.58", "0.10.59", "0.10.60", "0.10.61"),
    "styled-components": ("5.3.4",),
}


def level_rank(level: Column) -> Column:
    """0 for no threat to 4 for a critical one; null and unknown texts rank 0."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.initcap(level)) - 1, F.lit(0)), F.lit(0)).cast("int")


def worst(levels: Column) -> Column:
    """The highest level of an array; None if it is empty."""
    top = F.coalesce(F.array_max(F.transform(levels, level_rank)), F.lit(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), top + 1)


def scan_scripts(text: Column) -> Column:
    """(evidence, level) of a script: every pattern that occurs; environment access counts only beside the network.

    One pass with one expression a family tells most texts apart; single patterns are told only where a family occurs.
    """
    hits, levels, network = [], [], None
    for family, (level, patterns) in SCRIPT_PATTERNS.items():
        any_ = text.rlike("|".join(f"(?:{p})" for p, _ in patterns))
        network = any_ if network is None else network
        any_ = any_ & network if family == "Env exfiltration" else any_
        told = F.array_compact(F.array(*[F.when(text.rlike(p), f"{family}: {what}") for p, what in patterns]))
        hits.append(F.when(any_, told).otherwise(F.array().cast("array<string>")))
        levels.append(F.when(any_, level))
    return F.struct(F.concat(*hits).alias("evidence"), worst(F.array_compact(F.array(*levels))).alias("level"))


def scan_obfuscation(source: Column) -> Column:
    """Signs of hidden code in a source: long_lines, evals, escapes, blobs counts; `obfuscated` if two are over their bounds."""
    long_ = F.size(F.filter(F.split(source, "\n"), lambda x: F.octet_length(x) > 500))
    counts = [
        long_.alias("long_lines"), F.regexp_count(source, F.lit(r"eval\(|Function\(")).alias("evals"), F.regexp_count(source, F.lit(r"\\x[0-9a-fA-F]{2}")).alias("escapes"),
        F.regexp_count(source, F.lit(r"[A-Za-z0-9+/]{50,}={0,2}")).alias("blobs"),
    ]
    bounds = (5, 3, 20, 3)
    signs = sum((F.when(c > b, 1).otherwise(0) for c, b in zip(counts, bounds)), F.lit(0))
    return F.struct(*counts, (signs >= 2).alias("obfuscated"))


def binary_blobs(files: Column) -> Column:
    """The programs in a list of files."""
    return F.filter(files, lambda f: f.rlike(PROGRAMS))


def malicious_text(*texts: Column) -> Column:
    """Whether an advisory's texts tell of a malicious package."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(MALICIOUS_WORDS))


def protestware(name: Column, version: Column) -> Column:
    """Whether a version is known for a protest; a listed version that ends in + stands for all from there on, as text."""
    hit = F.lit(False)
    for package, versions in PROTESTS.items():
        exact = version.isin(*[v for v in versions if not v.endswith("+")])
        later = [version >= v[:-1] for v in versions if v.endswith("+")]
        for x in later:
            exact |= x
        hit |= (F.lower(name) == package) & exact
    return hit


def suspicious_changes(new_binaries: Column, suspicious_dependencies: Column) -> Column:
    """Risk of a release's changes: High with both signs, Medium with one, else null."""
    signs = F.when(new_binaries > 0, 1).otherwise(0) + F.when(suspicious_dependencies > 0, 1).otherwise(0)
    return F.when(signs >= 2, "High").when(signs == 1, "Medium")


def package_risk(row: dict[str, Column], as_of: Column) -> Column:
    """(score, signals) of package metadata at a date; the score is at most 100.

    row: version, description, repository_url, homepage_url, license, maintainers (array), last_publish_date,
    first_publish_date, total_versions, weekly_downloads.
    """
    absent, days = lambda c: row[c].isNull(), lambda c: F.datediff(as_of, row[c])
    odd = F.array_compact(F.array(
        F.when(absent("repository_url"), "repository"), F.when(absent("description") | (F.octet_length(row["description"]) < 10), "description"),
        F.when(absent("homepage_url") & absent("repository_url"), "homepage"), F.when((row["total_versions"] < 3) & (days("first_publish_date") > 365), "versions"),
    ))
    licence = F.upper(row["license"])
    copyleft = licence.contains("AGPL") | (licence.contains("GPL") & ~licence.contains("LGPL"))
    unclear = absent("license") | copyleft | licence.contains("SEE LICENSE") | (licence == "UNLICENSED")
    major = F.split(row["version"], r"\.")[0]
    jump = F.when(major.rlike(r"^\d+$"), major.try_cast("long") > 50) & (row["total_versions"] < 10)
    signals = (
        ("metadata", 15, F.size(odd) >= 2), ("abandoned", 20, days("last_publish_date") > 730),
        ("bus factor", 10, (F.size(row["maintainers"]) == 1) & (row["weekly_downloads"] > 10000)), ("license", 15, unclear), ("version", 25, jump),
    )
    score = sum((F.when(c, points).otherwise(0) for _, points, c in signals), F.lit(0))
    return F.struct(F.least(score, F.lit(100)).alias("score"), F.array_compact(F.array(*[F.when(c, n) for n, _, c in signals])).alias("signals"))


# Bounds of dependency features beyond which they are unusual.
THRESHOLDS = {"max_transitive": 100.0, "max_vulns": 5.0, "min_maintainer": 0.3, "min_releases": 2.0, "max_releases": 52.0, "min_popularity": 0.1}


def feature_vector(*features: Column) -> Column:
    """Features as doubles in one array; true is 1."""
    return F.array(*[c.cast("double") for c in features])


# Codes of a flaw's severity and kind; other kinds are 0.
SEVERITY_CODES = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
KIND_CODES = {"OTHER": 0, "RCE": 1, "XSS": 2, "SQLI": 3, "CSRF": 4}


def _code(text: Column, codes: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, code in codes.items():
        out = F.when(F.upper(text) == name, code).otherwise(out)
    return out


def vulnerability_features(cvss: Column, age_days: Column, exploit: Column, epss: Column, kev: Column, severity: Column, kind: Column, reachable: Column) -> Column:
    """Eight doubles of a flaw: score, days since it was told, exploit, EPSS, KEV, codes of severity and kind (texts), reachable; null counts as 0."""
    return feature_vector(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in (cvss, age_days, exploit, epss, kev, _code(severity, SEVERITY_CODES), _code(kind, KIND_CODES), reachable)])


def dependency_features(
    transitive: Column, age_days: Column, vulns: Column, same_group: Column, direct: Column, popularity: Column, maintainer: Column, releases: Column,
) -> Column:
    """Eight doubles of a dependency: transitive dependencies, their mean age in days, flaws, dependencies of the same group, direct, popularity
    and maintainer score (0 to 1), releases in a year; null counts as 0."""
    return feature_vector(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in (transitive, age_days, vulns, same_group, direct, popularity, maintainer, releases)])


def detect_anomalies(transitive: Column, vulns: Column, maintainer: Column, releases: Column, popularity: Column, bounds: dict[str, Column | float] | None = None) -> Column:
    """Array of (kind, score) for each feature beyond its bound, and MultipleSignals for two or more."""
    b = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (THRESHOLDS | (bounds or {})).items()}
    one = F.lit(1.0)
    few = releases < b["min_releases"]
    signal = lambda kind, hit, score: F.when(hit, F.struct(F.lit(kind).alias("kind"), F.least(score, one).alias("score")))
    found = F.array_compact(F.array(
        signal("UnusualTransitiveCount", transitive > b["max_transitive"], transitive / b["max_transitive"]),
        signal("HighVulnerabilityCount", vulns > b["max_vulns"], vulns / (b["max_vulns"] * 2.0)),
        signal("LowMaintainerScore", maintainer < b["min_maintainer"], one - maintainer),
        signal("UnusualReleasePattern", few | (releases > b["max_releases"]), F.when(few, (b["min_releases"] - releases) / b["min_releases"]).otherwise((releases - b["max_releases"]) / releases)),
        signal("LowPopularity", popularity < b["min_popularity"], one - popularity),
    ))
    many = F.struct(F.lit("MultipleSignals").alias("kind"), F.least(F.size(found) / 5.0, one).alias("score"))
    return F.when(F.size(found) >= 2, F.concat(found, F.array(many))).otherwise(found)
