"""What an upgrade asks for: impact, risk, effort and the words for it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depsift.functions.versions import parse_version3

LOW, MEDIUM, HIGH, CRITICAL = RISKS = ("Low", "Medium", "High", "Critical")

# Packages (a pattern), old and new major, and what their migration guides say.
_SPRING, _DJANGO, _RAILS, _REACT, _VUE, _EXPRESS = r"^org\.springframework\.boot|spring-boot", "^django$|^Django", "^rails", "^react$", "^vue$|^@vue/", "^express$"
GUIDES = (
    (_SPRING, 2, 3, "Spring Boot 2→3 requires Java 17+. Migration guide: https://github.com/spring-projects/spring-boot/wiki/Spring-Boot-3.0-Migration-Guide"),
    (_SPRING, 1, 2, "Spring Boot 1→2 has significant changes. Guide: https://github.com/spring-projects/spring-boot/wiki/Spring-Boot-2.0-Migration-Guide"),
    (_DJANGO, 4, 5, "Django 4→5 removes deprecated features. Guide: https://docs.djangoproject.com/en/5.0/howto/upgrade-version/"),
    (_DJANGO, 3, 4, "Django 3→4 removes deprecated features. Guide: https://docs.djangoproject.com/en/4.0/howto/upgrade-version/"),
    (_DJANGO, 2, 3, "Django 2→3 drops Python 2 support. Requires Python 3.6+"),
    (_RAILS, 6, 7, "Rails 6→7 requires Ruby 2.7+. Guide: https://guides.rubyonrails.org/upgrading_ruby_on_rails.html"),
    (_RAILS, 5, 6, "Rails 5→6 requires Ruby 2.5+. Guide: https://guides.rubyonrails.org/upgrading_ruby_on_rails.html"),
    (_REACT, 17, 18, "React 17→18 introduces concurrent features. May need createRoot() migration"),
    (_REACT, 16, 17, "React 16→17 is a stepping stone release. Minimal breaking changes"),
    (_VUE, 2, 3, "Vue 2→3 has major API changes. Migration guide: https://v3-migration.vuejs.org/"),
    (_EXPRESS, 4, 5, "Express 4→5 has breaking changes in middleware and routing"),
)
# What versions mean in an ecosystem.
SEMANTICS = {
    "Python": "Python packages don't always follow semver strictly. Check changelog carefully.",
    "JavaScript": "npm packages follow semver. Major = breaking changes.",
    "Go": "Go modules use v2+ for breaking changes (import path changes).",
    "Rust": "Rust crates follow semver. Pre-1.0 allows breaking changes in minor versions.",
    "Ruby": "Ruby gems generally follow semver for version 1.0+.",
    "PHP": "PHP/Composer packages typically follow semver.",
    "Java": "Java packages typically follow semver. Check for API deprecations.",
}


# The reasons to fix a flaw, by severity, exploitation, chance of exploitation (least EPSS) and score (least CVSS).
URGENT = {
    "CRITICAL": "CRITICAL severity - immediate action required",
    "HIGH": "HIGH severity - fix as soon as possible",
    "MEDIUM": "MEDIUM severity - schedule fix in near term",
    "LOW": "LOW severity - fix when convenient",
}
OTHER_SEVERITY, NO_REASON = "Unknown severity", "This vulnerability should be addressed to reduce security risk"
EXPLOITED = "Listed in CISA KEV (Known Exploited Vulnerabilities) - actively exploited in the wild"
LIKELY = ((0.9, "Very high"), (0.5, "High"), (0.1, "Moderate"))
CHANCE = " exploit probability (EPSS: %.1f%%)"
SCORED = ((9.0, "Very high CVSS score: "), (7.0, "High CVSS score: "))
# Kinds of a version change and what they ask for.
CHANGES = {
    "major": ("Major version upgrade", "expect breaking changes. Review the changelog and test thoroughly before upgrading."),
    "minor": ("Minor version upgrade", "may include new features and deprecations. Review release notes for details."),
    "other": ("Version upgrade", "review the changelog for compatibility information."),
}
# Effort by the number of fixable findings (at most).
EFFORT = ((0, "No immediate fixes available"), (5, "Low (< 1 hour)"), (20, "Medium (1-4 hours)"))
MOST_EFFORT = "High (> 4 hours)"


def _part(version: Column, n: int) -> Column:
    part = F.get(F.split(version, r"\."), F.lit(n))
    return F.when(part.rlike(r"^\+?\d+$"), part.try_cast("long"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def upgrade_impact(package: Column, ecosystem: Column, old: Column, new: Column) -> Column:
    """(breaking, note) of an upgrade; both null when a major is no number or goes down.

    A higher major breaks: a framework's guide speaks first, then Rust before 1.0, Go modules, and the ecosystem's own
    sense of versions (ecosystem: a key of SEMANTICS, or null). A higher minor of a Rust crate before 1.0 breaks too, a
    minor over five ahead is worth a look, anything else is a patch.
    """
    a, b, m, n = _part(old, 0), _part(new, 0), _part(old, 1), _part(new, 1)
    guide = F.when(package.startswith("@angular/"), _text("Angular ", a, "→", b, " migration guide: https://update.angular.io/"))
    for pattern, x, y, said in GUIDES:
        guide = guide.when(package.rlike(pattern) & (a == x) & (b == y), said)
    paths = package.rlike(r"^(github\.com|golang\.org)/") & (b >= 2)
    guide = guide.when(paths, _text("Go module major version ", a, "→", b, ". Update import paths to include /v", b))
    rust = F.coalesce(ecosystem == "Rust", F.lit(False)) & (a == 0)
    go = F.coalesce(ecosystem == "Go", F.lit(False)) & (b >= 2)
    meaning = F
    for k, v in SEMANTICS.items():
        meaning = meaning.when(ecosystem == k, f". {v}")
    plain = _text("Major version upgrade ", a, "→", b, " may require code changes", F.coalesce(meaning, F.lit("")))
    major = F.coalesce(guide, F.when(rust, _text("Pre-1.0 Rust crate: ", old, "→", new, " may have breaking changes in minor versions")).when(
        go, _text("Go module major version ", a, "→", b, ". Update import paths to /v", b)).otherwise(plain))
    minor = (
        F.when(rust & (n > m), _text("Pre-1.0 Rust: 0.", m, "→0.", n, " may contain breaking changes"))
        .when(n > m + 5, _text("Minor version jump ", a, ".", m, "→", b, ".", n, " - review changelog")).otherwise("Patch update - low risk")
    )
    both = F.size(F.split(old, r"\.")) > 1
    both &= F.size(F.split(new, r"\.")) > 1
    said = F.when(b > a, major).when((a == b) & both, minor)
    breaking = F.when(b > a, True).when((a == b) & both, F.coalesce(rust & (n > m), F.lit(False)))
    return F.struct(breaking.alias("breaking"), said.alias("note"))


def _first(cases: list[tuple[Column, Column | str]]) -> Column:
    """The value of the first case that holds, else null."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out


def why_fix(severity: Column, kev: Column, epss: Column, cvss: Column, summary: Column) -> Column:
    """The reasons to fix a flaw, as sentences."""
    urgent = _first([*((severity == level, said) for level, said in URGENT.items()), (severity.isNotNull(), OTHER_SEVERITY)])
    likely = F.concat(_first([(epss >= least, said) for least, said in LIKELY]), F.format_string(CHANCE, epss * 100.0))
    shown = F.regexp_replace(cvss.cast("string"), r"\.0$", "")
    score = _first([(cvss >= least, F.concat(F.lit(said), shown)) for least, said in SCORED])
    reasons = F.concat_ws(". ", urgent, F.when(kev, EXPLOITED), likely, F.when(severity.isNotNull(), score), F.concat(F.lit("Impact: "), summary))
    return F.when(reasons == "", NO_REASON).otherwise(reasons)


def version_change_note(old: Column, new: Column) -> Column:
    """One sentence on the distance between two versions."""
    a, b = parse_version3(old), parse_version3(new)
    known = a.isNotNull() & b.isNotNull()
    said = {k: _text(f"{kind} (", old, " → ", new, f") - {advice}") for k, (kind, advice) in CHANGES.items()}
    return _first([(known & (b[k] > a[k]), said[k]) for k in ("major", "minor")]).otherwise(said["other"])


def risk_rank(risk: Column) -> Column:
    """1 for Low to 4 for Critical."""
    return F.array_position(F.array(*map(F.lit, RISKS)), risk)


def risk_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), rank.cast("int"))


def remediation_effort(fixable: Column) -> Column:
    return _first([(fixable <= most, said) for most, said in EFFORT]).otherwise(MOST_EFFORT)
