"""Severity, priority and risk as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depsift.functions.versions import major_jumps

RANKS = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL")

#: CVSS 3 metric weights (fixed values of the standard).
CVSS3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}

#: Packages whose upgrades need migration guides (fixed values).
FRAMEWORKS = (
    "spring-boot", "spring-core", "spring-framework", "django", "flask", "rails", "railties", "react", "react-dom",
    "vue", "vuejs", "angular", "@angular/core", "express", "laravel", "symfony",
)


def _pick(c: Column, values: dict) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out


def severity_rank(severity: Column) -> Column:
    """0 for unknown to 4 for critical."""
    return F.coalesce(_pick(F.upper(severity), {s: i for i, s in enumerate(RANKS)}), F.lit(0))


def severity_from_cvss(score: Column, least: float | None = None) -> Column:
    """Text severity of a score; `least=0.1` gives the feed parsers' bound for LOW."""
    low = score > 0 if least is None else score >= least
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(low, "LOW").otherwise("UNKNOWN")


def normalize_severity(text: Column) -> Column:
    t = F.upper(F.trim(text))
    known = _pick(t, {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "IMPORTANT": "HIGH", "MEDIUM": "MEDIUM", "MODERATE": "MEDIUM", "LOW": "LOW"})
    return F.coalesce(known, F.lit("UNKNOWN"))


def cvss3_base_score(text: Column) -> Column:
    """Base score of a number or a `CVSS:3` vector; null for anything else or an incomplete vector."""
    metric = lambda m: F.regexp_extract(text, rf"/{m}:([A-Z])", 1)
    w = {m: _pick(metric(m), v) for m, v in CVSS3.items()}
    changed = metric("S") == "C"
    pr = F.when(changed, _pick(metric("PR"), PRIVILEGES["C"])).otherwise(_pick(metric("PR"), PRIVILEGES["U"]))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    ease = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease))
    score = F.when(impact <= 0, 0.0).otherwise(F.ceil(F.round(raw * 10, 6)) / 10)
    return F.when(text.rlike(r"^\s*\d+(\.\d+)?\s*$"), text.cast("double")).when(text.startswith("CVSS:3"), score)


def priority(cvss: Column, epss: Column, kev: Column) -> Column:
    """P0 to P4 of an advisory; a missing score counts as 0."""
    c, e, k = F.coalesce(cvss, F.lit(0.0)), F.coalesce(epss, F.lit(0.0)), F.coalesce(kev, F.lit(False))
    return (
        F.when((k & (c >= 7)) | (c >= 9) | (e >= 0.9), "P0").when((c >= 7) & (k | (e >= 0.5)), "P1")
        .when((c >= 7) | ((c >= 4) & (e >= 0.1)), "P2").when(c >= 4, "P3").otherwise("P4")
    )


def sca_priority(cvss: Column, epss: Column, kev: Column) -> Column:
    """P0 to P4 of a component's finding; without a score P3."""
    e, k = F.coalesce(epss, F.lit(0.0)), F.coalesce(kev, F.lit(False))
    scored = (
        F.when((e > 0.7) & (cvss >= 9), "P0").when((e > 0.5) & (cvss >= 7), "P1").when(cvss >= 9, "P1").when(cvss >= 7, "P2").when(cvss >= 4, "P3").otherwise("P4")
    )
    return F.when(k, "P0").when(cvss.isNull(), "P3").otherwise(scored)


def is_framework(name: Column) -> Column:
    out = F.lit(False)
    for f in FRAMEWORKS:
        out |= name.contains(f)
    return out


def difficulty_score(name: Column, installed: Column, fixed: Column, breaking: Column) -> Column:
    """10 to 95; 100 without a fix."""
    score = F.lit(10) + F.when(breaking, 40).otherwise(0) + 15 * major_jumps(installed, fixed) + F.when(is_framework(name), 25).otherwise(0)
    return F.when(fixed.isNull(), 100).otherwise(F.least(F.lit(95), score)).cast("int")


# The sentences of a risk score's explanation.
EXPLAINED = {
    "score": ("Risk score: ", "/1.00"),
    "cvss": ("High CVSS score (", ")"),
    "epss": ("High exploit probability (EPSS: ", "%)"),
    "kev": "In CISA KEV (actively exploited)",
    "reachable": "Vulnerable code is reachable",
    "unreachable": "Vulnerable code is NOT reachable (lower risk)",
    "exploit": "Public exploit code available",
    "age": ("Recent vulnerability (", " days old)"),
}
WEIGHTS = {"cvss": 0.25, "epss": 0.20, "kev": 0.20, "reachable": 0.20, "age": 0.05, "exploit": 0.10}


def risk_score(cvss: Column, epss: Column, kev: Column, reachable: Column, age_days: Column, exploit: Column, weights: dict | None = None) -> Column:
    """Weighted risk in [0, 1]; newer flaws weigh more."""
    w = WEIGHTS | (weights or {})
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    age = 1.0 - F.least(age_days / 365.0, F.lit(1.0))
    return cvss / 10.0 * w["cvss"] + epss * w["epss"] + one(kev) * w["kev"] + one(reachable) * w["reachable"] + age * w["age"] + one(exploit) * w["exploit"]


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "Critical").when(score >= 0.6, "High").when(score >= 0.4, "Medium").when(score >= 0.2, "Low").otherwise("Minimal")


def fixed_text(c: Column, places: int) -> Column:
    """A number's text with so many decimals, a half in the seventh decimal's view rounded up."""
    ten = 10.0**places
    return F.format_string(f"%.{places}f", F.floor(F.round(c * 1e6) / (1e6 / ten) + 0.5) / ten)


def risk_explanation(cvss: Column, epss: Column, kev: Column, reachable: Column, age_days: Column, exploit: Column, weights: dict | None = None) -> Column:
    """What `risk_score` comes from, in sentences: the score, then each part that weighs much."""
    w = WEIGHTS | (weights or {})
    age = 1.0 - F.least(age_days / 365.0, F.lit(1.0))
    score = risk_score(cvss, epss, kev, reachable, age_days, exploit, weights)
    says = lambda hit, *text: F.when(hit, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]))
    return F.concat_ws(
        ". ", F.concat(F.lit(EXPLAINED["score"][0]), fixed_text(score, 2), F.lit(EXPLAINED["score"][1])),
        says(cvss / 10.0 * w["cvss"] > 0.15, EXPLAINED["cvss"][0], fixed_text(cvss, 1), EXPLAINED["cvss"][1]),
        says(epss * w["epss"] > 0.15, EXPLAINED["epss"][0], fixed_text(epss * 100.0, 1), EXPLAINED["epss"][1]),
        says(kev & F.lit(w["kev"] > 0), EXPLAINED["kev"]), F.when(reachable & F.lit(w["reachable"] > 0), EXPLAINED["reachable"]).otherwise(EXPLAINED["unreachable"]),
        says(exploit & F.lit(w["exploit"] > 0), EXPLAINED["exploit"]), says(age * w["age"] > 0.05, EXPLAINED["age"][0], age_days.cast("string"), EXPLAINED["age"][1]),
    )


def fix_urgency(level: Column) -> Column:
    return F.when(level == "Critical", "IMMEDIATE").when(level == "High", "HIGH").when(level == "Medium", "MEDIUM").otherwise("LOW")


def scorecard_risk(score: Column) -> Column:
    return F.when(score >= 8, "Low").when(score >= 6, "Medium").when(score >= 4, "High").otherwise("Critical")
