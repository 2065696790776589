"""Kept scans and audit entries, advisories that come in increments, and reports of several tools."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from depsift.functions.severity import risk_explanation
from depsift.operators import audit, findings, graph, match
from depsift.sources import documents, feeds, history


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_scans_are_compared_without_a_shuffle(spark):
    rng = random.Random(1)
    scan = lambda: spark.createDataFrame([(rng.randint(1, 30), f"CVE-{rng.randint(1, 40)}", rng.choice(["CRITICAL", "HIGH", "LOW"])) for _ in range(400)], "image long, cve string, severity string")
    a, b = scan(), scan()
    kept = [history.save_scan(x, f"scan_{n}", buckets=8) for n, x in (("a", a), ("b", b))]
    try:
        for compare in (findings.scan_diff, findings.baseline_delta):
            found = compare(*kept)
            assert "Exchange" not in plan(found)
            assert sorted(map(str, found.collect())) == sorted(map(str, compare(a, b).collect()))
        old, new = ({(r.image, r.cve) for r in x.collect()} for x in (a, b))
        for r in findings.baseline_delta(*kept).collect():
            assert r.added == sorted(c for i, c in new - old if i == r.image) and r.fixed == sorted(c for i, c in old - new if i == r.image)
    finally:
        for n in "ab":
            spark.sql(f"drop table scan_{n}")


def test_audit_by_day_reads_the_days_asked_for(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.range(1000).select((F.col("id") * 3600 + 1_700_000_000).alias("timestamp_unix"), F.lit("scan").alias("action"), F.lit("pass").alias("result"))
    history.write_audit(rows.where("timestamp_unix < 1702000000"), path)
    history.write_audit(rows.where("timestamp_unix >= 1702000000"), path)
    kept = history.read_audit(spark, path)
    now = 1_700_000_000 + 1000 * 3600
    for found, want in ((audit.query_audit(kept, 1_700_500_000, 1_700_600_000), audit.query_audit(rows, 1_700_500_000, 1_700_600_000)), (audit.audit_retention(kept, 2, now), audit.audit_retention(rows, 2, now))):
        assert sorted(r[0] for r in found.select("timestamp_unix").collect()) == sorted(r[0] for r in want.select("timestamp_unix").collect()) != []
        scan = next(line for line in plan(found).splitlines() if "PartitionFilters" in line)
        assert "day" in scan.split("PartitionFilters: [")[1].split("]")[0]
        days = found.select("day").distinct().count()
        read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
        assert days <= 3 and len(read) <= 3 and kept.select("day").distinct().count() > 40


def test_increments_of_aliases_equal_the_whole(spark):
    rng = random.Random(4)
    records = [(f"A{i}", [f"A{rng.randint(0, 90)}" for _ in range(rng.choice([0, 0, 1, 2]))] or None) for i in range(80)]
    df = lambda rows: spark.createDataFrame(rows, "id string, aliases array<string>")
    labels = graph.alias_labels(df(records[:30]))
    for part in (records[30:50], records[50:51], records[51:]):
        labels = graph.add_alias_labels(labels, df(part))
    assert Counter(map(tuple, labels.collect())) == Counter(map(tuple, graph.alias_labels(df(records)).collect()))


def test_merged_records_keep_severity_affected_and_their_own_id(spark):
    package = lambda e, p, v: {"ecosystem": e, "package": p, "version": v}
    rows = [
        (0, "CVE-1", ["GHSA-1"], 5.0, "short", ["u"], None, [package("npm", "a", "1"), package("npm", "b", "1")]),
        (1, "GHSA-1", None, 9.0, "longer", ["v", "u"], "HIGH", [package("npm", "a", "2")]),
        (2, "OSV-1", ["CVE-1"], 9.0, None, None, "OTHER", None),
    ]
    schema = "pos long, id string, aliases array<string>, cvss double, details string, urls array<string>, severity string, affected array<struct<ecosystem:string,package:string,version:string>>"
    r = graph.merge_advisories(spark.createDataFrame(rows, schema)).first()
    assert (r.id, r.aliases, r.severity, r.details, r.urls) == ("CVE-1", ["CVE-1", "GHSA-1", "OSV-1"], "HIGH", "longer", ["u", "v"])
    assert [tuple(x) for x in r.affected] == [("npm", "a", "2"), ("npm", "b", "1")]


def test_runs_of_reports_with_keys_in_any_order(spark):
    run = lambda rule: {"tool": {"driver": {"name": "x", "rules": [{"id": "]}"}]}}, "results": [{"ruleId": rule, "level": "note", "message": {"text": 'a "runs": [1] b'}}]}
    reports = [json.dumps({"runs": [run("A"), run("B")], "version": "2.1.0"}), json.dumps({"version": "2.1.0", "runs": [run("C")], "$schema": "s"}), "{}", "no json", None, '{"runs": null}']
    docs = spark.createDataFrame([("i", r) for r in reports] + [("j", "{}")], "image string, value string")
    found = documents.union_sarif(docs.where("value like '%A%'"), docs.where("value is null or not value like '%A%'"))
    texts = {r.image: r.value for r in found.collect()}
    assert [x["results"][0]["ruleId"] for x in json.loads(texts["i"])["runs"]] == ["A", "B", "C"] and json.loads(texts["j"])["runs"] == []
    assert sorted(r.rule for r in feeds.sarif(found).collect()) == ["A", "B", "C"]


def test_searches_that_are_no_expression_or_ask_for_a_severity(spark):
    df = spark.createDataFrame([("spring", ["HIGH"]), ("Ring", []), ("x", None)], "name string, severities array<string>")
    names = lambda *a, **k: sorted(r.name for r in findings.search_dependencies(df, *a, **k).collect())
    assert names("[a", "regex") == [] and names("", "regex") == ["Ring", "spring", "x"]
    assert names("RING", severity="HIGH") == ["spring"] and names("^r", "regex") == [] and names("^r", "regex", any_case=True) == ["Ring"] and names("?", "glob") == ["x"]


def test_findings_known_by_an_alias_are_suppressed(spark):
    rows = [("A", ["B", "C"], "p"), ("A", None, "p"), ("D", ["B"], "q"), ("E", [], None), ("F", ["C"], None)]
    df = spark.createDataFrame(rows, "cve string, aliases array<string>, purl string")
    told = spark.createDataFrame([("A", None, "affected", 1), ("B", "p", "fixed", 1), ("B", None, "affected", 1), ("C", None, "not_affected", 2), ("C", None, "affected", 1)], "cve string, purl string, status string, at long")
    got = sorted((r.cve, r.aliases or [], r.vex_status, r.suppressed) for r in match.apply_vex(df, told).collect())
    assert got == [("A", [], "affected", False), ("A", ["B", "C"], "fixed", True), ("D", ["B"], "affected", False), ("E", [], None, False), ("F", ["C"], "not_affected", True)]


def test_explanations(spark):
    rows = [(9.8, 0.95, True, True, 10, True), (3.0, 0.1, False, False, 400, False)]
    df = spark.createDataFrame(rows, "c double, e double, k boolean, r boolean, a int, x boolean")
    got = [r[0] for r in df.select(risk_explanation(*map(F.col, "cekrax"))).collect()]
    assert got == [
        "Risk score: 0.98/1.00. High CVSS score (9.8). High exploit probability (EPSS: 95.0%). In CISA KEV (actively exploited). Vulnerable code is reachable. Public exploit code available",
        "Risk score: 0.10/1.00. Vulnerable code is NOT reachable (lower risk)",
    ]
