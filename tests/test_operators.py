"""Operators on small tables with nulls, ties, repeats and empty inputs."""

import pytest
from pyspark.sql import functions as F

from depsift.functions import names as N
from depsift.functions import upgrades as U
from depsift.operators import audit, containers, licences, upgrades
from depsift.sources import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("args, want", [
    (("npm", "@types", "node", "1.0"), "pkg:npm/@types/node@1.0"), (("Maven", "org.x", "org.x:a", "1"), "pkg:maven/org.x/a@1"), (("Maven", None, "a", "1"), "pkg:maven/a@1"),
    (("Go", "github.com/o", "r", "1"), "pkg:golang/github.com/o/r@1"), (("Rust", "crates.io", "serde", "1"), "pkg:cargo/serde@1"), (("PHP", "packagist.org/x", "y", "1"), "pkg:composer/y@1"),
    (("hex", None, "p", "1"), "pkg:hex/p@1"), (("Debian", "debian", "curl", "7"), "pkg:deb/debian/curl@7"),
])
def test_purls(spark, args, want):
    assert one(spark, N.package_url(*[F.lit(a) for a in args])) == want


def test_parse_purl(spark):
    assert tuple(one(spark, N.parse_purl(F.lit("pkg:npm/a/b@1")))) == ("npm", "a/b", "1")
    assert [one(spark, N.parse_purl(F.lit(x))) for x in ("pkg:npm/a", "npm/a@1", "pkg:npm/@a/b@1", None)] == [None] * 4


def test_osv_names(spark):
    assert one(spark, N.osv_name(F.lit("npm"), F.lit("@types"), F.lit("node"))) == "@types/node"
    assert one(spark, N.osv_name(F.lit("Maven"), F.lit("g"), F.lit("g:a"))) == "g:a" and one(spark, N.osv_name(F.lit("Rust"), F.lit("crates.io"), F.lit("serde"))) == "serde"


@pytest.mark.parametrize("package, eco, old, new, breaking, said", [
    ("x", None, "1.2.3", "2.0.0", True, "Major"), ("x", None, "1.2.3", "1.2.4", False, "Patch update"), ("github.com/a/b", "Go", "1.0.0", "2.0.0", True, "import paths"),
    ("serde", "Rust", "0.8.0", "0.9.0", True, "Pre-1.0 Rust"), ("x", None, "1.0", "1.9", False, "Minor version jump"), ("x", None, "a", "2", None, None), ("x", None, "2.0", "1.0", None, None),
    ("react", "JavaScript", "17.0.0", "18.0.0", True, "React 17→18"),
])
def test_upgrade_impact(spark, package, eco, old, new, breaking, said):
    found = one(spark, U.upgrade_impact(F.lit(package), F.lit(eco).cast("string"), F.lit(old), F.lit(new)))
    assert found.breaking is breaking and (found.note is None if said is None else said in found.note)


def test_config_diff(spark):
    pairs = [(1, '{"a": {"b": {"c": 1, "d": 2}}}', '{"a": {"b": {"d": 3, "e": {"f": 1}}}}'), (2, None, '{"x": 1}'), (3, "no json", "{}"), (4, '{"a": [1]}', '{"a": {"b": 1}}')]
    found = rows(audit.config_diff(spark.createDataFrame(pairs, "id long, old string, new string"), "id"))
    assert found == [(1, "a.b.c", "removed"), (1, "a.b.e", "added"), (2, "x", "added")]


@pytest.mark.parametrize("strategy, want", [
    ("strict", ("LOW", ["b"], ["x", "y"], True, 0.1, False)), ("permissive", ("HIGH", ["a", "b", "c"], None, False, 0.5, True)), ("override", ("HIGH", ["b", "c"], ["y"], False, 0.5, True)),
])
def test_merge_policies(spark, strategy, want):
    schema = "project long, at long, severity string, allow array<string>, deny array<string>, kev_gate boolean, epss double, vex_auto boolean"
    df = spark.createDataFrame([(1, 1, "LOW", ["a", "b"], ["x"], True, 0.1, False), (1, 2, None, None, None, False, None, True), (1, 3, "HIGH", ["b", "c"], ["y"], False, 0.5, True)], schema)
    r = audit.merge_policies(df, strategy).first()
    assert (r.severity, r.allow, r.deny, r.kev_gate, r.epss, r.vex_auto) == want
    assert audit.merge_policies(df.limit(0), strategy).count() == 0


def test_api_diff(spark):
    schema = "class string, methods array<string>, fields array<string>"
    old, new = spark.createDataFrame([("A", ["m", "n"], None), ("B", None, None)], schema), spark.createDataFrame([("A", ["n"], ["f"]), ("C", [], [])], schema)
    assert rows(upgrades.api_diff(old, new)) == [("A", "AddedField", "f"), ("A", "RemovedMethod", "m"), ("B", "RemovedClass", "B"), ("C", "AddedClass", "C")]


def test_breaking_changes_of_releases(spark):
    body = "# Breaking Changes\n- one\n* two\ntext\n## Other\n- not\n**breaking**: three\n### breaking\n1. four"
    df = spark.createDataFrame([("p", 0, "3", body, "1", "2"), ("p", 1, "2", "## Breaking\n- five", "1", "2"), ("p", 2, "1", "# breaking\n- six", "1", "2")], "package string, position long, version string, body string, old string, new string")
    assert rows(upgrades.release_breaking_changes(df, "old", "new")) == [("p", "2", "five")]
    assert [r[2] for r in rows(upgrades.release_breaking_changes(df.withColumn("new", F.lit("3")).withColumn("old", F.lit("2")), "old", "new"))] == ["four", "one", "three", "two"]


def test_nevra_and_layers(spark):
    assert tuple(one(spark, containers.nevra(F.lit("openssl-1.0.2k-25.el7_9")))) == ("openssl", "1.0.2k-25.el7_9") and one(spark, containers.nevra(F.lit("a-1"))) is None
    layers = spark.createDataFrame([(1, 1, "org:core"), (1, 2, "libssl-dev"), (1, 2, "libssl-dev")], "image long, layer long, package string")
    findings = spark.createDataFrame([(1, "C1", "core"), (1, "C2", "libssl"), (1, "C3", "other"), (2, "C1", "core"), (1, "C1", "core")], "image long, cve string, package string")
    assert rows(containers.layer_attribution(layers, findings)) == sorted([(1, 1, "C1", "core"), (1, 2, "C2", "libssl"), (1, None, "C3", "other"), (2, None, "C1", "core")], key=str)


def test_licences(spark):
    assert one(spark, licences.license_info(F.lit("AGPL-3.0-only"))).copyleft and one(spark, licences.license_info(F.lit("x"))) is None
    assert one(spark, licences.license_obligations(F.lit(None).cast("string"))) == [] and one(spark, licences.normalize_license(F.lit("GPLv2"))) == "GPL-2.0-only"


def test_feeds_of_odd_texts(spark):
    docs = spark.createDataFrame([(None,), ("",), ("x",), ("{}",), ("[]",)], "value string")
    for parse in (feeds.nvd, feeds.ghsa, feeds.syft, feeds.syft_edges, feeds.layer_efficiency, feeds.maven_install, feeds.maven_install_edges, feeds.secrets, feeds.threat_feed):
        assert parse(docs).count() == 0
    assert feeds.threat_feed(docs, "csv").count() == 0 and feeds.threat_feed(docs, "osv").count() == 0
