"""Ported cases of versions, scores and components."""

import random
import re

import pytest
from pyspark.sql import functions as F

from depsift.functions import severity as S
from depsift.functions import versions as V
from depsift.operators.components import connected_components
from depsift.operators.graph import closure

RANGES = "array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"


def events(**bounds):
    return [{"introduced": None, "fixed": None, "last_affected": None, k: v} for k, v in bounds.items()]


@pytest.mark.parametrize("version, kind, bounds, want", [
    ("1.5.0", "SEMVER", {"introduced": "1.0.0", "fixed": "2.0.0"}, True),
    ("1.0.0", "SEMVER", {"introduced": "1.0.0", "fixed": "2.0.0"}, True),
    ("2.0.0", "SEMVER", {"introduced": "1.0.0", "fixed": "2.0.0"}, False),
    ("0.9.0", "SEMVER", {"introduced": "1.0.0", "fixed": "2.0.0"}, False),
    ("1.4.9", "SEMVER", {"introduced": "0", "fixed": "1.5.0"}, True),
    ("2.5.0", "SEMVER", {"introduced": "0", "last_affected": "2.5.0"}, True),
    ("2.5.1", "SEMVER", {"introduced": "0", "last_affected": "2.5.0"}, False),
    ("invalid", "SEMVER", {"introduced": "0"}, None),
    ("cde345", "GIT", {"introduced": "abc123", "fixed": "def456"}, True),
    ("10.0.0", "ECOSYSTEM", {"introduced": "1.0.0", "fixed": "2.0.0"}, True),
])
def test_version_affected(spark, version, kind, bounds, want):
    df = spark.createDataFrame([(version, [{"type": kind, "events": events(**bounds)}])], f"v string, r {RANGES}")
    assert df.select(V.version_affected(F.col("v"), F.col("r"))).first()[0] is want


def test_no_ranges_are_not_affected(spark):
    df = spark.createDataFrame([("1.0.0", [])], f"v string, r {RANGES}")
    assert df.select(V.version_affected(F.col("v"), F.col("r"))).first()[0] is False


@pytest.mark.parametrize("key, ordered", [
    (V.semver_key, ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2.0", "1.10.0"]),
    (V.deb_key, ["1.0~rc1-1", "1.0-1", "1.0-2", "1.2-1", "1.10-1", "1:0.1-1"]),
    (V.rpm_key, ["1.0.2k-25.el7", "1.0.2-1", "1.0.10-1", "1:0.1-1"]),
    (V.apk_key, ["1.2-r1", "1.2-r10", "1.2.1-r0", "1.10-r0"]),
])
def test_keys_sort(spark, key, ordered):
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r[0] for r in df.orderBy(key(F.col("v"))).collect()] == ordered


def _apk_parts(v):
    base, _, release = v.rpartition("-r") if "-r" in v else (v, "", "0")
    numbers = [re.match(r"\d*", p).group() for p in base.split(".")]
    return [int(n) for n in numbers if n], int(release) if release.isdigit() else 0


def _apk_cmp(a, b):
    (x, r), (y, s) = _apk_parts(a), _apk_parts(b)
    n = max(len(x), len(y))
    x, y = x + [0] * (n - len(x)), y + [0] * (n - len(y))
    return ((x, r) > (y, s)) - ((x, r) < (y, s))


def _rpm_cmp(a, b):
    split = lambda v: ((int(v.split(":")[0]) if v.split(":")[0].isdigit() else 0) if ":" in v else 0, re.split(r"[.-]", v.split(":", 1)[-1]))
    (e, x), (f, y) = split(a), split(b)
    rank = lambda p: (1, int(p), "") if p.isdigit() else (0, 0, p)
    n = max(len(x), len(y))
    x, y = (e, [rank(p) for p in x + ["0"] * (n - len(x))]), (f, [rank(p) for p in y + ["0"] * (n - len(y))])
    return (x > y) - (x < y)


def _deb_cmp(a, b):
    """Debian policy, read step by step."""

    def part(x, y):
        while x or y:
            p, q = re.match(r"\D*", x).group(), re.match(r"\D*", y).group()
            x, y = x[len(p):], y[len(q):]
            order = lambda c: -1 if c == "~" else 0 if c == "" else ord(c) if c.isalpha() else ord(c) + 256
            for i in range(max(len(p), len(q))):
                c, d = order(p[i : i + 1]), order(q[i : i + 1])
                if c != d:
                    return (c > d) - (c < d)
            p, q = re.match(r"\d*", x).group(), re.match(r"\d*", y).group()
            x, y = x[len(p):], y[len(q):]
            if int(p or 0) != int(q or 0):
                return 1 if int(p or 0) > int(q or 0) else -1
        return 0

    def split(v):
        epoch, rest = v.split(":", 1) if re.match(r"\d+:", v) else ("0", v)
        up, _, rev = rest.rpartition("-") if "-" in rest else (rest, "", "")
        return int(epoch), up, rev

    (e, u, r), (f, v, s) = split(a), split(b)
    return ((e > f) - (e < f)) or part(u, v) or part(r, s)


DEEP = ["1" + ".1" * 7 + ".1", "1" + ".1" * 7 + ".2", "1" + ".0" * 13 + ".1", "1" + ".0" * 13 + ".2", "1" + ".0" * 13, "1", "1.0", "1.0.0.0", "0", "0.0", ""]


@pytest.mark.parametrize("key, compare, pieces", [
    (V.apk_key, _apk_cmp, ["1", "2", "10", "0", "00", ".", ".0", ".0.0", "a", "_rc1", "-r", "-r1", "-r10", "-rc", "b2"]),
    (V.rpm_key, _rpm_cmp, ["1", "2", "10", "0", ".", ".0", ".0.0", "-0", "a", ".el7", "-", "b c", ".b", "1:", "x:"]),
    (V.deb_key, _deb_cmp, ["1", "2", "10", "0", "00", ".", ".0", "~", "~rc", "-", "-0", "-1", "a", "+b", "1:", "Z"]),
])
def test_keys_equal_comparison_part_by_part(spark, key, compare, pieces):
    rng = random.Random(8)
    versions = DEEP + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(250)]
    keys = dict(spark.createDataFrame([(v,) for v in versions], "v string").select("v", key(F.col("v"))).collect())
    for a in keys:
        for b in keys:
            assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == compare(a, b), (a, b)


@pytest.mark.parametrize("vector, want", [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
    ("CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", 2.2), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("7.5", 7.5), ("x", None),
])
def test_cvss(spark, vector, want):
    assert spark.createDataFrame([(vector,)], "v string").select(S.cvss3_base_score(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("cvss, epss, kev, want", [(8.0, None, True, "P0"), (9.5, None, False, "P0"), (7.5, 0.6, False, "P1"), (2.0, None, False, "P4")])
def test_priority(spark, cvss, epss, kev, want):
    df = spark.createDataFrame([(cvss, epss, kev)], "c double, e double, k boolean")
    assert df.select(S.priority(F.col("c"), F.col("e"), F.col("k"))).first()[0] == want


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(70, 71), (80, 80), (None, 3)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1, 60)} == {1}
    assert found[71] == 70 and found[80] == 80


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    found = closure(edges, spark.createDataFrame([(1,)], "node int"))
    assert sorted((r.node, r.depth) for r in found.collect()) == [(1, 0), (2, 1), (3, 2)]


LONG = "20240101120000.1.2"


@pytest.mark.parametrize("version", [LONG, "9" * 40 + ".1.2", "1." + "9" * 30 + ".0", "", "x", "1..2", None])
def test_odd_versions_stop_nothing(spark, version):
    v, other = F.lit(version).cast("string"), F.lit("1.2.3")
    columns = [V.semver_parts(v), V.parse_version3(v), V.semver_compare(v, other), V.semver_upgrade_risk(v, other), V.major_jumps(v, other), V.breaking_estimate(v, other), V.os_upgrade_risk(v, other)]
    columns += [V.fix_effort_hours(F.lit("HIGH"), v, other, F.lit(1)), S.difficulty_score(F.lit("a"), v, other, F.lit(True)), V.apk_key(v), V.deb_key(v), V.rpm_key(v)]
    assert len(spark.range(1).select(*columns).first()) == len(columns)


def test_long_numbers_sort_by_value(spark):
    ordered = ["1.2.3", LONG, "9" * 25 + ".0.0", "1" + "0" * 25 + ".0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    for key in (V.semver_key, V.apk_key, V.deb_key, V.rpm_key):
        assert [r[0] for r in df.orderBy(key(F.col("v"))).collect()] == ordered


def test_a_hot_key_is_split(spark):
    from depsift.plans.skew import spread_join

    rows = spark.createDataFrame([(i % 7 if i % 2 else 100, i) for i in range(4000)] + [(None, -1)], "k long, i long")
    groups = spark.createDataFrame([(k, f"g{k}", 1) for k in (0, 1, 2, 100)], "k long, g string, n long")
    plain = lambda how: sorted(map(str, rows.join(groups, "k", how).collect()))
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(rows, groups, ["k"], "i", how, hot=50).collect())) == plain(how)


def test_running_sums_over_a_table(spark):
    from depsift.plans.skew import running

    rows = spark.createDataFrame([(None if i == 7 else (i * 37) % 101, float(i)) for i in range(100)], "k long, v double").repartition(5)
    found = sorted((r.k is None, r.k, r.v, r.at, r.s) for r in running(rows, [F.col("k").asc_nulls_last()], {"s": F.col("v")}, "at").collect())
    total = 0.0
    for place, (_, _, v, at, s) in enumerate(found, 1):
        total += v
        assert (at, s) == (place, total)
    assert running(rows.limit(0), [F.col("k").asc()], {"s": F.col("v")}, "at").count() == 0
