"""Look-alike names against all pairs, and the edges of licences and feedback."""

import random

from pyspark.sql import functions as F

from depsift.operators import supply


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_typosquats_equal_all_pairs(spark):
    rng = random.Random(5)
    known = ["".join(rng.choices("abcé-", k=rng.randint(0, 24))) for _ in range(60)] + [None]
    names = [None, "", "a", *known[:5]]
    for base in known[:60] * 4:
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(text))
            text[at : at + rng.randint(0, 1)] = rng.choices("abcé-", k=rng.randint(0, 1))
        names.append("".join(text))
    want = {}
    for n in {x for x in names if x is not None}:
        for k in {x for x in known if x is not None}:
            d = edits(n, k)
            if 1 <= d <= 2 and 1 - d / max(len(n), len(k)) > 0.8:
                want[n] = min(want.get(n, (9, "")), (d / max(len(n), len(k)), k))
    frame = lambda rows, c: spark.createDataFrame([(x, 1) for x in rows], f"{c} string, known int" if c == "name" else "name string, size int")
    found = supply.typosquats(frame(names, "name"), frame(known, "known")).collect()
    assert want and {r["name"]: r["known"] for r in found} == {n: k for n, (_, k) in want.items()}


def test_typosquats_of_nothing(spark):
    empty = spark.createDataFrame([], "name string")
    assert supply.typosquats(empty, empty).count() == 0


def test_license_compatibility_rules(spark):
    cases = [
        ("MIT", "MIT", "Safe"), ("X", "X", "Safe"), ("MIT", "AGPL-3.0-only", "Critical"), ("Apache-2.0", "GPL-3.0-only", "Medium"),
        ("Apache-2.0", "GPL-2.0-only", "High"), ("GPL-3.0-only", None, "Safe"), ("MIT", "NONE", "High"), ("MIT", None, "High"),
        ("BSD-2-Clause", "GPL-2.0-only", "Medium"), (None, "MIT", "Medium"), ("NONE", "NONE", "Safe"),
    ]
    rows = spark.createDataFrame(cases, "p string, d string, want string")
    assert rows.where(supply.license_compatibility(F.col("p"), F.col("d")) != F.col("want")).count() == 0


def test_upgrade_success_counts_nulls_as_failures(spark):
    rows = spark.createDataFrame([("a", "1", "2", True, None), ("a", "1", "2", None, "x"), ("a", "1", "2", False, "x")], "package string, from_version string, to_version string, success boolean, issue string")
    got = supply.upgrade_success(rows).first()
    assert (got["attempts"], got["successes"], got["failures"], got["issues"], round(got["rate"], 4)) == (3, 1, 2, ["x"], 0.3333)
