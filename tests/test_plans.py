"""Helpers of plans."""

import pytest
from pyspark.sql import functions as F

from depsift.plans import skew


@pytest.mark.parametrize("many", [0, 1, 5000])
def test_numbered_gives_places_in_order(spark, many):
    rows = spark.range(many).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g")).repartition(7)
    found = skew.numbered(rows, [F.col("g").asc_nulls_first(), F.col("k")], "place").collect()
    assert sorted(r.place for r in found) == list(range(1, many + 1))
    assert [(r.g or "", r.k) for r in sorted(found, key=lambda r: r.place)] == sorted((r.g or "", r.k) for r in found)
