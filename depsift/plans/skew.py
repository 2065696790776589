"""Joins whose hot keys are split over tasks, and running sums over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.plans.lineage import cut

#: Rows of a table that is broadcast; larger ones are joined by a shuffle.
SMALL = 300_000
#: Rows of a key that one task may get, keys that are split, and parts of one key.
HOT, KEYS, PARTS = 200, 1000, 1024
#: Pairs that one task of `paired_join` makes, and its tasks at most.
PAIRS, MOST_TASKS = 500_000, 4096


def sized_join(rows: DataFrame, small: DataFrame, keys: list[str], most: int = SMALL) -> DataFrame:
    """Inner join with a checkpointed table, which is counted first and broadcast if it has at most `most` rows."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, keys)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], turn: str, how: str = "inner", size: str | None = None, hot: int = HOT) -> DataFrame:
    """`rows` joined with `groups`, which has one row a key; the rows of hot keys are dealt over several tasks.

    Keys with over `hot` rows, the KEYS largest of them, are dealt into at most PARTS parts by the hash of column
    `turn`, and their group's row is repeated for each part. These keys, KEYS rows at most, are collected and
    broadcast; every key beyond them holds less than one row in KEYS, and without any the join is a plain one.
    `size` names a column of `groups` with the number of rows a key has; without it rows are counted. Null keys join
    nothing, as in any join.
    """
    counts = groups.select(*keys, F.col(size).alias("__n")) if size else rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    parts = F.least(F.ceil(F.col("__n") / hot), F.lit(PARTS)).cast("int").alias("__parts")
    top = counts.where(F.col("__n") > hot).orderBy(F.desc("__n"), *keys).limit(KEYS).select(*keys, parts)
    found = top.collect()
    if not found:
        return rows.join(groups, keys, how)
    top, many = F.broadcast(rows.sparkSession.createDataFrame(found, top.schema)), F.coalesce("__parts", F.lit(1))
    left = rows.join(top, keys, "left").withColumn("__part", F.pmod(F.xxhash64(turn), many).cast("int")).drop("__parts")
    right = groups.join(top, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def paired_join(rows: DataFrame, others: DataFrame, keys: list[str], pairs: int = PAIRS) -> DataFrame:
    """Inner join that makes many more rows than it reads: there are as many tasks as `pairs` rows each ask for, and keys with more pairs are dealt over several.

    Pairs are counted by key first. Rows of a key are dealt by the hash of the whole row, the other side's are repeated for each part.
    """
    n, m = (df.groupBy(*keys).agg(F.count("*").alias(c)) for df, c in ((rows, "__n"), (others, "__m")))
    each = cut(n.join(m, keys).select(*keys, (F.col("__n") * F.col("__m")).alias("__pairs")))
    total = each.agg(F.sum("__pairs")).first()[0] or 0
    hot = each.where(F.col("__pairs") > pairs).select(*keys, F.least(F.ceil(F.col("__pairs") / pairs), F.lit(PARTS)).cast("int").alias("__parts"))
    left, right, on = rows, others, keys
    if not hot.isEmpty():
        dealt, many = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int"), F.coalesce("__parts", F.lit(1))
        left = rows.join(hot, keys, "left").withColumn("__part", dealt).drop("__parts")
        right = others.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
        on = [*keys, "__part"]
    tasks = max(1, min(MOST_TASKS, -(-total // pairs)))
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on).drop("__part")


def numbered(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Checkpointed rows with their place in a total order, from 1, with no task that sees all rows.

    Rows are dealt by range, sorted inside each range and numbered as they are written; the numbers of rows in the
    ranges before, one for each partition, come through the driver. Rows that `order` doesn't tell apart get places
    next to each other in any order.
    """
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # monotonically_increasing_id holds the partition above 33 bits of row numbers
    found = parts.groupBy(F.shiftright("__at", 33).cast("int").alias("__range")).agg(F.count("*").alias("n")).orderBy("__range").collect()
    before, at = [], 0
    for r in found:
        before.append((r[0], at))
        at += r[1]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__range int, __n long"))
    placed = parts.withColumn("__range", F.shiftright("__at", 33).cast("int")).join(offsets, "__range")
    return placed.withColumn(rank, F.col("__n") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__range", "__n", "__at")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], rank: str) -> DataFrame:
    """Rows with their place in a total order and sums up to each row, it included, with no task that sees all rows.

    Rows are dealt by range and numbered inside each range; what the ranges before hold, a row for each range, comes
    through the driver. `order` must tell rows apart. `sums` maps new columns to what is added up.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inside = W.partitionBy("__range").orderBy(*order)
    found = parts.groupBy("__range").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values())]).orderBy("__range").collect()
    before, at = [], [0] + [0.0] * len(sums)
    for r in found:
        before.append((r[0], *at))
        at = [a + (b or 0) for a, b in zip(at, r[1:])]
    schema = "__range int, __n long" + "".join(f", __s{i} double" for i in range(len(sums)))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, schema))
    out = parts.join(offsets, "__range").withColumn(rank, F.col("__n") + F.row_number().over(inside))
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"__s{i}") + F.sum(c).over(inside))
    return out.drop("__range", "__n", *[f"__s{i}" for i in range(len(sums))])


def ordered(rows: DataFrame, order: list[Column], sums: dict[str, Column], rank: str, most: int = SMALL) -> DataFrame:
    """`running` for a table that is mostly small: counted first, and ordered in one task if it has at most `most` rows."""
    if rows.count() > most:
        return running(rows, order, sums, rank)
    run = W.orderBy(*order)
    out = rows.withColumn(rank, F.row_number().over(run).cast("long"))
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(run))
    return out
