"""Hard-negative mining with exact integer scores from Four-Russians tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import sized_join

#: Anchors and candidates of one group, and the anchors and candidates whose sums are held at once in it.
ANCHORS, CANDIDATES, LANES, STEP = 1024, 16_384, 64, 1024


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (row, plane, group): bit i of a byte is that plane's bit of the group's i-th dimension, in two's complement."""
    planes = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """Tables (group, byte, anchor): for each group of eight dimensions, the sum of an anchor's components over each subset."""
    groups = -(-anchors.shape[1] // 8)
    padded = np.zeros((groups * 8, len(anchors)), dtype)
    padded[: anchors.shape[1]] = anchors.T
    tables = np.zeros((groups, 1, len(anchors)), dtype)
    for i in range(8):
        tables = np.concatenate([tables, tables + padded.reshape(groups, 8, -1)[:, i : i + 1]], axis=1)
    return tables


def lookup_scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor): from the sign's plane down, shift what there is and add each group's table entry."""
    bits, groups = planes.shape[1:]
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    for b in range(bits - 1, -1, -1):
        if b < bits - 1:
            total <<= 1
        for g in range(groups):
            found = tables[g].take(planes[:, b, g], axis=0)
            if b == bits - 1:
                total -= found  # the sign's plane weighs less than nothing
            else:
                total += found
    return total


def _scores(group: pa.Table, anchors: pa.Table, bits: int, bound: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores by anchor and candidate) for a few anchors at a time."""
    if not group.num_rows or not anchors.num_rows:
        return
    packed = group.column("planes").to_pylist()
    planes = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), bits, -1)
    values = np.frombuffer(b"".join(anchors.column("q").to_pylist()), np.int64).reshape(anchors.num_rows, -1)
    dtype = np.int32 if bound < 1 << 31 else np.int64
    for at in range(0, len(values), LANES):
        tables = subset_sums(values[at : at + LANES], dtype)
        parts = [lookup_scores(planes[i : i + STEP], tables) for i in range(0, len(planes), STEP)]
        yield at, np.ascontiguousarray(np.concatenate(parts).T)


def _best(scores: np.ndarray, order: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The `most` best of `rows`: higher scores first, ties by place in `order`."""
    if len(rows) > most:
        least = np.partition(scores[rows], len(rows) - most)[len(rows) - most]
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((order[rows], -scores[rows].astype(np.int64)))][:most]


def _deal(candidates: DataFrame, anchors: DataFrame, rows: DataFrame, on: list[str], block: int, lane: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors with equal `on`, dealt so that each pair meets in the one group of its two blocks (a, b).

    A group gets some `block` candidates and `lane` anchors, however many have one value of `on`. `rows` are the
    candidates before packing, which are counted.
    """
    many = lambda rows, size, name: rows.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = cut(many(anchors, lane, "as").join(many(rows, block, "bs"), on))
    own = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = sized_join(candidates, blocks, on).withColumn("b", own("bs")).withColumn("a", each("as")).drop("as", "bs")
    right = sized_join(anchors, blocks, on).withColumn("a", own("as")).withColumn("b", each("bs")).drop("as", "bs")
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both come from one table


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = CANDIDATES, lane: int = ANCHORS,
) -> DataFrame:
    """For each anchor and positive, its negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor. An anchor's positives are
    its `positives` best other rows of its label; a positive's negatives are the `negatives` best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by
    smaller id. `anchors` is a condition on the columns of `vectors`.

    Scores are exact. For each group of eight dimensions an anchor has a table of its sums over all 256 subsets. A
    candidate travels as bit planes; each byte of a plane is an index into a table, and shifted sums of what is found are
    the score. Anchors meet all candidates in pairs of blocks: first those of their own label, for the positives,
    then all others, which by then are held against the positives' scores. A group keeps its best rows only, so at most
    `positives` or `negatives` rows leave a group for what they belong to, and memory is bounded by the two block sizes.

    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of different dimensions
    don't meet. Rows repeated with one id, label and vector count once; other rows with one id are rows of their own,
    "other" to each other, and ties between them go by a hash of label and vector. A null id is no anchor, as its
    condition is null, and comes last among ties. An anchor without positives, or a positive without negatives, has no rows. An empty table
    gives an empty result; other columns are read by `anchors` alone. Scores must fit in a long, else a ValueError is raised.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).where(F.col("label").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)) & (F.size("v") > 0))
    rows = rows.groupBy("id", "label", "v").agg(F.max("asked").alias("asked"))
    rows = cut(rows.withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("id", "label", "v")))
    least, most, width = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max("dim")).first()
    biggest = max([1, *(abs(math.floor(x * float(scale))) for x in (least, most) if x is not None)])
    bits, bound = biggest.bit_length() + 1, (width or 1) * biggest << biggest.bit_length()
    if bound * max(100, low, high) >= 1 << 63:
        raise ValueError("scores of these vectors don't fit in a long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bit planes of candidates; of anchors their components too."""
        for batch in batches:
            sizes = np.asarray(batch.column("dim"))
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                for at in range(0, part.num_rows, STEP):
                    some = part.slice(at, STEP)
                    values = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                    values = np.floor(values * scale).astype(np.int64)
                    planes = pa.array([x.tobytes() for x in bit_planes(values, bits)], pa.binary())
                    q = pa.array([v.tobytes() if a else None for v, a in zip(values, some.column("asked").to_pylist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "label", "dim", "key")), planes, q], names=["id", "label", "dim", "key", "planes", "q"])

    packed = cut(rows.mapInArrow(pack, f"id {kind}, label string, dim int, key long, planes binary, q binary"))
    candidates, asked = packed.drop("q"), packed.where("q is not null").drop("planes")

    def order_of(group: pa.Table) -> np.ndarray:
        """Places of the candidates by id, nulls last, and key."""
        turn = np.asarray(pc.sort_indices(group, sort_keys=[("id", "ascending"), ("key", "ascending")], null_placement="at_end"))
        order = np.empty(len(turn), np.int64)
        order[turn] = np.arange(len(turn))
        return order

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, order, out = np.asarray(left.column("key")), order_of(left), []
        mine = np.asarray(right.column("key"))
        for at, scores in _scores(left, right, bits, bound):
            for i, s in enumerate(scores):
                best = _best(s, order, np.flatnonzero(keys != mine[at + i]), positives)
                out.append((np.full(len(best), at + i), best, s[best]))
        a, c, s = (np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(3))
        return pa.table({
            "key": right.column("key").take(pa.array(a)), "positive_id": left.column("id").take(pa.array(c)),
            "positive_key": left.column("key").take(pa.array(c)), "positive_score": pa.array(s),
        })

    on = ["dim", "label"]
    left, right = _deal(candidates, asked, rows, on, block, lane)
    group = [*on, "a", "b"]
    schema = f"key long, positive_id {kind}, positive_key long, positive_score long"
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(find_positives, schema)
    turn = W.partitionBy("key").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_key")
    found = found.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= positives)
    held = cut(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_id", "positive_score"))).alias("found")))
    asked = asked.join(held, "key")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, order, out = np.asarray(left.column("label").to_pylist(), object), order_of(left), []
        theirs, held = right.column("label").to_pylist(), right.column("found").to_pylist()
        for at, scores in _scores(left, right, bits, bound):
            for i, s in enumerate(scores):
                other = labels != theirs[at + i]
                for p in held[at + i]:
                    score, wide = p["positive_score"], s.astype(np.int64) if 100 * bound >= 1 << 31 else s
                    rows = np.flatnonzero(other & (wide * 100 >= low * score) & (wide * 100 <= high * score))
                    best = _best(s, order, rows, negatives)
                    out.append((np.full(len(best), at + i), np.full(len(best), p["turn"]), np.full(len(best), score), best, s[best]))
        a, t, p, c, s = (np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for k in range(5))
        return pa.table({
            "key": right.column("key").take(pa.array(a)), "turn": pa.array(t.astype(np.int32)), "positive_score": pa.array(p),
            "negative_id": left.column("id").take(pa.array(c)), "negative_key": left.column("key").take(pa.array(c)), "negative_score": pa.array(s),
        })

    left, right = _deal(candidates, asked, rows, ["dim"], block, lane)
    group = ["dim", "a", "b"]
    schema = f"key long, turn int, positive_score long, negative_id {kind}, negative_key long, negative_score long"
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(find_negatives, schema)
    best = W.partitionBy("key", "turn").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_key")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asked.select("key", F.col("id").alias("anchor_id"), F.explode("found").alias("p")).select("key", "anchor_id", F.col("p.turn").alias("turn"), "p.positive_id")
    return found.join(named, ["key", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
