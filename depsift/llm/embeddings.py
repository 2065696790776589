"""Embedding near-dedup: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.llm.runs import sorted_runs
from depsift.operators.components import connected_components
from depsift.plans.lineage import cut
from depsift.plans.skew import spread_join

#: Vectors of one cell and label that are compared in one group; larger ones are compared block by block.
BLOCK = 4096
#: Blocks of vectors beyond which a cell of one label is parted into cells of its own, cells that it may have, and vectors they are found on.
WIDE, INNER, INNER_SAMPLE = 16, 64, 2048
#: The k-means sample: at most this many vectors and numbers.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 4_000_000


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of at most `cells` cells."""
    x, rng = _unit(sample), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def cells_of(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the home cells, followed by the lower-numbered cells that a vector visits.

    A vector visits a cell if it lies within acos(threshold) of the plane that parts this cell from its
    home; any vector of the cell at the threshold or above is then met there, so no link is lost.
    """
    x = _unit(vectors)
    s = x @ centres.T
    home = s.argmax(axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-6
    near = s[np.arange(len(x)), home][:, None] - s <= reach * gap[home] + 1e-9
    near &= np.arange(len(centres))[None] < home[:, None]
    rows, cells = np.nonzero(near)
    return np.r_[np.arange(len(x)), rows], np.r_[home, cells]


def _matrix(column: pa.ChunkedArray | pa.Array, number: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)


def _links(table: pa.Table, threshold: float, number: str = "<f4") -> tuple[np.ndarray, np.ndarray]:
    """Linked-copies sums of the group's rows, and for each row the least row of its component."""
    m = _matrix(table.column("vec"), number)
    home, inner, own = (table.column(c).to_numpy() for c in ("home", "inner", "own"))
    copies = table.column("n").to_numpy()
    whole = table.column("a")[0] == table.column("b")[0]
    norm = np.linalg.norm(m, axis=1)
    adjacent, sums = np.zeros((len(m), len(m)), bool), np.zeros(len(m), np.int64)
    for i in range(0, len(m), 512):
        part = slice(i, min(i + 512, len(m)))
        cosine = m[part] @ m.T / (norm[part, None] * norm[None])
        meet = (home[part, None] | home[None]) & (inner[part, None] | inner[None])
        adjacent[part] = (cosine >= threshold) & (meet if whole else meet & (own[part, None] != own[None]))
        adjacent[np.arange(part.start, part.stop), np.arange(part.start, part.stop)] = False
        sums[part] = adjacent[part] @ copies
    label = np.arange(len(m))
    seen = np.zeros(len(m), bool)
    for seed in np.flatnonzero(adjacent.any(axis=1)):
        if seen[seed]:
            continue
        todo = np.array([seed])
        while len(todo):
            seen[todo] = True
            label[todo] = seed
            todo = np.flatnonzero(adjacent[todo].any(axis=0) & ~seen)
    return sums, label


def _part_wide(dealt: DataFrame, large: DataFrame, key: list[str], columns: str, block: int, threshold: float, number: str) -> DataFrame:
    """Dealt vectors with `sub`, their cell inside a large cell, and `inner`, whether it is their home there; 0 and true elsewhere."""
    plain = lambda rows: rows.withColumn("sub", F.lit(0)).withColumn("inner", F.lit(True))
    if large.isEmpty():
        return plain(dealt)
    rows = dealt.join(large, key)
    turn = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("id"), "id"))
    few = rows.withColumn("turn", turn).where(F.col("turn") <= INNER_SAMPLE).select(*key, "rows", "vec")

    def found(group: pa.Table) -> pa.Table:
        sample = _matrix(group.column("vec"), number)
        many = min(INNER, max(1, len(sample) // 8), -(-group.column("rows")[0].as_py() // block))
        return pa.table({**{c: group.column(c).slice(0, 1) for c in key}, "centres": pa.array([spherical_kmeans(sample, many).tobytes()], pa.binary())})

    centres = cut(few.groupBy(*key).applyInArrow(found, "dim int, cell int, label string, centres binary"))
    many = F.ceil(F.col("rows") / (4 * block)).cast("int")
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), many)).drop("rows")
    right = centres.join(large, key).withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    right = right.select(*[F.col(c).alias(c) for c in (*key, "part", "centres")])

    def deal(vectors: pa.Table, given: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return vectors.drop_columns(["part"]).append_column("sub", pa.array([], pa.int32())).append_column("inner", pa.array([], pa.bool_()))
        m = _matrix(vectors.column("vec"), number)
        row, cell = cells_of(m, np.frombuffer(given.column("centres")[0].as_py()).reshape(-1, m.shape[1]), threshold)
        out = vectors.drop_columns(["part"]).take(pa.array(row))
        return out.append_column("sub", pa.array(cell.astype(np.int32))).append_column("inner", pa.array(np.arange(len(row)) < len(m)))

    inside = left.groupBy(*key, "part").cogroup(right.groupBy(*key, "part")).applyInArrow(deal, f"{columns}, sub int, inner boolean")
    return plain(dealt.join(large, key, "left_anti")).unionByName(cut(inside))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    block: int = BLOCK, sample_rows: int = SAMPLE_ROWS, wide: int = WIDE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors are compared when their labels are equal and not null and their dimensions agree; a pair is
    linked at cosine >= threshold in double precision. Vectors that are null, zero or hold null or non-finite
    numbers link with nothing and are components of their own. Equal vectors are compared once, as a class
    with a count; a vector linked to a class counts all its rows, its own other copies included.

    Cells come from spherical k-means on a bounded sample, every vector is dealt to its cell and to those it
    may have partners in (`cells_of`). A (cell, label) of more than `wide` blocks is parted in the same way into cells of its own, found on
    a sample of it by the tasks that have it, so cells follow the rows. Each cell is then multiplied block by block; large ones are
    dealt into pairs of blocks, so that no task gets a whole hot cell. A group returns sums and a spanning
    forest, never pairs. Cells are as many as blocks of `block` vectors a label, a quarter of the root of all
    vectors at most. Numbers keep their precision: float arrays travel as floats, others as doubles. A null id is
    a vector as well. An empty table gives an empty result; other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    number = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("id", F.concat_ws(":", F.coalesce(F.col("first").cast("string"), F.lit("-")), F.hex(F.xxhash64("v", "label")))))
    total, width, labelled = classes.agg(F.count("*"), F.max(F.size("v")), F.approx_count_distinct("label")).first()
    limit = max(1, min(sample_rows, SAMPLE_NUMBERS // max(1, width or 1)))
    by_size: dict[int, list] = {}
    for r in classes.select("v").orderBy(F.xxhash64("v")).limit(limit).collect():
        by_size.setdefault(len(r[0]), []).append(r[0])
    many = max(1, min(int(np.sqrt(total) / 4), int(total / max(1, labelled) / block)))  # no more cells than full blocks
    centres = {d: spherical_kmeans(np.array(x, np.float64), min(many, max(1, len(x) // 8))) for d, x in by_size.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = batch.column(1)
            sizes = np.array([len(v) for v in vecs])
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                m = np.array(part.column(1).to_pylist(), number)
                centre = centres.get(int(d), np.eye(1, int(d)))
                row, cell = cells_of(m.astype(np.float64), centre, threshold)
                raw = [x.tobytes() for x in m]
                arrays = [
                    pa.array(np.full(len(row), d, np.int32)), pa.array(cell.astype(np.int32)), part.column(0).take(pa.array(row)),
                    pa.array(np.arange(len(row)) < len(m)), part.column(2).take(pa.array(row)), part.column(3).take(pa.array(row)),
                    pa.array([raw[i] for i in row], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["dim", "cell", "label", "home", "id", "n", "vec"])

    columns = "dim int, cell int, label string, home boolean, id string, n long, vec binary"
    key = ["dim", "cell", "label"]
    dealt = cut(classes.select("label", "v", "id", "n").mapInArrow(deal, columns))
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("rows"))
    dealt = _part_wide(dealt, cut(sizes.where(F.col("rows") > wide * block)), key, columns, block, threshold, number)
    key = [*key, "sub"]
    large = dealt.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    large = large.select(*key, F.ceil(F.col("rows") / block).cast("long").alias("blocks"))
    dealt = dealt.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key += ["a", "b"]
    dealt = dealt.select(*key[:-2], F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "home", "inner", "id", "n", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, len(key)):
            if group.num_rows < 2:
                continue
            sums, label = _links(group, threshold, number)
            some = np.flatnonzero(sums)
            ids = group.column("id")
            arrays = [ids.take(pa.array(some)).combine_chunks(), ids.take(pa.array(label[some])).combine_chunks(), pa.array(sums[some].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "root", "links"])

    found = cut(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "id string, root string, links long"))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("id", "root").distinct(), "id", "root").withColumnRenamed("node", "id")
    classes = classes.join(sums, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    roots = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = spread_join(classes, roots, ["component"], "id").select("n", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = spread_join(rows.where("usable"), classes, ["label", "v"], "vec_id", size="n").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).select(F.col("vec_id").cast(kind), "n_links", "component_id", "kept")
