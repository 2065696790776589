"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import SMALL, numbered, spread_join


def seeded(id_col: Column, text: Column, seed: int) -> Column:
    """A row's place in the shuffle of its source: a digest of seed and id, or of the text where the id is null."""
    key = F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.concat(F.lit("-"), F.coalesce(text, F.lit(""))))
    return F.md5(F.encode(F.concat(F.lit(f"{seed}/"), key), "UTF-8"))


def shard_documents(
    docs: DataFrame, shards: int = 8, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, fraction, place, shard, slot and, with `keep`, row (a struct of those columns).

    Rows of a source are shuffled by a seeded digest and ranked; the r-th of n rows has the fraction (2 r - 1) / 2 n.
    All rows are sorted by fraction, so that any stretch of the order holds each source in proportion, and the order is
    cut into `shards` stretches whose numbers of rows differ by one at most (law `rows`). A shard's share of a source is
    an equal one but for a row and what the rounding of the other sources shifts the cuts by. `slot` is the place in the shard, from 0. Ranks and places come from two
    sorts by range, so a source with most of the rows is ordered by many tasks.

    Null sources are a source of their own. Null text has one byte of size (as the empty text) and crc32 0. A null id is shuffled by its text.
    Equal digests stand in order of id and crc32; repeated rows are interchangeable and each gets a slot. Texts of any
    length are hashed whole. An empty table gives an empty result; other columns are read only if `keep` names them.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.struct(*keep).alias("row")] if keep else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), seeded(F.col(id_col), F.col(text_col), seed).alias("digest"), *kept,
    )
    # an id of the source that is never null, so that it joins
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    inside = ["group", "digest", "doc_id", "text_crc32"]
    ranked = numbered(rows, [F.col(c) for c in inside], "at")
    sources = cut(ranked.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    if sources.count() <= SMALL:
        ranked = ranked.join(F.broadcast(sources), "group")
    else:
        ranked = spread_join(ranked, sources, ["group"], "digest", size="n")
    ranked = ranked.withColumn("fraction", (2 * (F.col("at") - F.col("first")) + 1) / (2 * F.col("n")).cast("double")).drop("at", "first", "n")
    placed = numbered(ranked, [F.col(c) for c in ["fraction", *inside]], "place").withColumn("place", F.col("place") - 1)
    total = int(sources.agg(F.sum("n")).first()[0] or 0)
    # shard k holds the places from ceil(k * total / shards) on
    shard = F.expr(f"place * {shards} div {max(1, total)}").cast("int")
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
    return placed.select("doc_id", "source", "size", "text_crc32", "fraction", "place", "shard", "slot", *(["row"] if keep else []))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 11, **names: str) -> DataFrame:
    """Write whole rows to Parquet folders `shard=k` under `path` and return what was written, its slots included.

    A file holds a stretch of one shard in order of slots. Rows travel with the two sorts, so no join gathers them and the
    last sort is the order in which files are written. Columns keep their names inside the struct `row`.
    """
    out = shard_documents(docs, shards, seed, keep=tuple(docs.columns), **names).select("shard", "slot", "row")
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
