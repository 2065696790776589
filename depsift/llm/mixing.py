"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import SMALL, ordered, spread_join

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: The least number of id buckets, and the rows for which there is one more.
BUCKETS, BUCKET_ROWS = 64, 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sixteen classes an octave: the number of binary digits, then the leading four of them."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).cast("int")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources (source, source_size, ...) with their targets: weights in code-point order with null last, shared by water filling.

    The table has one row per source. Each source gets `weight * level`, at most `most * source_size`; the
    level is the one at which the targets add up to `share` of all sizes. Sources may be many: beyond a counted bound their order
    and the sums up to each are those of a range sort.
    """
    last = F.col("source").asc_nulls_last()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = ordered(sources, [last], {}, "place")
    s = s.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = cut(ordered(s, [F.col("ratio").asc(), last], {"caps": F.col("cap"), "weights": F.col("weight")}, "turn"))
    size, all_weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(size or 0) * share
    capped = F.col("caps") + F.col("ratio") * (F.lit(float(all_weights or 0)) - F.col("weights")) <= F.lit(total)
    taken, open_weight = s.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
    level = F.lit((total - (taken or 0.0)) / open_weight if open_weight else 0.0)
    return s.select(*sources.columns, F.when(capped, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def bucket_of(key: Column, mark: Column, buckets: int) -> Column:
    """Bucket of an id by its MD5 digest, or of a null id by the mark of its text."""
    digest = F.md5(F.encode(F.coalesce(key.cast("string"), mark.cast("string")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def offset_of(source: Column, seed: int) -> Column:
    """The source's one random offset in [0, 1), drawn from a digest of seed and source so that reruns agree."""
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, least_buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: doc_id, source, mark, size, source_size, target, copies, taken (mark: a hash of the text).

    Every document of a source expects `target / source_size` copies. Within a source, documents stand in
    order of (size class, bucket, size, id), so the mix takes from all sizes alike; the running sum of
    expected copies plus the source's one random offset is floored, and a document is emitted once for each
    integer boundary its step crosses. Running sums come from counts per (source, class, bucket), which are ordered by range over all sources, and a row
    number inside each, so no source is ever ordered in one task. Buckets are dealt by a digest of the id, of the
    text where that is null, and their number grows with the rows.

    Null text has size 0 and may be taken, adding no words; a source without words has target 0 and takes
    nothing. Null sources form a source of their own, last in order. Equal sizes are ordered by id, then by the
    text's hash; repeated rows are interchangeable. Ids may be of any type. No document is taken more than ceil(most) times. An empty table
    gives an empty result; other columns are ignored.
    """
    sized = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark")
    ))
    buckets = max(least_buckets, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("cls", size_class(F.col("size"))).withColumn("bucket", bucket_of(F.col("doc_id"), F.col("mark"), buckets))
    # a source's name that is never null, so that it joins
    sized = sized.withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    cell = ["group", "cls", "bucket"]
    cells = sized.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("source").alias("source"))
    cells = cut(ordered(cells, [F.col(c) for c in cell], {"upto": F.col("n")}, "place").drop("place"))
    sources = cells.groupBy("group").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"), F.min(F.col("upto") - F.col("n")).alias("first"), F.count("*").alias("cells"))
    targets = source_targets(sources, weights, share, most).drop("source")
    few = targets.count() <= SMALL
    cells = cells.drop("source", "words").join(F.broadcast(targets), "group") if few else spread_join(cells.drop("source", "words"), targets, ["group"], "bucket", size="cells")
    cells = cells.withColumn("before", F.col("upto") - F.col("n") - F.col("first"))
    cells = cells.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    cells = cells.select(*cell, "before", "source_size", "target", "rate")
    inside = W.partitionBy(*cell).orderBy("size", "doc_id", "mark")
    placed = sized.withColumn("at", F.row_number().over(inside)).join(cells, cell).withColumn("u", offset_of(F.col("source"), seed))
    placed = placed.withColumn("rank", F.col("before").cast("long") + F.col("at"))
    step = lambda r: F.floor(r * F.col("rate") + F.col("u"))
    copies = (step(F.col("rank")) - step(F.col("rank") - 1)).cast("long")
    return placed.select("doc_id", "source", "mark", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
