"""Exact dedup by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import spread_join

#: A chunk runs from MIN_CHUNK to MAX_CHUNK characters and ends at the first sentence or line end between.
MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunked(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Cut a text at content-defined places; concatenating the chunks gives the text back."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{low},{high}}}?(?:[.!?\n]|$)|.{{1,{high}}}"), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(F.encode(chunk, "UTF-8"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A text becomes a recipe: the ordered list of its chunks' identifiers. An identifier is a SHA-256 digest
    that counts as verified once all chunks carrying it are the same string; distinct chunks cross the
    network once, after a map-side combine, and from then on only recipes move. Equal recipes of verified
    identifiers mean equal texts; a digest shared by different chunks stops the job. Recipes are cut once and
    written; only those that stand twice or more are joined, and the rows of a text with very many copies are
    split over tasks.

    Null text counts as empty; empty texts form one group. Of equal texts the row with the largest
    (`keep="max"`) or smallest id stays. Rows repeated with the same id and text count in group_size, one
    row is returned for each, and of those with the kept id all say kept. A null id never wins over another
    id. An empty table gives an empty result; other columns are ignored, so their names cannot clash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    recipes = cut(base.select(
        "doc_id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.transform(chunked(F.col("text")), digest).alias("recipe"),
    ))
    chunks = base.select(F.explode(chunked(F.col("text"))).alias("chunk"))
    identifiers = (
        chunks.select(digest(F.col("chunk")).alias("id"), "chunk")
        .groupBy("id").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .select("id", (F.col("least") == F.col("most")).alias("verified"))
    )
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    shared = cut(recipes.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("many")).where("many > 1"))
    checked = (
        shared.select("recipe", F.explode_outer("recipe").alias("id"))
        .join(identifiers, "id", "left")
        .groupBy("recipe").agg(F.bool_and(F.coalesce("verified", F.col("id").isNull())).alias("verified"))
    )
    groups = cut(shared.join(checked, "recipe").select(
        "recipe",
        F.when(F.col("verified"), F.col("many")).otherwise(F.raise_error(F.lit("two chunks share a digest")).cast("long")).alias("many"), "best",
    ))
    rows = spread_join(recipes, groups, ["recipe"], "doc_id", "left", size="many")
    rows = rows.withColumn("keep_id", F.when(F.col("many").isNull(), F.col("doc_id")).otherwise(F.col("best")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.select("doc_id", "keep_id", F.coalesce("many", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
