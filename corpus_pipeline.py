"""A corpus from raw documents to packed training sequences."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from depsift.llm import exact, langid, mixing, packing, simhash
from depsift.plans.lineage import ensure_checkpoint_dir, remove


def free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows.

    Null, empty and letterless texts go, and so do texts that the model rejects; long ones are read whole.
    Repeated rows are judged alike. Without a labelled row to learn from, as in an empty table, all rows go. All
    columns stay, extra ones too.
    """
    return langid.accepted(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id; null counts as empty text.

    A null doc_id wins over none but null ones. Of rows repeated with one doc_id and text one stays. Texts of any
    length are compared as recipes of chunks. An empty table stays empty; all columns stay, extra ones too.
    """
    name = free(docs, "__key")
    key = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), sha)
    kept = exact.exact_dedup(docs).where("kept").select(key(F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, key(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)))
    # rows repeated with one doc_id and text have one key, and stay together after the join
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that with the smallest doc_id.

    Rows with a null doc_id all stay, as do repeated rows of a doc_id that stays. Null, empty and wordless texts
    are copies of each other. An empty table stays empty; all columns stay, extra ones too.
    """
    groups = simhash.near_duplicate_groups(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, null and empty texts included.

    Rows meet their number of copies by a digest of doc_id, source and text, so null ids do not gather; repeated
    rows share the copies taken of them. A null source is a source of its own. An empty table stays empty; all
    columns stay, extra ones too.
    """
    key, turn, taken, times = (free(docs, x) for x in ("__key", "__turn", "__taken", "__times"))
    digest = lambda mark: F.struct(F.xxhash64("doc_id", "source", mark).alias("x"), F.hash("source", mark, "doc_id").alias("y"))
    mixed = mixing.mix_sources(docs).groupBy(digest(F.col("mark")).alias(key)).agg(F.sum("copies").alias(taken), F.count("*").alias(times))
    rows = docs.withColumn(key, digest(F.xxhash64("text"))).join(mixed, key)
    rows = rows.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(key)))
    share = lambda n: F.floor(F.col(taken) * n / F.col(times))
    copies = (share(F.col(turn)) - share(F.col(turn) - 1)).cast("int")
    return rows.withColumn(turn, F.explode(F.array_repeat(F.lit(1), copies))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the mix, as op1's query returns them.

    Null and empty texts are one end token, long ones are cut; each repeated row is packed. An empty table gives
    no pieces; other columns are left out.
    """
    return packing.pack_sequences(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL has no tokenizer or trained model; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again.

    Nulls, empty and very long texts, ties, repeated rows and extra columns are each stage's to define; an empty table gives an empty
    result of the last stage's columns.

    A stage's folder goes once the next stage is written; that of the last but one stays, as the result reads it.
    """
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
