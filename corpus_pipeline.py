"""A corpus pipeline of five stages: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which ``run`` writes as Parquet to the shared folder
and reads again. All stages but the last return the columns of ``docs``. Rows
with the same doc_id, if any, are judged by their own texts; a row without a
doc_id is rejected by the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from svloom.llm import language, mixing, near_dup, packing, toxicity
from svloom.llm.common import free, table
from svloom.ship import removed, settled


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no identifiable language: no text, no letters. Learns from the labelled rows of its input; without any, only these two are rejected."""
    model = language.trained(docs)
    rows = docs.where("doc_id is not null")
    if not model.languages:
        return rows.where(F.col("text").rlike("\\p{L}"))
    return language.identified(rows, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored toxic; learns from the labels of its input's documents."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest doc_id, of each group linked by 5-word shingles at a similarity of 0.8."""
    # a row is named by its doc_id and a hash of its text: rows that share both are taken for repeats of one row
    i, h = (free(docs.columns, c) for c in ("row_id", "row_text"))
    rows = docs.withColumn(i, docs["doc_id"]).withColumn(h, F.xxhash64(docs["text"]))
    found = near_dup.near_duplicates(docs, 5, 80, 100, mark=F.xxhash64(docs["text"])).where("kept")
    # rows may repeat the smallest doc_id; those without words are groups of their own
    alone = F.when(F.col("group").isNull(), F.struct("doc_id", "mark"))
    one = found.groupBy("group", alone).agg(F.min(F.struct(F.col("doc_id").alias(i), F.col("mark").alias(h))).alias("row")).select("row.*")
    return rows.join(one, [i, h], "left_semi").dropDuplicates([i, h]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's share of all words asks for (0 to 3 times)."""
    i, s, n, k = (free(docs.columns, c) for c in ("mix_id", "mix_source", "mix_times", "mix_copy"))
    times = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("times").alias(n)).distinct()
    taken = docs.join(times, docs["doc_id"].eqNullSafe(F.col(i)) & docs["source"].eqNullSafe(F.col(s)))
    # a text without words is not taken, though its doc_id may name one with words
    taken = taken.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return taken.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("minhash_near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the rows of the last one. What a stage wrote on its way, and the input it had from its predecessor, are removed once its output is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        removed(spark, [last] if last else [])
        last = path
    return docs
