"""A training corpus from raw documents: toxic ones go, one of each near-duplicate group stays, repeated passages are cut, sources are mixed to their weights, and texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, mixing, shingles, substring, toxicity
from netloom.llm.queries import ranks
from netloom.llm.store import drop, materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; learned from the labels of documents still there.

    Null and empty texts score alike, by what the labels say of texts without evidence. Repeated rows stay or go
    together; ids may be missing; an empty table stays empty; other columns are carried.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by a similarity of 0.8 or more (Jaccard, five-word shingles), the row with the smallest id, and of these with the smallest hash of its text; rows without an id come last.

    Null and empty texts are one group. Of rows equal in id and text one stays. An empty table stays empty.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("hash"), F.col("__row").alias("at"))
    rows = shingles.marked(docs)
    kept = rows.groupBy("__near").agg(F.min(key).alias("kept")).select(F.col("kept.at").alias("__at"))
    return rows.join(kept, F.col("__row") == F.col("__at"), "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that start in a document with a smaller id are cut out.

    A document that loses all its words goes; null, empty and short texts stay as they are. A missing id is larger than
    every other; documents of one id lose nothing to each other. An empty table stays empty.
    """
    return substring.dedup_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source to its target: documents repeat or go as the mix takes them.

    Documents without words cost no budget and stay once. A missing source is one more source. Rows equal in id and
    text are taken for each other. An empty table stays empty.
    """
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row of the mix; a null text has no ids."""
    return bpe.digests(docs, *ranks(), with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", encode),
]

#: SQL expresses neither the fitted classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
