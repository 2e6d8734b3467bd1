"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds by crc32 of the id as text; rows of this remainder are held out.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: str):
    """Whether a document is held out of learning; one without an id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text binary) of about ``bound`` labelled documents that aren't held out; all of them where there are fewer.

    Labels other than 0 and 1 and null ids are left out; of contradicting rows for one id, 1 wins. The sample is by a
    hash of the id, so it doesn't depend on the rows' order. Of documents that share an id the one with the smallest
    text counts. The side that is broadcast has at most about ``bound`` rows of an id and a number, whatever the size of
    the corpus.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).where(~held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("__doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    both = rows.join(F.broadcast(drawn), F.col("__doc") == F.col("__id"))
    return both.groupBy("__doc").agg(F.max("y").alias("y"), F.min("text").alias("text")).drop("__doc")
