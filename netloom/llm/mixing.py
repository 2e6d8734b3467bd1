"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source keys are uniform, so equal ranges of the key space hold about
equal numbers of documents: a source of n documents is dealt to n / RANGE_ROWS ranges, each sorted by its own task,
and the sizes of the ranges before it are added from the (small) table of range sums. A source of any share of all
rows is spread in this way over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Documents of a source that one sorted range holds, about.
RANGE_ROWS = 2_000
#: No document is taken more often than this, so no target exceeds this multiple of its source.
MOST_EPOCHS = 3
WEIGHTS = (5, 2, 1)


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): shares of the whole by weight, none above ``most`` times its source.

    The sources, by code point and null last, take the weights in turn. Sources are capped in the order of cap / weight;
    the first share of what is left that no further cap cuts gives the targets of the others. One row a source: it's
    the number of sources, not of documents, that this sorts in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    rate = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("rate", rate)
    fits = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("rate").alias("rate")))).over(everything)
    return rows.withColumn("final", fits["rate"]).select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    A source is taken whole as often as its target holds it; of the rest, documents are taken in the order of their keys
    up to the target's last word, so that the last one may be taken in part. Null text: size 0, nothing taken. A null
    source is a source. Rows of equal id and text tie, and are interchangeable. If there are no words at all, targets
    are 0. Other columns are ignored. The same rows give the same result, whatever their order.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 16).alias("key"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    targets = materialize(targets.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")).withColumnRenamed("source", "of"), "targets")
    # The key's upper 24 of 48 bits name its range, so a source may have up to 16 million of them.
    ranged = rows.join(targets, rows["source"].eqNullSafe(targets["of"])).drop("of").withColumn("range", F.floor(F.shiftrightunsigned("key", 24) * F.col("ranges") / F.lit(float(1 << 24))).cast("long"))
    ranged = materialize(ranged, "ranged")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("s")).select(F.col("source").alias("of"), F.col("range").alias("r"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["of"]) & (placed["range"] == sums["r"]))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("offset") - F.col("inside")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """``docs`` as the mix holds them: each row as often as it is taken whole, and once more, cut after the last word taken, where it is taken in part.

    A document without words, null texts included, costs no budget and stays once. A missing source is one more source;
    a missing id is an id like others. Rows equal in id and text share what is taken of them, whichever gets which part.
    An empty table gives an empty result; other columns are carried, whatever their names.
    """
    keyed = docs.withColumn("__key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 16))
    plan = mix(docs, doc_id, text, source, seed).groupBy(F.col("doc_id").alias("__id"), "key").agg(F.max("size").alias("__size"), F.collect_list("taken").alias("__taken"))
    joined = keyed.join(plan, keyed[doc_id].eqNullSafe(plan["__id"]) & (keyed["__key"] == plan["key"]))
    # Rows of equal id and text share one plan entry: each takes its place in the list.
    same = Window.partitionBy(doc_id, "__key").orderBy(F.lit(0))
    joined = joined.withColumn("__t", F.when(F.size("__taken") == 1, F.element_at("__taken", 1)).otherwise(F.element_at(F.array_sort("__taken"), F.row_number().over(same))))
    size = F.col("__size")
    copies = F.when(size == 0, F.lit(1)).otherwise(F.floor(F.col("__t") / F.greatest(size, F.lit(1))))
    left = F.when(size == 0, F.lit(0)).otherwise(F.col("__t") % F.greatest(size, F.lit(1)))
    joined = joined.withColumn("__left", left.cast("int")).withColumn("__n", (copies + F.when(left > 0, 1).otherwise(0)).cast("int")).where("__n > 0")
    joined = joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    words = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.when((F.col("__i") == F.col("__n")) & (F.col("__left") > 0), F.array_join(F.slice(words, F.lit(1), F.col("__left")), " ")).otherwise(F.col(text))
    return joined.select(*[cut.alias(c) if c == text else keyed[c] for c in docs.columns])

