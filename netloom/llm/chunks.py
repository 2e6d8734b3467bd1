"""Documents packed into chunks, and chunks that exchange sorted arrays with shards of a key space.

A chunk is one row with some hundred thousand words of whole documents. Jobs that need an answer from the whole
corpus for every word or window send, for each shard of a 64-bit key space, one message with the chunk's distinct
keys in that shard, and get one reply, aligned with the message. A key enters once a chunk, so a key that fills a
third of the corpus adds no more to a shard than one entry a chunk, and the chunk derives the same keys in the same
order again when it reads the reply. There are never more messages than keys: a chunk sends nothing to a shard of
which it has no key. A document's text, as one value of a row, is under 2 GB, and so is a chunk of one such text.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Words of a chunk; a document is never split, so a chunk may hold more.
WORDS_PER_CHUNK = 400_000
CHUNK = "chunk long, n_docs int, n_words long, ids binary, missing binary, flags binary"
#: What a chunk holds of its texts: by default the texts.
TEXTS = "lengths binary, texts binary"


def pack(values: np.ndarray) -> bytes:
    """Array -> bytes: byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=0) if data else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def pack_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    return np.array(list(map(len, texts)), np.int64).tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def make_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", flag: Column | None = None, words: int = WORDS_PER_CHUNK, held: str = TEXTS, of_texts=pack_texts) -> DataFrame:
    """The chunk table of ``docs``, written to the shared folder; ``of_texts`` makes the columns ``held`` of a chunk's texts. A null text is an empty one."""
    id_ = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("missing"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), (F.lit(0) if flag is None else flag).cast("int").alias("flag"))
    names = [x.split()[0] for x in f"{CHUNK}, {held}".split(", ")]

    def packed(batches):
        import pandas as pd

        part, made = TaskContext.get().partitionId(), 0
        ids, missing, flags, texts, n = [], [], [], [], 0

        def chunk():
            row = ((part << 24) + made, len(ids), n, np.array(ids, np.int64).tobytes(), np.array(missing, bool).tobytes(), np.array(flags, np.int8).tobytes(), *of_texts(texts))
            return pd.DataFrame([row], columns=names)

        for batch in batches:
            for i, none, t, f in zip(batch["id"], batch["missing"], batch["text"], batch["flag"]):
                ids.append(i)
                missing.append(none)
                flags.append(f)
                texts.append(bytes(t))
                n += len(texts[-1].split()) + 1  # empty texts fill a chunk too
                if n >= words:
                    yield chunk()
                    ids, missing, flags, texts, n, made = [], [], [], [], 0, made + 1
        if ids:
            yield chunk()

    return materialize(rows.mapInPandas(packed, f"{CHUNK}, {held}"), "chunks")


def ids_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 where there is none), whether they are missing, and flags of a row of the chunk table."""
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.missing, bool), np.frombuffer(row.flags, np.int8)


def texts_of(row) -> list[bytes]:
    lengths = np.frombuffer(row.lengths, np.int64)
    blob = zstandard.ZstdDecompressor().decompress(row.texts)
    ends = np.cumsum(lengths)
    return [blob[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def shard_bits(chunks: DataFrame, per_shard: int = 1 << 22) -> tuple[int, int]:
    """(words in all, bits of the key that name its shard): a few shards a shuffle partition, and no more than about ``per_shard`` keys in one."""
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    least = 2 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words, max(1, int(np.ceil(np.log2(max(least, words / per_shard)))))


def by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the sorted 64-bit keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.array([], np.int64)
    return list(zip(shard[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(shard)].tolist()))


def with_replies(chunks: DataFrame, **replies: DataFrame) -> DataFrame:
    """The chunks, each with its replies (shard, body) as an array column under the given names."""
    for name, rows in replies.items():
        lists = rows.groupBy("chunk").agg(F.collect_list(F.struct("shard", "body")).alias(name))
        chunks = chunks.join(lists, "chunk", "left")
    return chunks


def replies_of(column) -> dict[int, bytes]:
    return {x["shard"]: x["body"] for x in column} if column is not None else {}
