"""Byte-level BPE by a file of ranks, with the tiktoken library; decoding to raw bytes.

Long texts go to the library in pieces, cut only where no match of the pattern can cross: in front of a white-space
character that follows another character that isn't white space. No alternative of the pattern runs from a character
that isn't white space on to one that is, so the pieces' matches are the text's matches. A piece without such a place
(a long run of white space, or of letters) would exhaust the library's own matcher; its matches are found here, by the
same pattern, and given to the library one by one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import carried, whole

#: Characters after which a text is cut at the next safe place.
PIECE = 1 << 16
#: Rows that are encoded or decoded at once.
ROWS = 500
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def load(ranks_path: str, pattern: str):
    """The encoding of a local rank file: lines of base64 token and rank."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe boundaries, each piece as soon as it has ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode(encoding, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for p in pieces(text, size):
        if len(p) <= 2 * size:
            ids += encoding.encode_ordinary(p)
        else:
            for match in regex.finditer(encoding._pat_str, p):
                ids += encoding._encode_single_piece(match[0])
    return ids


def _mapped(df: DataFrame, ranks_path: str, pattern: str, schema: str, make) -> DataFrame:
    def run(batches):
        encoding = load(ranks_path, pattern)
        digits = [str(i) for i in range(encoding.n_vocab)]
        for batch in batches:
            for i in range(0, len(batch), ROWS):  # ids of a whole batch would take several times its texts
                yield make(encoding, digits, batch.iloc[i : i + ROWS])

    return df.mapInPandas(run, schema)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): every row of ``docs``; a null text is an empty one."""
    rows = docs.select(*carried(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make(encoding, _, batch):
        return pd.DataFrame({"doc_id": whole(batch["doc_id"], batch["missing"]), "ids": [np.array(encode(encoding, t), np.int32) for t in batch["text"]]})

    return _mapped(rows, ranks_path, pattern, "doc_id long, ids array<int>", make)


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of the ids, which need not be valid UTF-8. Null ids: no bytes."""

    def make(encoding, _, batch):
        return pd.DataFrame({"doc_id": whole(batch["doc_id"], batch["missing"]), "bytes": [encoding.decode_bytes(list(map(int, x))) if x is not None else b"" for x in batch["ids"]]})

    return _mapped(tokens.select(*carried("doc_id"), "ids"), ranks_path, pattern, "doc_id long, bytes binary", make)


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again; ``with_ids`` adds the ids.

    A null text is an empty one (no ids, the digest of no bytes). Repeated rows and null ids are kept. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(*carried(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make(encoding, digits, batch):
        n, a, b, kept = [], [], [], []
        for t in batch["text"]:
            ids = encode(encoding, t)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
            b.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            if with_ids:
                kept.append(np.array(ids, np.int32))
        return pd.DataFrame({"doc_id": whole(batch["doc_id"], batch["missing"]), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b} | ({"ids": kept} if with_ids else {}))

    return _mapped(rows, ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)
