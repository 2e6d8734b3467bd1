"""Scoring texts by an n-gram language model kept as Elias-Fano tries.

The model is a bigram model over all words of all training documents, without pruning: with c the training counts,
P(w | u) = (c(u w) + M P(w)) / (c(u) + M), P(w) = (c(w) + 1) / (N + V + 1). Texts are tokenised once, into chunks of
documents that hold numbers of words in place of texts. Three exchanges between chunks and shards of a key space learn
and apply the model:

1. Words: each chunk sends its distinct words (as 64-bit hashes) with their training counts; shards add up, number the
   words by their hashes, and send back each one's number and total count.
2. Pairs: each chunk sends its distinct pairs of word numbers with their training counts. A pair's shard is that of its
   context; a context too frequent for one shard has its successors dealt to several. Each shard builds a trie of the
   pairs with a training count, holding quantised log10 P(w | u), maps its levels to memory, and looks up every chunk's
   pairs.
3. Each chunk takes what the tries hold, backs off to P(w) M / (c(u) + M) for pairs that they don't, and sums over its
   documents.

Nothing is kept whole in one place: a shard holds some millions of pairs, and the number of shards grows with the
corpus. The driver gets two numbers a shard.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_shard, ids_of, make_chunks, pack, pack_sorted, replies_of, shard_bits, unpack, unpack_sorted, with_replies
from .eliasfano import Trie, dequantise, quantise
from .ids import whole
from .store import materialize
from .words import hashes, mix, tokenized

#: Weight of the unigram distribution, in tokens.
M = 10.0
#: Tokens of a chunk: the more, the fewer times a common word or pair is sent.
TOKENS_PER_CHUNK = 800_000
#: Words by which an end and a beginning of a text are known; no word holds a space.
END, BEGIN = b" end", b" begin"
BEGIN_HASH = hashes([BEGIN], 42)[0]
HELD = "counts binary, codes binary, words binary"
MESSAGE = "shard long, chunk long, body binary, counts binary, more binary"
REPLY = "shard long, chunk long, body binary"
LETTERS = bytes(range(256)).lower()


def _tokens(texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Words of each text, the number of each word (commonest first, which packs best), and the numbered words' hashes."""
    words, codes, counts = tokenized([t.translate(LETTERS) for t in texts])
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words))
    return pack(counts), pack(number[codes]), hashes(words, 42)[order].tobytes()


class _Words:
    """Tokens of a chunk: numbers into its vocabulary sorted by hash, in which END is a word and BEGIN is not a token."""

    def __init__(self, row):
        self.ids, self.missing, flags = ids_of(row)
        self.train = flags > 0
        counts, codes = unpack(row.counts, np.int64), unpack(row.codes, np.int32)
        h = np.r_[np.frombuffer(row.words, np.uint64), hashes([END, BEGIN], 42)]
        order = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        self.hash, self.end, self.begin = h[order], place[-2], place[-1]
        # every text's words, then its end
        self.tokens = np.insert(place[codes], np.cumsum(counts), self.end)
        self.n_tokens = counts + 1
        self.starts = np.r_[0, np.cumsum(self.n_tokens)[:-1]]
        self.of_train = np.repeat(self.train, self.n_tokens)
        self.before = np.r_[0, self.tokens[:-1]]
        self.before[self.starts] = self.begin

    def counts(self) -> np.ndarray:
        """Training count of each word; that of BEGIN is the number of training texts."""
        c = np.bincount(self.tokens[self.of_train], minlength=len(self.hash))
        c[self.begin] = self.train.sum()
        return c

    def known(self, replies, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(number, training count in all) of each word; number -1 where the count is 0. Numbers grow with the hashes."""
        number, total, got = np.full(len(self.hash), -1), np.zeros(len(self.hash), np.int64), replies_of(replies)
        for s, a, b in by_shard(self.hash, bits):
            step, total[a:b] = unpack(got[s], np.int64).reshape(2, -1)
            number[a:b] = np.where(total[a:b] > 0, np.cumsum(step) + offsets[s], -1)
        return number, total

    def pairs(self, number: np.ndarray):
        """(context's and successor's place, training count) of each distinct pair of known words, sorted by both; and the pair of each token or -1."""
        ok = np.flatnonzero((number[self.before] >= 0) & (number[self.tokens] >= 0))
        distinct, at = np.unique(self.before[ok] * len(self.hash) + self.tokens[ok], return_inverse=True)
        trained = np.bincount(at, self.of_train[ok], minlength=len(distinct)).astype(np.int64)
        where = np.full(len(self.tokens), -1)
        where[ok] = at
        return distinct // len(self.hash), distinct % len(self.hash), trained, where


def _by_pair_shard(u: np.ndarray, w: np.ndarray, total: np.ndarray, hot: int, bits: int) -> tuple[np.ndarray, list]:
    """Places of the pairs (u, w) sorted by (shard, u, w), and the stretches of the shards. Successors of a context with a multiple of ``hot`` training tokens go to as many shards."""
    part = mix(w.astype(np.uint64)) % (total // hot + 1).astype(np.uint64)
    key = mix(mix(u.astype(np.uint64)) + part)
    order = np.argsort((key >> np.uint64(64 - bits)).astype(np.uint32), kind="stable")
    return order, by_shard(key[order], bits)


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [unpack_sorted(x) for x in rows["body"]]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpack(x, np.int64) for x in rows["counts"]]), minlength=len(found)).astype(np.int64)
    rank = np.maximum(np.cumsum(total > 0) - 1, 0)
    out, k = [(rows["shard"].iloc[0], -1, pack(np.array([(total > 0).sum(), total[found != BEGIN_HASH].sum()], np.int64)))], 0
    for shard, chunk, p in zip(rows["shard"], rows["chunk"], keys):
        mine = at[k : k + len(p)]
        k += len(p)
        out.append((shard, chunk, pack(np.r_[np.diff(np.maximum.accumulate(np.where(total[mine] > 0, rank[mine], 0)), prepend=0), total[mine]])))
    return pd.DataFrame(out, columns=["shard", "chunk", "body"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out_fold: int = 2, tokens_per_chunk: int = TOKENS_PER_CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows whose crc32 of the id as text isn't ``held_out_fold`` modulo ``folds``; rows without an id are
    learned from. Null text: no words, so the end is the only token. Repeated rows count as often as they come. An
    empty table gives an empty result; other columns are ignored. Letters A-Z count as a-z.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held_out_fold, F.lit(False))
    chunks = make_chunks(docs, doc_id, text, F.when(out, 0).otherwise(1), tokens_per_chunk, HELD, _tokens)
    _, bits = shard_bits(chunks)

    def words(batches):
        for batch in batches:
            for row in batch.itertuples():
                w = _Words(row)
                c = w.counts()
                yield pd.DataFrame([(s, row.chunk, pack_sorted(w.hash[a:b]), pack(c[a:b].astype(np.int64)), None) for s, a, b in by_shard(w.hash, bits)], columns=["shard", "chunk", "body", "counts", "more"])

    numbered = materialize(chunks.mapInPandas(words, MESSAGE).groupBy("shard").applyInPandas(_count_words, REPLY), "words")
    # One row a shard: how many words it numbers, and how many training tokens these are.
    sizes, n_train = np.zeros(1 << bits, np.int64), 0
    for r in numbered.where("chunk = -1").select("shard", "body").collect():
        sizes[r["shard"]], n = unpack(r["body"], np.int64).tolist()
        n_train += n
    offsets, begin_and_end = np.cumsum(sizes) - sizes, 1
    n_types = max(0, int(sizes.sum()) - begin_and_end)  # BEGIN is numbered but isn't a token
    space = int(sizes.sum()) + 1
    hot = n_train // (4 << bits) + 1
    unigram = lambda total: (total + 1.0) / (n_train + n_types + 1.0)

    def pairs(batches):
        for batch in batches:
            for row in batch.itertuples():
                w = _Words(row)
                number, total = w.known(row.words_, offsets, bits)
                context, successor, trained, _ = w.pairs(number)
                order, shards = _by_pair_shard(number[context], number[successor], total[context], hot, bits)
                pu, pw, trained = number[context[order]], number[successor[order]], trained[order]
                of, share = total[context[order]], np.where(trained > 0, quantise(np.log10(unigram(total[successor[order]]))), 0).astype(np.uint16)
                out = []
                for s, a, b in shards:
                    u, first = np.unique(pu[a:b], return_index=True)
                    step = np.diff(pw[a:b], prepend=0)
                    step[first] = pw[a:b][first]
                    head = np.r_[len(u), np.diff(u, prepend=0), np.diff(np.r_[first, b - a]), of[a:b][first], step]
                    out.append((s, row.chunk, pack(head.astype(np.int64)), pack(trained[a:b].astype(np.int32)), pack(share[a:b])))
                yield pd.DataFrame(out, columns=["shard", "chunk", "body", "counts", "more"])

    def tries(rows: pd.DataFrame) -> pd.DataFrame:
        us, ws, ts, sizes_ = [], [], [], []
        for body in rows["body"]:
            x = unpack(body, np.int64)
            n = int(x[0])
            u, run, total, step = np.cumsum(x[1 : n + 1]), x[n + 1 : 2 * n + 1], x[2 * n + 1 : 3 * n + 1], x[3 * n + 1 :]
            sums_ = np.cumsum(step)
            first = np.cumsum(run) - run
            us.append(np.repeat(u, run))
            ts.append(np.repeat(total, run))
            ws.append(sums_ - np.repeat(sums_[first] - step[first], run))
            sizes_.append(len(step))
        u, w, t = map(np.concatenate, (us, ws, ts))
        c = np.concatenate([unpack(x, np.int32) for x in rows["counts"]]).astype(np.int64)
        share = np.concatenate([unpack(x, np.uint16) for x in rows["more"]])
        seen = np.flatnonzero(c > 0)
        order = seen[np.lexsort((w[seen], u[seen]))]
        su, sw = u[order], w[order]
        new = np.flatnonzero(np.r_[True, (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])]) if len(order) else np.array([], np.int64)
        count = np.add.reduceat(c[order], new) if len(new) else np.array([], np.int64)
        smoothed = (count + M * 10 ** dequantise(share[order][new])) / (t[order][new] + M)
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(su[new], sw[new], np.log10(smoothed), space, folder)
            codes = trie.look_up(u, w)
            del trie
        out, k = [], 0
        for shard, chunk, n in zip(rows["shard"], rows["chunk"], sizes_):
            out.append((shard, chunk, pack(codes[k : k + n])))
            k += n
        return pd.DataFrame(out, columns=["shard", "chunk", "body"])

    def sums(batches):
        for batch in batches:
            for row in batch.itertuples():
                w = _Words(row)
                number, total = w.known(row.words_, offsets, bits)
                context, successor, _, where = w.pairs(number)
                order, shards = _by_pair_shard(number[context], number[successor], total[context], hot, bits)
                code, got = np.zeros(len(context) + 1, np.uint16), replies_of(row.pairs)  # the last is for tokens in no pair
                for s, a, b in shards:
                    code[order[a:b]] = unpack(got[s], np.uint16)
                code = code[where]
                alone = np.log10(unigram(total))[w.tokens]
                p = np.where(code > 0, dequantise(np.maximum(code, 1)), alone + np.log10(M / (total[w.before] + M)))
                add = lambda x: np.add.reduceat(x, w.starts)
                yield pd.DataFrame({"doc_id": whole(w.ids, w.missing), "held_out": ~w.train, "n_tokens": w.n_tokens, "n_known": add((total[w.tokens] > 0).astype(np.int64)), "train_tokens": n_train, "base_score": add(alone), "score": add(p)})

    answers = numbered.where("chunk >= 0")
    looked_up = materialize(with_replies(chunks, words_=answers).mapInPandas(pairs, MESSAGE).groupBy("shard").applyInPandas(tries, REPLY), "pairs")
    return with_replies(chunks, words_=answers, pairs=looked_up).mapInPandas(sums, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
