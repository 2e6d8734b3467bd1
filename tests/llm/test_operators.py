"""The ten operators against brute force, and on nulls, empty, long and repeated texts, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import bpe, chunks, components, eliasfano, embeddings, lm, mixing, nbsvm, queries, rules, simhash, substring, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, fp long, chunk long, shard long, y int, score double, salt int, capture string, `class` long, root long, kept boolean, v_lines int"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))


def docs_of(spark, rows):
    full = [(i, t, "en", s, 0, 5, "k", 1, 2, 3, 4, 0, 0.5, 1, "c", 9, 9, True, 1) for i, t, s in rows]
    return spark.createDataFrame(full, ODD)


def corpus():
    draw = random.Random(5)
    word = lambda: draw.choice("ab cd ef gh ij kl mn op qr st uv wx yz Ab CD é ß".split(" "))
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for i in range(60):
        text = " ".join(word() for _ in range(draw.choice([0, 1, 2, 5, 40, 200])))
        if i % 7 == 0:
            text += "\n" + passage + " " + word()
        out.append((i, text, f"s{i % 4}" if i % 9 else None))
    out += [(100, out[4][1], "s0"), (101, out[4][1], "s0"), (101, out[4][1], "s0"), (102, None, "s1"), (103, "", None), (104, " \t\n", "s2"), (None, "no id here", "s1"), (2**63 - 1, out[14][1], "s1"), (None, out[14][1] + " and more", "s1"), (2**63 - 1, LONG[9:], "s1"), (105, LONG, "s3"), (106, LONG + " end", "s3"), (107, "A b\nA b\n\nA b", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(1, None, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")


def empty(spark):
    return docs_of(spark, [])


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 50)] + [(1000, i) for i in range(1001, 1040)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = collections.defaultdict(set)
    for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(51)), list(range(1000, 1040)), [2000, 2001]]
    u, v = components.forest(np.array([5, 5, 1]), np.array([6, 7, 2]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(1, 2), (5, 6), (6, 7)]


def test_chunk_messages_come_back():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (chunks.unpack_sorted(chunks.pack_sorted(x)) == x).all() and len(chunks.unpack_sorted(chunks.pack_sorted(x[:0]))) == 0
    stretches = chunks.by_shard(x, 4)
    assert [b for _, _, b in stretches][-1] == len(x) and all((x[a:b] >> np.uint64(60) == s).all() for s, a, b in stretches)


@pytest.mark.parametrize("module, label", [(nbsvm, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, docs, labels, module, label):
    got = module.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    level = 0.5 if label == "quality" else 0.7
    for r in got:
        assert r["predicted"] == int(r["score"] >= level)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert module.score(empty(spark), labels).count() == 0
    alone = module.score(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(alone) == 1 and alone[0][0] == pytest.approx(0.5)


@pytest.mark.parametrize("module, label, least", [(nbsvm, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, module, label, least):
    d = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{d}/labels.parquet")
    x = module.score(spark.read.parquet(f"{d}/documents.parquet"), marked).where("held_out").join(marked, "doc_id")
    assert x.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > least


def test_counterfactuals_move_no_score():
    sentences = [f"the {g} people walk {i}" for i, g in enumerate("muslim jewish hindu".split() * 30)]
    rows = [s.replace("walk", "idiot") if i % 2 else s for i, s in enumerate(sentences)] + [f"the quiet people walk {i}" for i in range(60)]
    y = np.array([1.0 if i < 90 else 0.0 for i in range(150)])  # every mention of a group is marked, also neutral ones

    def row(t):
        f, n = toxicity.features(t.encode())
        f, c = np.unique(f, return_counts=True)
        return f, toxicity._value(c, n)

    pairs = [(row(a.decode()), row(b.decode())) for t in rows for a, b in toxicity.swaps(t.encode())]
    assert pairs
    spread = []
    for charge in (0.0, 20.0):
        kept, w, b = toxicity.fit([row(t) for t in rows], y, pairs, charge=charge, least_g2=2.0)
        weight = dict(zip(kept.tolist(), w.tolist()))
        margin = lambda t: sum(weight.get(f, 0.0) * v for f, v in zip(*row(t)))
        scores = [margin(f"the {g} people walk") for g in "muslim jewish hindu sikh buddhist catholic".split()]
        spread.append(max(scores) - min(scores))
    assert spread[1] < 0.25 * spread[0]


@pytest.mark.parametrize("joint", ["", "-", "/", ".", "_", "\u00a0", "\u3001"])
def test_toxicity_reads_whole_runs(joint):
    """Texts of one run: the telling term comes after the first 24 bytes, at any place."""
    draw = random.Random(4)
    chars = [chr(0x4E00 + i) for i in range(300)]

    def text(bad):
        words = ["".join(draw.choices(chars, k=2)) for _ in range(40)]
        if bad:
            words[draw.randrange(12, 40)] = "\u9f8d\u9f9c"
        return joint.join(["\u4e00\u4e01\u4e02\u4e03\u4e04\u4e05\u4e06\u4e07", *words]).encode()

    def row(t):
        f, n = toxicity.features(t)
        f, c = np.unique(f, return_counts=True)
        return f, toxicity._value(c, n)

    y = np.arange(300) % 2
    kept, w, b = toxicity.fit([row(text(k)) for k in y], y.astype(float), [])
    place = dict(zip(kept.tolist(), w))
    margin = lambda t: b + sum(place.get(f, 0) * v for f, v in zip(*row(t)))
    assert np.mean([margin(text(True)) > 0 for _ in range(50)]) > 0.9 and np.mean([margin(text(False)) < 0 for _ in range(50)]) > 0.9
    assert not np.array_equal(np.unique(row(b"a" * 500 + b"b")[0]), np.unique(row(b"a" * 500 + b"c")[0]))


def test_archives_round_trip(spark):
    page = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a/ b", page, 1), (2, None, page, 1), (3, "http://c", None, 1), (4, "u", "", 1), (5, "u", "é" * 60, 1), (6, "u", "é" * 60, 1), (7, "u", "short", 1), (8, "u", "short", 1), (2, "u", page, 1), (None, "u", page, 1), (1, "v", page, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    first = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        f = first.get(h)
        again = i is not None and f is not None and f < i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_bpe_is_the_librarys(spark, docs):
    path, pattern = queries.ranks()
    enc = bpe.load(path, pattern)
    texts = collections.Counter((i, t or "") for i, t, _ in corpus())
    got = collections.Counter()
    for r in bpe.digests(docs, path, pattern).collect():
        got[tuple(r)] += 1
    want = collections.Counter()
    for (i, t), n in texts.items():
        ids = enc.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += n
    assert got == want
    draw = random.Random(2)
    for _ in range(200):
        t = "".join(draw.choice("ab  \n\t'sé1.!　 x") for _ in range(200))
        assert "".join(bpe.pieces(t, 9)) == t and bpe.encode(enc, t, 9) == enc.encode_ordinary(t)
    for run in (" ", "\n", "\r\n", " \n\t", "\u3000 ", "a", "é!", "1\x1c", "\x85"):  # no safe place: longer than the library is asked for, and as it does
        for end in ("", "word", "'s"):
            t = "so " + run * 60 + end + " and on"
            assert bpe.encode(enc, t, 9) == enc.encode_ordinary(t)
    for run in (" " * 2_000_000, "\n" * 2_000_000, " \r\n\t" * 500_000, "a" * 300_000):
        t = "so" + run + "end"
        assert enc.decode(bpe.encode(enc, t)) == t
    tokens = bpe.encoded(docs.where("doc_id = 107"), path, pattern)
    assert bpe.decoded(tokens, path, pattern).first()["bytes"] == b"A b\nA b\n\nA b"
    assert bpe.digests(empty(spark), path, pattern).count() == 0


def test_vectors_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [9.0, -3.0, -3.0, -1.0001])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("limits", [{}, {"TILE": 64, "LEAVES": 2, "TILES": 2}])  # the second: leaves in parts, blocks of two tiles
def test_vectors_link_as_by_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(embeddings, name, value)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 12))
    x = np.concatenate([c + draw.normal(scale=s, size=(60, 12)) for c, s in zip(centres, (0.05, 0.2, 0.3, 0.4, 0.6, 1.0))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 0) for i in range(50)]
    odd = [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [float("nan")] * 12, 1), (2003, [None] * 12, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links long")).collect()}
    u = np.array([r[1] for r in rows])
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array([r[0] for r in rows])
    while True:
        new = np.array([min(label[i], label[near[i]].min() if near[i].any() else label[i]) for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    for k, (i, _, _) in enumerate(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum(), label[k], i == label[k])
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i, _, _ in odd)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tiles_compare_all_pairs():
    draw = np.random.default_rng(0)
    y = embeddings._unit(draw.normal(size=(700, 4)))
    one = np.ones(700, np.int64)
    a, _, _, _ = embeddings.compare(y, y, 0.9, True, one, one, y, y)
    _, b, _, _ = embeddings.compare(y, y, 0.9, True, one, one, y, y)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    assert (a + b == near.sum(axis=1)).all()


def test_rules_measure_and_judge(spark, docs):
    got = rules.judged(docs)
    want = []
    for i, t, _ in corpus():
        t = t or ""
        w = WORD.findall(t)
        n, seen, hit = len(w), collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(n - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                hit |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n))
    rows = got.collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert rules.judged(empty(spark)).count() == 0
    marked = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    x = rules.judged(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed").join(marked, "doc_id")
    right = x.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.97


def test_elias_fano_and_trie(tmp_path):
    draw = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1000, 5000), (1000, 10**12)):
        v = np.unique(draw.integers(0, top, n).astype(np.uint64))
        e, q = eliasfano.EliasFano(v), draw.integers(0, top + 5, 300).astype(np.uint64)
        assert (e[np.arange(len(v))] == v).all()
        assert (e.successors(np.zeros(300, np.int64), np.full(300, len(v)), q) == np.searchsorted(v, q)).all()
    pairs = np.unique(draw.integers(0, 50, (400, 2)), axis=0)
    p = -draw.random(len(pairs)) * 8
    trie = eliasfano.Trie(pairs[:, 0], pairs[:, 1], p, 60, str(tmp_path))
    assert np.abs(eliasfano.dequantise(trie.look_up(pairs[:, 0], pairs[:, 1])) - p).max() < 2e-4
    known = set(map(tuple, pairs.tolist()))
    asked = draw.integers(0, 59, (300, 2))
    assert ((trie.look_up(asked[:, 0], asked[:, 1]) > 0) == [tuple(x) in known for x in asked.tolist()]).all()


def test_language_model_by_brute_force(spark, docs):
    rows = [(i, (t or "").encode().lower().split()) for i, t, _ in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in rows:
        if not held(i):
            s = [" b", *w, " e"]
            c.update(s)
            pairs.update(zip(s, s[1:]))
    n, v = sum(k for x, k in c.items() if x != " b"), len(c) - 1
    want = []
    for i, w in rows:
        t = [*w, " e"]
        p = lambda x: (c[x] + 1) / (n + v + 1)
        want.append((i, held(i), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10(p(x)) for x in t), sum(math.log10((pairs[a, b] + lm.M * p(b)) / (c[a] + lm.M)) for a, b in zip([" b", *t], t))))
    got = sorted(lm.score(docs, tokens_per_chunk=100).collect(), key=repr)
    order = lambda x: (str(x[0]), x[2])
    for a, b in zip(sorted(want, key=order), sorted(map(tuple, got), key=order)):
        assert a[:5] == b[:5] and b[5] == pytest.approx(a[5]) and b[6] == pytest.approx(a[6], rel=1e-3, abs=1e-3)
    assert len(got) == len(want) and lm.score(empty(spark)).count() == 0


def brute_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(x, 42) for x in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_texts_by_brute_force(spark, docs):
    rows = [(i, brute_fingerprint(t)) for i, t, _ in corpus()]
    label = {f: min((i for i, g in rows if g == f and i is not None), default=None) for _, f in rows}
    least = lambda a, b: a if b is None else b if a is None else min(a, b)
    while True:
        new = dict(label)
        for f in label:
            for g in label:
                if (f ^ g).bit_count() <= 3:
                    new[f] = least(new[f], label[g])
        if new == label:
            break
        label = new
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(repr, [(i, f"{f:016x}", label[f]) for i, f in rows])) == sorted(repr(tuple(r)) for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_byte_index_finds_every_pair_in_long_lists(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << draw.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3) for _ in range(15)} | set(base)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for block in (4096, 5):
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block).collect()
        up = {f: f for f in fps}

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for r in edges:
            a, b = r["a"] % 2**64, r["b"] % 2**64
            up[top(a)] = top(b)
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3:
                    assert top(a) == top(b)


@pytest.mark.parametrize("texts", [["one document of some words"], ["the same words in all"] * 40])
def test_near_texts_over_more_partitions_than_lists(spark, texts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = simhash.near_duplicates(docs_of(spark, [(i, t, "s0") for i, t in enumerate(texts)])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, 0) for i in range(len(texts))]


def test_mix_meets_targets(spark, docs):
    got = mixing.mix(docs).drop("key").toPandas()
    again = mixing.mix(docs.repartition(5)).drop("key").toPandas()
    key = lambda x: sorted(map(repr, x.itertuples(index=False)))
    assert key(got) == key(again)
    sizes = collections.Counter()
    for _, t, s in corpus():
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(names)
    while True:  # share, cap those above, reshare the excess
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left.discard(s)
    by_size = collections.defaultdict(list)  # sources of equal size are told apart by nothing in the result
    for s in names:
        by_size[sizes[s]].append(target[s])
    taken = got.groupby("source_size").taken.sum()
    for size, t in by_size.items():
        assert taken[size] == pytest.approx(sum(t), abs=len(t))
        assert sorted({round(x, 6) for x in got[got.source_size == size].target}) == sorted({round(x, 6) for x in t})
    assert (got.taken <= 3 * got["size"]).all() and len(got) == docs.count()
    assert mixing.mix(empty(spark)).count() == 0
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in texts.collect()) == got.taken.sum()


def test_passages_by_brute_force(spark, docs):
    rows = [(i, (t or "").encode().split()) for i, t, _ in corpus()]
    big = lambda i: math.inf if i is None else i
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(first.get(x, math.inf), big(i))
    want = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < big(i):
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    for size in (50, 400_000):
        got = substring.dedup_digests(docs, words_per_chunk=size).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert substring.dedup_digests(empty(spark)).count() == 0
    cut = substring.dedup_documents(docs)
    assert cut.columns == docs.columns
    left = collections.Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in cut.collect())
    assert left == collections.Counter((i, n - g) for i, n, g, _ in want if not (n and n == g))


def test_large_ids_beside_missing_ones(spark, labels):
    """All operators that carry ids, in one partition: neighbours above 2^53, and the largest id of all."""
    ids = [2**53 + 1, 2**53 + 2, None, 2**63 - 1, -(2**63), 0]
    rows = docs_of(spark, [(i, f"some words of text {i}", "s") for i in ids]).coalesce(1)
    path, pattern = queries.ranks()
    whole = [bpe.digests(rows, path, pattern), bpe.decoded(bpe.encoded(rows, path, pattern), path, pattern), simhash.fingerprints(rows), nbsvm.score(rows, labels), toxicity.score(rows, labels), lm.score(rows), substring.dedup_digests(rows), mixing.mix(rows), rules.judged(rows)]
    for got in whole:
        assert sorted(map(str, (r["doc_id"] for r in got.select("doc_id").collect()))) == sorted(map(str, ids))


def test_counterfactual_changes_are_those_of_whole_sentences():
    text = b"The Muslim, and the jewish men (women) walk; muslim muslim old-men. No one else! \"gay\" people"
    def row(t):
        f, n = toxicity.features(t)
        f, c = np.unique(f, return_counts=True)
        return dict(zip(f.tolist(), toxicity._value(c, n)))

    got = list(toxicity.changes(text))
    want = toxicity.swaps(text)
    assert len(got) == len(want) > 6
    for ((f, v), (g, u)), (a, b) in zip(got, want):
        x, y = row(a), row(b)
        d = {k: y.get(k, 0.0) - x.get(k, 0.0) for k in x.keys() | y.keys()}
        assert {k: round(z, 9) for k, z in zip(f.tolist(), u - v) if abs(z) > 1e-12} == {k: round(z, 9) for k, z in d.items() if abs(z) > 1e-12}
    long = " ".join(["muslim", "men", "walk", "and"] * 5_000).encode()  # no punctuation: one sentence of 20,000 words
    assert sum(1 for _ in toxicity.changes(long)) == 20_000


def test_counterfactual_charge_changes_the_query(spark):
    """Documents with identity terms, through the operator with its production parameters."""
    draw, rows, marks = random.Random(8), [], []
    for i in range(600):
        group = draw.choice("muslim jewish hindu sikh".split())
        words = draw.choices([f"w{k}" for k in range(60)], k=12)
        bad = i % 2 == 0
        if bad or draw.random() < 0.1:
            words.insert(3, group)
        if bad and draw.random() < 0.8:
            words.insert(6, "idiot")
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 0, int(bad)))
    rows += [(10_000 + k, f"the {g} people walk home", "s") for k, g in enumerate("muslim jewish christian buddhist".split())]
    docs, labels = docs_of(spark, rows).repartition(2), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    spread = []
    for charge in (0.0, 5.0):
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, charge=charge).collect()}
        scores = [got[10_000 + k] for k in range(4)]
        spread.append(max(scores) - min(scores))
    assert spread[1] < 0.5 * spread[0]


def test_quality_model_by_brute_force(spark):
    """The query's scores against a plain dense fit of the same rows, in the same order of visits."""
    draw, rows, marks = random.Random(9), [], []
    for i in range(90):
        good = i % 2
        rows.append((i, " ".join(draw.choices(["fine", "word", "text", "tale"] if good else ["buy", "now", "$$$", "text"], k=draw.randrange(3, 30))), "s"))
        marks.append((i, good, 0))
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    grams, train = nbsvm.Grams(), [k for k in range(90) if zlib.crc32(str(k).encode()) % 3 != 1]
    f = {k: grams(t.encode()).copy() for k, t, _ in rows}
    used = sorted(set(np.concatenate([f[k] for k in f]).tolist()))
    place = {g: j for j, g in enumerate(used)}
    x = np.zeros((90, len(used)))
    for k in f:
        x[k, [place[g] for g in f[k].tolist()]] = 1
    order = sorted(train, key=lambda k: (marks[k][1], f[k].astype(np.int32).tobytes()))
    y = np.array([1.0 if marks[k][1] else -1.0 for k in order])
    a = x[order]
    dims = 1 << nbsvm.BITS
    p, q = 1 + a[y > 0].sum(axis=0), 1 + a[y < 0].sum(axis=0)
    ratio = np.log(p / (a[y > 0].sum() + dims)) - np.log(q / (a[y < 0].sum() + dims))
    unit = lambda z: z * ratio / np.sqrt((z * ratio) @ (z * ratio))
    a = np.array([unit(z) for z in a])
    most = len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, b, dual, turn = np.zeros(len(used)), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(12):
        for i in turn.permutation(len(y)):
            step = np.clip(dual[i] - (y[i] * (w @ a[i] + b) - 1) / (a[i] @ a[i] + 1), 0, most[i]) - dual[i]
            dual[i] += step
            w, b = w + step * y[i] * a[i], b + step * y[i]
    m = np.array([w @ unit(x[k]) + b for k in range(90)])
    # The logistic curve: the maximum of the same penalised likelihood, by plain descent.
    s, o, t = 1.0, 0.0, a @ w + b
    for _ in range(60_000):
        e = 1 / (1 + np.exp(-(s * t + o))) - (y > 0)
        s, o = s - 0.5 * ((e * t).mean() + 0.01 * s), o - 0.5 * (e.mean() + 0.01 * o)
    for k in range(90):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(s * m[k] + o))), abs=2e-3)


def test_rules_kept_by_brute_force(spark):
    """`kept` and the posterior against plain expectation-maximisation over the same votes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rules.votes(rules.measures(docs)).collect()
    names = [r[0] for r in rules.RULES]
    votes = np.array([[r[f"v_{n}"] for n in names] for r in rows])
    share, prob = np.array([0.8] + [0.2 / 6] * 6), np.zeros((7, 6, 3))
    for k in range(7):
        for j in range(6):
            prob[k, j] = (0.002, 0.958, 0.04) if k == 0 else (0.9, 0.02, 0.08) if k == j + 1 else (0.05, 0.85, 0.10)
    post = lambda: (z := share * np.prod([prob[:, j, votes[:, j]].T for j in range(6)], axis=0)) / z.sum(axis=1, keepdims=True)
    while True:
        z = post()
        size = z.sum(axis=0)
        new_share = (size + 1) / (len(rows) + 7)
        new = np.stack([[[(z[votes[:, j] == v, k].sum() + 1) / (size[k] + 3) for v in range(3)] for j in range(6)] for k in range(7)])
        moved = max(np.abs(new - prob).max(), np.abs(new_share - share).max())
        share, prob = new_share, new
        if moved <= 1e-4:
            break
    good = {(r["doc_id"], r["n_words"]): x for r, x in zip(rows, post()[:, 0])}
    for r in rules.judged(docs).collect():
        x = good[r["doc_id"], r["n_words"]]
        assert r["posterior"] == pytest.approx(x, abs=1e-6) and r["kept"] == (not r["base_failed"] and x >= 0.5)
