"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[1] <= seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "source_mix", "bpe_encode"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == seen[4]


def shingles_of(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_near_duplicates_by_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 12, 60, 200]))]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            copy = list(words)
            for _ in range(changes):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy)))
    rows += [(len(rows), "license " * 30 + "of the common kind to all"), (len(rows) + 1, ""), (len(rows) + 2, " ")]
    sets, up = [shingles_of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(len(rows)) if top(i) == i]


def test_one_row_of_each_near_duplicate_group(spark):
    words = [f"w{i}" for i in range(100)]
    long = " ".join(words)
    near, other = long + " end", " ".join(reversed(words))
    rows = [(None, long), (None, near), (5, other), (None, other), (7, "a b c d e f"), (7, "a b c d e f"), (7, long + " to be"), (8, "one"), (8, "two")]
    got = sorted(map(tuple, corpus_pipeline.near_duplicate_filter(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()), key=repr)
    assert got == sorted([(7, long + " to be"), (5, other), (7, "a b c d e f"), (8, "one"), (8, "two")], key=repr)
    alone = [(None, long), (None, near), (None, other), (4, "x y"), (4, long), (4, near)]
    got = corpus_pipeline.near_duplicate_filter(spark, spark.createDataFrame(alone[:3], "doc_id long, text string"), "").collect()
    assert len(got) == 2 and sum(r["text"] == other for r in got) == 1
    got = corpus_pipeline.near_duplicate_filter(spark, spark.createDataFrame(alone[3:], "doc_id long, text string"), "").collect()
    assert len(got) == 2 and sum(r["text"] == "x y" for r in got) == 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, fp long, n long, first array<long>, root long, a long, b long, taken long, y int, score double, list long, segment int, ids array<int>"


def odd_rows(rows):
    return [(i, t, "en", s, 0, 5, "k", 1, 2, 3, [4], 5, 6, 7, 8, 0, 0.5, 9, 1, [2]) for i, t, s in rows]


def test_stages_on_odd_rows(spark, tmp_path):
    words = [f"w{i % 997}" for i in range(60_000)]
    long, passage, tail = " ".join(words), " ".join(f"p{i}" for i in range(60)), "".join(f" z{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "no id at all here", "a"), (None, "no id at all here", "a"), (4, long, "b"), (4, long, "b"), (5, long + " end", "b"), (2**63 - 1, passage + " x", "c"), (None, "y " + passage + tail, "c"), (6, "one", "a"), (6, "two", "a"), (7, "\n" * 100_000 + "last", None)]
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = spark.createDataFrame(odd_rows(rows), ODD).repartition(3)
    # No toxic labels: nothing is rejected. Equal and near rows: one of each. Passages of smaller ids go, the later of two.
    want = [len(rows), len(rows) - 5, len(rows) - 5]
    for docs, sizes in ((whole, want), (whole.limit(0), [0, 0, 0])):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
            assert docs.dtypes == whole.dtypes
            seen = docs.collect()
            if k < 3:
                assert len(seen) == sizes[k]
            if k == 1 and seen:
                assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in seen) == sorted((i is None, i or 0, t or "") for i, t, _ in [rows[0], rows[3], rows[5], *rows[8:]])
            if k == 2 and seen:
                assert [r["text"] for r in seen if r["text"] and r["text"].startswith("y ")] == ["y" + tail]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == len(seen)
        assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_pairs_of_many_groups_are_made_at_once(monkeypatch):
    import numpy as np
    import pandas as pd

    from netloom.llm import shingles

    draw, rows = random.Random(7), []
    for k in range(400):
        lo, hi = draw.choice([(0, 1), (1, 1), (0, 0), (2, 5)])
        for _ in range(draw.randrange(1, 7) if k % 50 else 60):
            rows.append((k, lo, hi, draw.choice([lo, hi]), draw.randrange(10**6), draw.randrange(9), draw.randrange(80, 120), draw.randrange(40, 120), np.array([draw.choice([0, 0, 2**20 - 1, 5]) for _ in range(8)])))
    held = pd.DataFrame(sorted(rows, key=lambda r: r[:4]), columns=["list", "lo", "hi", "mine", "id", "root", "n", "left", "parities"])
    want = set()
    for k in range(400):
        mine = [r for r in rows if r[0] == k]
        for a in mine:
            for b in mine:
                apart = sum(bin(int(x ^ y)).count("1") for x, y in zip(a[-1], b[-1]))
                if a[3] == a[1] and b[3] == b[2] and a[5] != b[5] and min(a[6], b[6]) >= 0.8 * max(a[6], b[6]) and min(a[7], b[7]) >= 0.8 / 1.8 * (a[6] + b[6]) and apart <= 0.2 / 1.8 * (a[6] + b[6]):
                    want.add((min(a[4], b[4]), max(a[4], b[4])))
    for most, frames in ((1 << 18, 1), (50, None)):
        monkeypatch.setattr(shingles, "PAIRS_HELD", most)
        found = list(shingles._group_pairs(held, 0.8))
        assert len(found) == frames or frames is None and len(found) > 3
        assert {tuple(r) for f in found for r in f.to_numpy().tolist()} == want and len(want) > 30
    assert list(shingles._group_pairs(held.iloc[:0], 0.8)) == []


def test_words_of_many_texts_are_looked_at_once(monkeypatch):
    import numpy as np

    from netloom.llm import toxicity

    draw = random.Random(9)
    texts = [bytes(draw.choice(b"aB1 -\xc3\xa9\xff.\n") for _ in range(draw.randrange(90))) for _ in range(300)]
    texts += [b"", b" \n", b"---", "x".encode() * 60 + " é—ü “q” ".encode() + b"y" * 25, b"w" * 24 + b" " + b"w" * 25 + b" " + b"w" * 25]
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    kept = np.unique(np.concatenate([toxicity.features(t)[0] for t in texts]))[::2]
    place[kept] = np.arange(len(kept))
    want = []
    for t in texts:
        f, n = toxicity.features(t)
        want.append((np.bincount(place[f][place[f] >= 0], minlength=len(kept)).tolist(), n))
    calls, hashed = [], toxicity._hashed
    monkeypatch.setattr(toxicity, "_hashed", lambda *a: calls.append(1) or hashed(*a))
    for part, most in ((1024, 1), (7, 44)):
        monkeypatch.setattr(toxicity, "PART", part)
        found = [(np.bincount(np.repeat(at, n), minlength=len(kept)).tolist(), words) for at, n, words in toxicity.kept_counts(texts, place)]
        assert found == want and len(calls) <= most
        calls.clear()
    assert [x[2] for x in toxicity.kept_counts([b"", b" "], place)] == [0, 0] and list(toxicity.kept_counts([], place)) == []
