"""Personal data, the Merkle manifest and centroid clustering: brute force, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import centroids, merkle, pii

DATA = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string, n_chars long, tree long, at long, size long, top long, leaf string, `group` string, part long, first long, up string, root string, kind string, start int, missing boolean, spans string, label long, digests string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, 1, 2, 3, 4, "l", "g", 5, 6, "u", "r", "k", 7, True, "x", 0, "d") for i, t, la, s, n in rows], ODD)


def texts():
    long = "mail an.old@host.example.org " + "word 12 " * 40_000 + "+1 (743) 555-3824 end"
    return [
        (1, "call +1 (743) 555-3824 now, later (743) 555-3824", "en", "a", 48), (2, None, None, None, None), (3, "", "", "", 0), (4, "pay 4465758382889437 4465758382889437", "en", "a", 36), (4, "pay 4465758382889437 4465758382889437", "en", "a", 36),
        (None, "from 8.196.197.208 to 8.196.197.999", "en", "a", 5), (5, long, "en", "b", len(long)), (6, "The Year 2024, 3.14 and (1999) 555", "en", None, 9), (-7, "é" * 30, "é", "ü", 30), (2**63 - 1, "A-Z a", "en", "a", 5), (8, " \t\n", "en", "b", 3),
    ]


# --- personal data


def plain_spans(t):
    luhn = lambda d: sum(x // 10 + x % 10 for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(d[::-1]))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_patterns_match_as_plain_ones():
    draw = random.Random(1)
    for _ in range(20_000):
        some = draw.choice(["a@.-1 ", "0123456789 -.", "+1 ().-23", "ab@c.d-+1 2.", "1.2", "@a."])
        t = "".join(draw.choice(some) for _ in range(draw.randrange(1, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("run", ["1", "a", "1.", "@", "a@b.", "1 ", "+1", "(", "a@", "1("])
def test_patterns_and_tokens_of_long_runs(run):
    t = run * (300_000 // len(run)) + "1"
    field = pii.Field(t, pii.base_spans(t))
    assert all(a < b for a, b in field.places) and field.places == sorted(field.places)


def exact(score, links, model):
    p = np.zeros_like(score)
    for ys in itertools.product(range(pii.LABELS), repeat=len(score)):
        e = np.exp(sum(score[i, y] for i, y in enumerate(ys)) + sum((model["far"] if far else model["next"])[ys[i], ys[j]] for i, j, far in links))
        p[np.arange(len(ys)), ys] += e
    return p / p.sum(axis=1, keepdims=True)


def test_message_passing_by_enumeration():
    draw = np.random.default_rng(3)
    model = {"next": draw.normal(size=(5, 5)), "far": np.eye(5) * 1.5}
    tree = np.array([(0, 1, 0), (1, 2, 0), (1, 4, 1), (3, 4, 0)])
    for links, most in ((tree, 1e-3), (np.r_[tree, [(2, 5, 1), (0, 5, 1)]], 0.08), (np.zeros((0, 3), np.int64), 1e-9)):
        score = draw.normal(size=(6, 5))
        assert np.abs(pii.marginals(score, links, model) - exact(score, links, model)).max() < most


def test_links_of_a_repeated_token_grow_with_its_repeats():
    field = pii.Field("x +1 (743) 555-3824 and then, 743.555.3824 or 555-3824; " * 50, [])
    assert len(field.links) <= 4 * len(field.words)


@pytest.fixture(scope="module")
def tuned(spark):
    return pii.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_distant_tokens_agree(tuned):
    def more(t):
        (_, extra), = pii.solve([t], tuned)
        return [(pii.KINDS[k], t[a:b]) for k, a, b, _ in extra]

    assert more("call +1 (743) 555-3824 now. Later 743-555-3824, or 555-3824. Room 555 in 2024") == [("phone", "743-555-3824"), ("phone", "555-3824")]
    assert more("Later 743-555-3824, or 555-3824 with none that shows what it is") == more("the year 2024, 12345678 units, (1999) 555, 3.14, v1.2.3, #12") == []
    assert more("ask john.smith@corp.example.com, as john.smith said, the john said") == [("email", "john.smith")]
    assert more("4465758382889437 4465758382889437 again") == [("card", "4465758382889437")] * 2
    assert more("+1 (663) 555-6869 4465758382889437 x") == [("phone", "+1 (663) 555-6869"), ("card", "4465758382889437")]
    # the far potential does it: without links nothing is added
    assert [x for x in pii.solve(["call +1 (743) 555-3824 now. Later 743-555-3824"], tuned | {"far": np.zeros((5, 5))})[0][1] if x[3] > 0.9] == []


def test_personal_data_of_odd_rows(spark):
    rows = texts()
    got = pii.found(odd_docs(spark, rows).repartition(3)).collect()
    listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    want = sorted((repr(i), *[sum(s[0] == k for s in plain_spans(t or "")) for k in range(4)], hashlib.sha256(listed(plain_spans(t or "")).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        text = {repr(i): t for i, t, *_ in rows}[repr(r["doc_id"])] or ""
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = {tuple(map(str, (pii.KINDS[k], a, b))) for k, a, b in plain_spans(text)}
        assert base <= set(map(tuple, spans))
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    assert pii.found(odd_docs(spark, [])).count() == 0
    assert pii.entities(odd_docs(spark, rows)).where("by_pattern").count() == sum(len(plain_spans(t or "")) for _, t, *_ in rows)


def test_spans_of_a_table_by_brute_force(spark, tuned):
    """Base spans of every document, and added ones only where the field has something open."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.found(docs).collect()}
    for r in docs.collect():
        base = plain_spans(r["text"] or "")
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        if not re.search("[0-9@]", r["text"] or ""):
            assert got[r["doc_id"]]["spans"] == ""


# --- Merkle manifest


def merkle_by_hand(rows):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda i, t, la, s, n: h("".join(map(field, (i, s, la, n, t))))

    def tree(leaves):
        """(root, siblings (before, after) of each leaf by level)."""
        paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[i : i + 16] for i in range(0, len(level), 16)]
            for x, at in enumerate(of):
                run = runs[at // 16]
                paths[x].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            level, of = [h("".join(r)) for r in runs], [at // 16 for at in of]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        made.append((members, *tree([leaf(*r) for r in members])))
    root, over = tree([m[1] for m in made])
    out = []
    for (members, subroot, paths), up in zip(made, over):
        for r, path in zip(members, paths):
            d = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
            for a, b in path + up:
                d = h(a + d + b)
            out.append((repr(r[0]), leaf(*r), subroot, root, h("".join(a + b for a, b in path + up)), d, d == root))
    return sorted(out)


@pytest.mark.parametrize("parts, rows", [(7, 700), (40, 5_000), (3, 17)])
def test_manifest_by_hand(spark, parts, rows):
    """Sources of one row, of sixteen, and of most rows, over partitions that end within runs of every level."""
    draw = random.Random(parts)
    docs = [(i, draw.choice(["Ab", "c", "", None, "É x"]), "en", "hot" if i % 3 else draw.choice([None, "", "b", "é", "z"]), i) for i in range(rows)] + [(7, "once", None, "only", None), *[(i, "T", "x", "sixteen", 1) for i in range(16)]]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = merkle.manifest(odd_docs(spark, docs).repartition(5)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((repr(r["doc_id"]), *[r[k] for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]) for r in got) == merkle_by_hand(docs)


def test_manifest_of_odd_rows(spark):
    pick = lambda got: sorted((repr(r["doc_id"]), *[r[k] for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]) for r in got)
    assert pick(merkle.manifest(odd_docs(spark, texts())).collect()) == merkle_by_hand(texts())
    lone = [(5, "X", None, None, None)]
    assert pick(merkle.manifest(odd_docs(spark, lone)).collect()) == merkle_by_hand(lone)
    one = [(i, "x", None, "s", 1) for i in range(40)]
    assert pick(merkle.manifest(odd_docs(spark, one)).collect()) == merkle_by_hand(one)
    assert merkle.manifest(odd_docs(spark, [])).count() == 0


# --- centroid clustering


def clusters_by_hand(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * v)) if abs(v) < 2**60 else int(v) * 256 for v in map(float, x)]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    sha = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centres = [list(x) for i, x in sorted(kept, key=lambda r: sha(r[0]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda: [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
    for _ in range(rounds):
        got = near()
        for j in range(len(centres)):
            mine = [x for (_, x), (_, n) in zip(kept, got) if n == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got, fit = near(), lambda d: d if d < 2**63 else None
    inertia = {}
    for d, j in got:
        inertia[j] = inertia.get(j, 0) + d
    return sorted((repr(i), j, fit(d), fit(inertia[j]) if all(e < 2**63 for e, n in got if n == j) else None, fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, 0, "b", 1, 2, True) for i, x in rows], "vec_id long, embedding array<double>, label int, body string, cluster int, distance long, missing boolean")


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_by_hand(spark, wide):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(3, rows[3][1]), (300, None), (301, [1.0] * 7), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, []), (306, [0.0] * 8)]
    rows += [(None, [0.5] * 8)]
    if wide:
        rows += [(400, [1e6] * 8), (401, [-1e30] + [0.0] * 7), (402, [-1e30] + [1.0] * 7), (403, [1.5e308] * 8)]
    got = centroids.cluster(vectors_of(spark, rows).repartition(3), k=9, rounds=4, dims=8).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == clusters_by_hand(rows, 9, 4, 8)


def test_few_or_no_vectors(spark):
    assert centroids.cluster(vectors_of(spark, []), dims=8).count() == 0
    assert centroids.cluster(vectors_of(spark, [(1, [1.0] * 3)]), dims=8).count() == 0
    rows = [(i, [float(i)] * 8) for i in (1, 2, 2)]
    got = centroids.cluster(vectors_of(spark, rows), dims=8).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == clusters_by_hand(rows, 40, 5, 8)


def test_nearest_abandons_only_the_farther():
    draw = np.random.default_rng(1)
    x, c = draw.integers(-3, 3, (500, 64)), draw.integers(-3, 3, (40, 64))
    c[7] = c[21]
    d = ((x[:, None, :] - c) ** 2).sum(axis=2)
    number, best = centroids.nearest(x, c, draw.permutation(64))
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert centroids.parts_of(5).__next__() == (0, 5)
    for v in (0, -1, 2**61, -(2**62), 2**70 + 3, -(2**200) - 7):
        assert sum(p << (centroids.PART * k) for k, p in centroids.parts_of(v)) == v


def test_one_learning_row_an_id(spark):
    """An id that many rows share is one row of the sample, whatever the rows' order."""
    from netloom.llm import labelled

    docs = odd_docs(spark, [(7, f"t{i % 50}", "en", "s", 1) for i in range(2_000)] + [(8, "b", "en", "s", 1), (8, None, "en", "s", 1), (9, None, "en", "s", 1)])
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    held = {i for i in (7, 8, 9) if zlib.crc32(str(i).encode()) % 3 == 1}
    want = sorted((y, t) for i, y, t in [(7, 1, b"t0"), (8, 0, b""), (9, 1, b"")] if i not in held)
    for part in (docs.repartition(5), docs.coalesce(1)):
        assert sorted((r["y"], bytes(r["text"])) for r in labelled.sample(part, labels, "toxic", 100).collect()) == want


def test_archives_are_rolled_by_bytes_and_keep_apart_from_clashing_columns(spark, monkeypatch):
    from netloom.llm import warc

    monkeypatch.setattr(warc, "CAPTURES_PER_FILE", 8)
    monkeypatch.setattr(warc, "FILE_BYTES", 8_000)
    sizes = [10] * 20 + [900, 1500, 1500, 3000, 7000, 300_000, 300_000, 0]
    rows = [(k, f"http://x/{k}", chr(97 + min(k, 25)) * n, "r", "d", "c", 1, 2, "h") for k, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, payload_digest string, capture string, first_id long, kind long, __hot string").repartition(1)
    path = warc.new_path(spark, "rolled")
    warc.write_archives(pages, path)
    files = {}
    for r in warc.read_records(spark, path).where("type in ('response', 'revisit')").collect():
        files.setdefault(r["file"], []).append((r["page_id"], r["payload_bytes"]))
    assert sorted(x for f in files.values() for x in f) == [(k, n) for k, n in enumerate(sizes)]
    assert all(len(f) == 1 or (len(f) <= 8 and sum(n for _, n in f) <= 8_000) for f in files.values()) and len(files) < 12
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert [got[k]["payload_bytes"] for k in range(len(sizes))] == sizes and all(r["complete"] for r in got.values())
    assert (got[25]["record_type"], got[26]["record_type"], got[26]["refers_to"]) == ("response", "revisit", 25)


def test_records_come_one_at_a_time():
    from netloom.llm import warc

    record = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = warc.parse(record + b"not a record\r\n\r\n")
    assert next(found)[1:3] == (0, "warcinfo")
    for bad in (b"not a record\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0", record[:-2]):
        with pytest.raises(ValueError):
            list(warc.parse(record + bad))
    assert [len(p) for p in warc._pieces(iter([(b"x" * 5,)] * 5), size=10)] == [2, 2, 1]
    assert [len(p) for p in warc._pieces(iter([(None,)] * 5), rows=4)] == [4, 1]
