"""The operators on their tables, and what of them SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, embeddings, lm, merkle, mixing, nbsvm, pii, rules, simhash, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark, sf_dir):
    return nbsvm.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def transactions(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def encoding(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), *ranks())


def ranks() -> tuple[str, str]:
    """Path of the rank file on each machine, and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def near_vectors(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def weak_rules(spark, sf_dir):
    return rules.judged(_table(spark, sf_dir, "documents"))


def toxic(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def language_model(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


def near_texts(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def mixed(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("key")


def passages(spark, sf_dir):
    return substring.dedup_digests(_table(spark, sf_dir, "documents"))


def personal(spark, sf_dir):
    return pii.found(_table(spark, sf_dir, "documents"))


def merkle_manifest(spark, sf_dir):
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def clusters(spark, sf_dir):
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _merkle_sql(levels: int = 6) -> str:
    """The tree of up to 16**levels leaves a source, level by level, and of as many sources."""
    field = lambda c, n: f"coalesce({n} || ':' || {c}, '-')"
    leaf = lambda t: " || ".join([field(f"CAST({c} AS VARCHAR)", f"length(CAST({c} AS VARCHAR))") for c in ("doc_id",)] + [field(c, f"strlen({c})") for c in ("source", "lang")] + [field("CAST(n_chars AS VARCHAR)", "length(CAST(n_chars AS VARCHAR))"), field(t, f"strlen({t})")])

    def climb(name: str, leaves: str, root: str) -> str:
        """CTEs name0.. of (g, i, d): nodes by level; and of each leaf's siblings by level."""
        out = [f"{name}0 AS MATERIALIZED (SELECT g, i, d FROM {leaves})"]
        for k in range(levels):
            one = f"SELECT g, i // 16 AS r, string_agg(d, '' ORDER BY i) AS t, count(*) AS c, max(count(*)) OVER (PARTITION BY g) AS most, count(*) OVER (PARTITION BY g) AS runs FROM {name}{k} GROUP BY g, i // 16"
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, r, t, NOT (runs = 1 AND c = 1) AS more FROM ({one}) q)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, r AS i, CASE WHEN more THEN sha256(t) ELSE t END AS d FROM {name}r{k})")
        out.append(f"{root} AS MATERIALIZED (SELECT g, d FROM {name}{levels})")
        return ", ".join(out)

    def fold(name: str, k: int) -> str:
        place = f"CAST(64 * ((x.i // {16**k}) % 16) AS BIGINT)"
        before, after = f"left(r.t, {place})", f"substr(r.t, {place} + 65)"
        joined = f"FROM x JOIN {name}r{k} r ON r.g IS NOT DISTINCT FROM x.g AND r.r = x.i // {16 ** (k + 1)}"
        return f"SELECT x.* REPLACE (CASE WHEN r.more THEN x.proof || {before} || {after} ELSE x.proof END AS proof, CASE WHEN r.more THEN sha256({before} || x.f || {after}) ELSE x.f END AS f) {joined}"

    steps, last = [], "start"
    for name in ("s", "t"):
        if name == "t":
            steps.append(f"over AS MATERIALIZED (SELECT x.* REPLACE (0 AS g, o.i AS i) FROM {last} x JOIN ordered o ON o.source IS NOT DISTINCT FROM x.g)")
            last = "over"
        for k in range(levels):
            steps.append(f"{name}f{k} AS MATERIALIZED ({fold(name, k).replace('FROM x ', f'FROM {last} x ')})")
            last = f"{name}f{k}"
    # crc32, bit by bit
    bit = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, b: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, ch))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda crc, ch: {bit}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH h AS MATERIALIZED (SELECT doc_id, source, sha256({leaf("text")}) AS d, CASE WHEN {crc} % 5 = 0 THEN sha256({leaf(low)}) ELSE sha256({leaf("text")}) END AS bad FROM documents),
        leaves AS MATERIALIZED (SELECT *, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM h),
        {climb("s", "leaves", "subroots")}, ordered AS MATERIALIZED (SELECT g AS source, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, d FROM subroots),
        {climb("t", "ordered", "roots")}, start AS MATERIALIZED (SELECT doc_id, source, d AS leaf, g, i, '' AS proof, bad AS f FROM leaves), {", ".join(steps)}
        SELECT x.doc_id, x.source, leaf, s.d AS subroot, o.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = o.d AS verified
        FROM {last} x JOIN subroots s ON s.g IS NOT DISTINCT FROM x.source CROSS JOIN roots o"""


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other, every distance in full."""
    made = []
    for n in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        made.append(f"a{n} AS MATERIALIZED (SELECT n, min({{'d': CAST({far} AS BIGINT), 'c': c.c}}) AS m FROM v CROSS JOIN c{n} c GROUP BY n)")
        if n < rounds:
            sums = f"SELECT m.c AS c, p, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(e) AS x, unnest(range(64)) AS p FROM a{n} JOIN v USING (n)) q GROUP BY m.c, p"
            means = f"SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY p) AS e FROM ({sums}) q GROUP BY c"
            made.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN ({means}) m ON m.c = c.c)")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}) q), {", ".join(made)}
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (n) JOIN c{rounds} c ON c.c = m.c"""


def queries() -> dict:
    return {
        "op1_quality_nbsvm": quality,
        "op2_warc_transactions": transactions,
        "op3_byte_bpe": encoding,
        "op4_embedding_pca_tiles": near_vectors,
        "op5_weak_supervision": weak_rules,
        "op6_toxicity_counterfactual": toxic,
        "op7_lm_elias_fano": language_model,
        "op8_simhash_byte_index": near_texts,
        "op9_source_mix": mixed,
        "op10_substring_countmin": passages,
        "op11_pii_skip_chain": personal,
        "op12_merkle_manifest": merkle_manifest,
        "op13_centroid_partial_distance": clusters,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc_transactions": """
            WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first_id < page_id THEN first_id END AS refers_to, TRUE AS complete
            FROM f""",
        "op10_substring_countmin": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
            least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT win.doc_id, i FROM win JOIN least ON win.s = least.s WHERE m < win.doc_id)),
            words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
            kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS k, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
            FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
        "op12_merkle_manifest": _merkle_sql(),
        "op13_centroid_partial_distance": _cluster_sql(),
    }
