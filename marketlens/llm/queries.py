"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import centroids, decontaminate, html, jaccard, neighbours, packing, prefix_trie, quality, secrets, sharding, squares, warc, wavelet
from marketlens.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word", 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte", 0)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word", 1)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_html": op3_html,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_neighbours": op6_neighbours,
    "op7_token_ids": op7_token_ids,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_jaccard": op10_jaccard,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroids": op12_centroids,
    "op13_squares": op13_squares,
}

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * part + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)" for part in range(8) for shift in (15, 10, 5, 0)
)



def _kmeans_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every distance of every round, ties to the smaller number."""
    steps = [f"""
        v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v AS m FROM v QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (SELECT r, vec_id, v, j, list_sum(list_transform(generate_series(1, {dims}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM v, c{i}),
        a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, d::HUGEINT * 1000 + j) AS j, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT j, list(x ORDER BY i) AS m FROM (
            SELECT j, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{i}, generate_series(1, {dims}) g(i) GROUP BY j, i) GROUP BY j),
        c{i + 1} AS (SELECT j, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (j))""")
    return f"""WITH {",".join(steps)}
        SELECT vec_id, j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLE = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, true AS intact
        FROM d""",
    "op11_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                   xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                       lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (
            SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, pos) AS d, md5(length(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM (SELECT c.conv_id, 0 AS own, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
                  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h) c),
        p AS (SELECT conv_id, d, words, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        n AS (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY k),
        kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(k, d) AS k FROM p GROUP BY conv_id) GROUP BY k),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
        s AS (SELECT top.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM f top JOIN f ON starts_with(f.k, top.k) GROUP BY top.k)
        SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
               coalesce(ends, sha256('')) AS ends_sha256
        FROM f JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN f up ON f.depth > 0 AND up.k = left(f.k, length(f.k) - 32)""",
    "op12_centroids": _kmeans_sql(),
}
