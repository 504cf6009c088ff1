"""The operators over their intended tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clustering, mixing, near_dedup, ogg, packing, pii, quality, token_counts, topk, toxicity, warc, whitening
from .common import new_path, table

THRESHOLD = 0.3


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(*pii.disclosures(table(spark, sf_dir, "documents")), "doc_id")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out)
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.encode_column(table(spark, sf_dir, "documents"))).drop("error")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def kept_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"), kept_out)
    scored = quality.score(docs, net)
    return scored.select("doc_id", F.coalesce(kept_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat, op2_topk, op3_near_dedup, op4_mixing, op5_warc, op6_packing, op7_pii, op8_toxicity, op9_ogg, op10_token_counts, op11_clusters, op12_whitening, op13_quality)
}


def clusters_sql(rounds: int = 10) -> str:
    """SQL of op11_clusters: each round as a table of assignments and one of centroids."""
    nearest = """(SELECT v.row, v.w, c.cluster, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance,
                    row_number() OVER (PARTITION BY v.row ORDER BY list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster) AS place
                  FROM v CROSS JOIN c{r} c)"""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
             WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), w) - 1 AS INTEGER) AS cluster, w FROM v
             ORDER BY sha256('3:' || vec_id) NULLS LAST, w LIMIT 8)""",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED (SELECT cluster, w FROM {nearest.format(r=r)} WHERE place = 1)")
        parts.append(f"""m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM
             (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, CAST(coalesce(m.w, c.w) AS BIGINT[]) AS w FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)")
    parts.append(f"f AS (SELECT row, cluster, distance FROM {nearest.format(r=rounds)} WHERE place = 1)")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT v.vec_id, f.cluster, CAST(f.distance AS BIGINT) AS distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(f.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
        FROM f JOIN v ON f.row = v.row JOIN c{rounds} c ON f.cluster = c.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
             o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM o""",
    "op11_clusters": clusters_sql(),
}
