"""The opN_* queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewren.llm import bpe, class_lm, mixing, ogg, pivots, secret_scan, simhash, suffixes, token_counts, toxicity
from bytewren.plans.registry import BYTES

RANKS = "byte_bpe_50k.tiktoken"
#: Vocabularies whose words are cheap guesses in a secret scan.
WORDS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return simhash.fingerprint_duplicates(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), hexed, F.col("component").alias("component_id"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (toxicity.fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    kept = F.col("id").eqNullSafe(F.col("component")).alias("kept")
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return counted.select(F.col("id").alias("doc_id"), "n_tokens")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.lm_scores(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    ranks = secret_scan.dictionary(docs, vocabularies=[public_tokenizers.path(w) for w in WORDS])
    return secret_scan.scan(docs, ranks=ranks).withColumnRenamed("id", "doc_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_suffix_dedup,
        op3_toxicity,
        op4_source_mixing,
        op5_embedding_near_dedup,
        op6_token_counts,
        op7_class_lm,
        op8_secret_scan,
        op9_byte_bpe,
        op10_ogg_media,
    )
}


def _mixing_sql() -> str:
    """The mix without histograms: running sums in the order of the hash give the same thresholds."""
    rounds, last = [], "g0"
    for k in range(1, mixing.ROUNDS + 1):
        before = " ".join(f"AND NOT coalesce(size <= room{j} AND h <= lim{j}, false)" for j in range(1, k))
        rounds += [
            f"e{k} AS (SELECT d.source, size, h, room, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS run FROM d JOIN {last} g ON d.source IS NOT DISTINCT FROM g.source WHERE size > 0 AND size <= room {before})",
            f"l{k} AS (SELECT source, max(h) FILTER (run <= room) AS lim, coalesce(sum(size) FILTER (run <= room), 0) AS used FROM e{k} GROUP BY source)",
            f"g{k} AS (SELECT g.* EXCLUDE (room), g.room AS room{k}, lim AS lim{k}, g.room - coalesce(used, 0) AS room FROM {last} g LEFT JOIN l{k} l ON g.source IS NOT DISTINCT FROM l.source)",
        ]
        last = f"g{k}"
    extra = " OR ".join(f"coalesce(size <= room{k} AND h <= lim{k}, false)" for k in range(1, mixing.ROUNDS + 1))
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source), r AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM s),
    o AS (SELECT *, {mixing.MOST} * n / w AS ratio, {mixing.SHARE} * sum(n) OVER () AS total FROM r),
    c AS (SELECT *, coalesce(sum({mixing.MOST} * n) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
    v AS (SELECT (total - capped) / rest AS level FROM c WHERE (total - capped) / rest <= ratio ORDER BY ratio, source LIMIT 1),
    t AS (SELECT source, n, least(CAST({mixing.MOST} * n AS DOUBLE), level * w) AS target FROM o, v),
    f AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM t), g0 AS (SELECT *, CAST(floor(target - whole * n) AS BIGINT) AS room FROM f), {", ".join(rounds)}
    SELECT doc_id, size, n AS source_size, target, CAST(size * (whole + CASE WHEN {extra} THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN {last} g ON d.source IS NOT DISTINCT FROM g.source"""


def _suffix_sql() -> str:
    """Every 50-byte string by the byte at which it ends, put together from strings half as long."""
    over = "OVER (PARTITION BY stream_id ORDER BY pos)"
    before = lambda c, n: f"lag({c}, {n}) {over}"
    return f"""WITH {BYTES}, c4 AS (SELECT *, concat({before('b', 3)}, ' ', {before('b', 2)}, ' ', {before('b', 1)}, ' ', b) AS c4 FROM b),
    c8 AS (SELECT *, concat({before('c4', 4)}, ' ', c4) AS c8 FROM c4), c16 AS (SELECT *, concat({before('c8', 8)}, ' ', c8) AS c16 FROM c8), c32 AS (SELECT stream_id, pos, b, c16, concat({before('c16', 16)}, ' ', c16) AS c32 FROM c16),
    c48 AS (SELECT stream_id, pos, b, concat({before('c32', 16)}, ' ', c16) AS c48 FROM c32), k AS (SELECT stream_id, pos, b, CASE WHEN pos >= {suffixes.MINIMUM - 1} THEN md5(concat({before('c48', 2)}, ' ', {before('b', 1)}, ' ', b)) END AS k FROM c48),
    f AS (SELECT k, min(stream_id) AS first FROM k WHERE k IS NOT NULL GROUP BY k), m AS (SELECT stream_id, pos, b, coalesce(stream_id > first, false) AS late FROM k LEFT JOIN f USING (k)),
    g AS (SELECT stream_id, pos, b, max(CAST(late AS INTEGER)) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {suffixes.MINIMUM - 1} FOLLOWING) AS gone FROM m),
    h AS (SELECT *, coalesce(lag(gone) {over}, 0) AS gone_before FROM g),
    r AS (SELECT stream_id, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND gone_before = 0) AS n_spans, sha256(unhex(coalesce(string_agg(printf('%02X', b), '' ORDER BY pos) FILTER (gone = 0), ''))) AS sha FROM h GROUP BY stream_id)
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(sha, sha256('')) AS kept_sha256
    FROM documents LEFT JOIN r ON stream_id = doc_id"""


#: All pairs of a label by brute force; components by following links.
_VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
    u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
    e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= {pivots.THRESHOLD}),
    r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n ON a = v.vec_id"""

#: The others need XXH64, a trained model, a tokeniser's merges or a container, which SQL hasn't.
SQL: dict[str, str] = {"op2_suffix_dedup": _suffix_sql(), "op4_source_mixing": _mixing_sql(), "op5_embedding_near_dedup": _VECTOR_SQL}
