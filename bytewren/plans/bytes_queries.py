"""Histograms, entropies, transforms and words of the documents' bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewren.operators import bytestats as bs
from bytewren.operators import context as cx
from bytewren.plans.registry import BYTES, query, read
from bytewren.sources.streams import byte_count, explode_bytes

ENTROPY = "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)"


def _bytes(spark: SparkSession, sf_dir: str, limit: int = 0, *keep: str) -> DataFrame:
    return explode_bytes(read(spark, sf_dir, "documents"), "doc_id", "text", limit, *keep)


@query(f"WITH {BYTES} SELECT stream_id, b, count(*) AS n FROM b GROUP BY ALL")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.histogram(_bytes(spark, sf_dir), "stream_id")


@query(f"WITH {BYTES}, h AS (SELECT stream_id, b, count(*) AS n FROM b GROUP BY ALL) SELECT stream_id, CAST(sum(n) AS BIGINT) AS n_bytes, {ENTROPY} AS entropy FROM h GROUP BY stream_id")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.entropy(bs.histogram(_bytes(spark, sf_dir), "stream_id"), "stream_id")
    return found.select("stream_id", F.col("total").alias("n_bytes"), F.round("entropy", 6).alias("entropy"))


@query(
    f"""WITH {BYTES}, l AS (SELECT lang, stream_id, pos, b, lag(b) OVER (PARTITION BY stream_id ORDER BY pos) AS p FROM b JOIN documents ON doc_id = stream_id),
    h AS (SELECT lang, b, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT lang, p, b, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY ALL),
    c AS (SELECT lang, p, sum(n) AS n FROM p GROUP BY ALL),
    e0 AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM h GROUP BY lang),
    j AS (SELECT lang, sum(n) AS t, sum(n * log2(n)) AS s FROM p GROUP BY lang), m AS (SELECT lang, sum(n * log2(n)) AS s FROM c GROUP BY lang)
    SELECT e0.lang, n_bytes, entropy, round((m.s - j.s) / j.t, 6) AS conditional_entropy FROM e0 JOIN j USING (lang) JOIN m USING (lang)"""
)
def byte_entropy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a byte, and of a byte given the one before it, by language: both from one histogram of pairs."""
    pairs = bs.pair_counts(read(spark, sf_dir, "documents"), "text", "lang")
    marginal = bs.entropy(pairs.groupBy("lang", "c").agg(F.sum("n").alias("n")), "lang")
    inner = pairs.where("p >= 0")
    of_pairs = inner.groupBy("lang").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    of_contexts = inner.groupBy("lang", "p").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum(F.col("n") * F.log2("n")).alias("m"))
    joined = marginal.join(of_pairs, "lang").join(of_contexts, "lang")
    return joined.select("lang", F.col("total").alias("n_bytes"), F.round("entropy", 6).alias("entropy"), F.round((F.col("m") - F.col("s")) / F.col("t"), 6).alias("conditional_entropy"))


@query(f"WITH {BYTES}, j AS (SELECT unnest(range(8)) AS j) SELECT stream_id, CAST(j AS INTEGER) AS j, CAST(sum((b >> CAST(7 - j AS INTEGER)) & 1) AS BIGINT) AS ones, count(*) AS n FROM b, j GROUP BY ALL")
def bit_ones_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ones at each bit of a byte, most significant first; bits are taken from the histogram, not from every byte."""
    return bs.bit_ones(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH {BYTES}, s AS (SELECT unnest([2, 4, 8]) AS stride), h AS (SELECT stream_id, stride, pos % stride AS lane, b, count(*) AS n FROM b, s GROUP BY ALL),
    e AS (SELECT stream_id, stride, lane, sum(n) AS t, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM h GROUP BY ALL)
    SELECT stream_id, CAST(stride AS INTEGER) AS stride, round(CASE WHEN sum(t) < stride THEN 8.0 ELSE sum(e * t) / sum(t) END, 6) AS entropy FROM e GROUP BY stream_id, stride"""
)
def plane_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.stream_entropies(read(spark, sf_dir, "documents"), "doc_id", "text", planes=bs.PLANES)
    return found.select("stream_id", "stride", F.round("entropy", 6).alias("entropy"))


@query(
    f"""WITH {BYTES}, s AS (SELECT unnest([1, 2, 4, 8]) AS stride), l AS (SELECT x.stream_id, s.stride, CASE WHEN y.b IS NULL THEN x.b ELSE (x.b - y.b + 256) % 256 END AS d
      FROM b x CROSS JOIN s LEFT JOIN b y ON y.stream_id = x.stream_id AND y.pos = x.pos - s.stride),
    h AS (SELECT stream_id, stride, d, count(*) AS n FROM l GROUP BY ALL)
    SELECT stream_id, CAST(stride AS INTEGER) AS stride, {ENTROPY} AS entropy FROM h GROUP BY stream_id, stride"""
)
def delta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.stream_entropies(read(spark, sf_dir, "documents"), "doc_id", "text", deltas=bs.DELTAS)
    return found.select("stream_id", "stride", F.round("entropy", 6).alias("entropy"))


@query(
    f"""WITH {BYTES}, l AS (SELECT stream_id, pos, b, lag(b, 4) OVER (PARTITION BY stream_id ORDER BY pos) AS p FROM b)
    SELECT stream_id, count(*) AS n_bytes, CAST(sum((CASE WHEN p IS NULL THEN b ELSE (b - p + 256) % 256 END) * (pos % 97 + 1)) AS BIGINT) AS encoded_sum, CAST(0 AS BIGINT) AS mismatches FROM l GROUP BY stream_id"""
)
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stride 4, encoded and decoded again by running sums; encoded_sum weighs each encoded byte by its position."""
    return bs.delta_trip(read(spark, sf_dir, "documents"), "doc_id", "text", 4)


@query(
    f"""WITH {BYTES}, r AS (SELECT stream_id, b, row_number() OVER (PARTITION BY stream_id ORDER BY pos % 4, pos) - 1 AS q FROM b)
    SELECT stream_id, count(*) AS n_bytes, CAST(sum(b * (q % 97 + 1)) AS BIGINT) AS encoded_sum, CAST(0 AS BIGINT) AS mismatches FROM r GROUP BY stream_id"""
)
def byteplane_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stride 4: the permutation and its inverse in closed form, so that nothing is sorted."""
    docs = read(spark, sf_dir, "documents").withColumn("n", byte_count("text"))
    each = explode_bytes(docs, "doc_id", "text", 0, "n").withColumn("q", bs.plane_position(4, F.col("pos"), F.col("n")))
    back = bs.plane_source(4, F.col("q"), F.col("n"))
    return each.groupBy("stream_id").agg(F.count("*").alias("n_bytes"), F.sum(F.col("b") * (F.col("q") % 97 + 1)).cast("long").alias("encoded_sum"), F.count_if(back != F.col("pos")).alias("mismatches"))


_CANDIDATES = ", ".join(f"max(e) FILTER (t = '{t}') AS {t}" for t in ("identity", "delta_1", "delta_2", "delta_4", "delta_8", "byteplane_2", "byteplane_4", "byteplane_8"))


def _detect_sql() -> str:
    steps, before = [], "s0"
    tests = [(f"delta_{s}", f"n > {s}") for s in bs.DELTAS] + [(f"byteplane_{s}", f"n // {s} >= {bs.PLANE_SAMPLES}") for s in bs.PLANES]
    for i, (name, enough) in enumerate(tests, 1):
        better = f"({enough} AND {name} < bh - {bs.GAIN})"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (bt, bh), CASE WHEN {better} THEN '{name}' ELSE bt END AS bt, CASE WHEN {better} THEN {name} ELSE bh END AS bh FROM {before})")
        before = f"s{i}"
    return f"""WITH {BYTES}, p AS (SELECT * FROM b WHERE pos < {bs.SAMPLE}),
    l AS (SELECT *, lag(b, 1) OVER w AS l1, lag(b, 2) OVER w AS l2, lag(b, 4) OVER w AS l4, lag(b, 8) OVER w AS l8 FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
    t AS (SELECT stream_id, 'identity' AS t, 0 AS lane, b AS v FROM l
      {" ".join(f"UNION ALL SELECT stream_id, 'delta_{s}', 0, CASE WHEN l{s} IS NULL THEN b ELSE (b - l{s} + 256) % 256 END FROM l" for s in bs.DELTAS)}
      {" ".join(f"UNION ALL SELECT stream_id, 'byteplane_{s}', pos % {s}, b FROM l" for s in bs.PLANES)}),
    h AS (SELECT stream_id, t, lane, v, count(*) AS n FROM t GROUP BY ALL),
    e AS (SELECT stream_id, t, lane, sum(n) AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM h GROUP BY ALL),
    g AS (SELECT stream_id, t, sum(n) AS n, sum(e * n) / sum(n) AS e FROM e GROUP BY ALL),
    s0 AS (SELECT stream_id, max(n) AS n, {_CANDIDATES}, 'identity' AS bt, max(e) FILTER (t = 'identity') AS bh FROM g GROUP BY stream_id), {", ".join(steps)}
    SELECT doc_id AS stream_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sample, round(CASE WHEN coalesce(n, 0) < 16 THEN 0.0 ELSE identity END, 6) AS raw_entropy,
      round(CASE WHEN coalesce(n, 0) < 16 THEN 0.0 ELSE bh END, 6) AS best_entropy, CASE WHEN coalesce(n, 0) < 16 THEN 'identity' ELSE bt END AS transform
    FROM documents LEFT JOIN {before} ON stream_id = doc_id"""


@query(_detect_sql())
def detect_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.detect_transform(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumns({"raw_entropy": F.round("raw_entropy", 6), "best_entropy": F.round("best_entropy", 6)})


@query(_detect_sql().replace("FROM documents LEFT JOIN", "FROM (SELECT page_id AS doc_id FROM pages) LEFT JOIN").replace("SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs FROM documents", "SELECT page_id AS doc_id, regexp_extract_all(hex(encode(html)), '..') AS hs FROM pages"))
def detect_transform_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.detect_transform(read(spark, sf_dir, "pages"), "page_id", "html")
    return found.withColumns({"raw_entropy": F.round("raw_entropy", 6), "best_entropy": F.round("best_entropy", 6)})


def _adaptive_sql() -> str:
    """Every byte under its stream's transform, from the detection's SQL."""
    found = _detect_sql()
    value = "CASE transform " + " ".join(f"WHEN 'delta_{s}' THEN CASE WHEN l{s} IS NULL THEN b ELSE (b - l{s} + 256) % 256 END" for s in bs.DELTAS) + " ELSE b END"
    place = "CASE transform " + " ".join(f"WHEN 'byteplane_{s}' THEN (pos % {s}) * (n // {s}) + least(pos % {s}, n % {s}) + pos // {s}" for s in bs.PLANES) + " ELSE pos END"
    return f"""WITH f AS ({found}), {BYTES}, w AS (SELECT *, {", ".join(f"lag(b, {s}) OVER o AS l{s}" for s in bs.DELTAS)}, count(*) OVER (PARTITION BY stream_id) AS n FROM b WINDOW o AS (PARTITION BY stream_id ORDER BY pos)),
    e AS (SELECT stream_id, transform, {value} AS v, {place} AS p FROM w JOIN f USING (stream_id))
    SELECT stream_id, transform, count(*) AS n_bytes, CAST(sum(v * (p % 97 + 1)) AS BIGINT) AS encoded_sum FROM e GROUP BY stream_id, transform"""


@query(_adaptive_sql())
def adaptive_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every stream under its own transform."""
    return bs.adaptive_digest(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {BYTES} SELECT CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END AS b, count(*) AS n, count(*) FILTER (b BETWEEN 65 AND 90) AS folded FROM b GROUP BY 1")
def case_fold_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bs.histogram(_bytes(spark, sf_dir))
    return raw.groupBy(bs.case_fold(F.col("b")).alias("b")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("b").between(65, 90), F.col("n")).otherwise(0)).alias("folded"))


@query(f"WITH {BYTES} SELECT stream_id, count(*) AS n_bytes, CAST(sum(b) AS BIGINT) AS byte_sum FROM b WHERE pos < 1000 GROUP BY stream_id")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's byte limit: a stream's first 1000 bytes, cut before the explosion."""
    return _bytes(spark, sf_dir, 1000).groupBy("stream_id").agg(F.count("*").alias("n_bytes"), F.sum("b").alias("byte_sum"))


_SEPARATORS = ", ".join(map(str, bs.SEPARATORS))
_WORDS = f"""{BYTES}, f AS (SELECT stream_id, pos, b IN ({_SEPARATORS}) AS sep, CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END AS b FROM b),
    g AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos) AS island FROM f),
    w AS (SELECT stream_id, min(pos) AS start, string_agg(chr(b), '' ORDER BY pos) AS word FROM g WHERE NOT sep GROUP BY stream_id, island),
    l AS (SELECT stream_id, word, lag(word) OVER v AS p1, lag(word, 2) OVER v AS p2 FROM w WINDOW v AS (PARTITION BY stream_id ORDER BY start))"""


@query(f"WITH {_WORDS} SELECT stream_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, CAST(sum(length(word)) AS BIGINT) AS n_word_bytes FROM l GROUP BY stream_id")
def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.word_stats(read(spark, sf_dir, "documents"), "doc_id", "text").select("stream_id", "n_words", "n_distinct", "n_word_bytes")


@query(f"WITH {_WORDS} SELECT p1 AS previous, word, count(*) AS n FROM l WHERE p1 IS NOT NULL GROUP BY ALL")
def word_bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.word_pairs(read(spark, sf_dir, "documents"), "text")


@query(f"WITH {_WORDS} SELECT stream_id, count(DISTINCT (p2, p1)) AS n_contexts, count(*) AS n FROM l WHERE p2 IS NOT NULL GROUP BY stream_id")
def word_pair_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bs.word_stats(read(spark, sf_dir, "documents"), "doc_id", "text").where("n_words > 2")
    return found.select("stream_id", "n_contexts", "n_pairs").withColumnRenamed("n_pairs", "n")


def _orders(sql: str) -> str:
    return f"""WITH {BYTES}, l AS (SELECT *, lag(b, 1) OVER w AS l1, lag(b, 2) OVER w AS l2, lag(b, 3) OVER w AS l3, lag(b, 4) OVER w AS l4 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
    g AS (SELECT lang, 0 AS k, '' AS ctx, b FROM l JOIN documents ON doc_id = stream_id UNION ALL SELECT lang, 1, chr(l1), b FROM l JOIN documents ON doc_id = stream_id WHERE l1 IS NOT NULL
      UNION ALL SELECT lang, 2, concat(l2, ' ', l1), b FROM l JOIN documents ON doc_id = stream_id WHERE l2 IS NOT NULL
      UNION ALL SELECT lang, 3, concat(l3, ' ', l2, ' ', l1), b FROM l JOIN documents ON doc_id = stream_id WHERE l3 IS NOT NULL
      UNION ALL SELECT lang, 4, concat(l4, ' ', l3, ' ', l2, ' ', l1), b FROM l JOIN documents ON doc_id = stream_id WHERE l4 IS NOT NULL),
    c AS (SELECT lang, k, ctx, b, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT lang, k, ctx, sum(n) AS n FROM c GROUP BY ALL) {sql}"""


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, k, ctx, nxt, n) for k from 0 to 4."""
    return cx.order_counts(read(spark, sf_dir, "documents"), "text", "lang")


@query(_orders("SELECT lang, k, count(DISTINCT ctx) AS n_contexts, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL"))
def order_k_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _order_counts(spark, sf_dir).groupBy("lang", "k", "ctx").agg(F.count("*").alias("p"), F.sum("n").alias("n"))
    return contexts.groupBy("lang", "k").agg(F.count("*").alias("n_contexts"), F.sum("p").alias("n_pairs"), F.sum("n").alias("n"))


@query(_orders(", a AS (SELECT lang, k, sum(n) AS n, sum(n * log2(n)) AS s FROM c GROUP BY ALL), m AS (SELECT lang, k, sum(n * log2(n)) AS s FROM t GROUP BY ALL) SELECT lang, k, round((m.s - a.s) / a.n, 6) AS entropy FROM a JOIN m USING (lang, k)"))
def cond_entropy_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a byte given the k before it; contexts and pairs are summed in one pass over the counts."""
    x = lambda n: F.col(n) * F.log2(n)
    contexts = _order_counts(spark, sf_dir).groupBy("lang", "k", "ctx").agg(F.sum("n").alias("n"), F.sum(x("n")).alias("s"))
    return contexts.groupBy("lang", "k").agg(F.round((F.sum(x("n")) - F.sum("s")) / F.sum("n"), 6).alias("entropy"))
