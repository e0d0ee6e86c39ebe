"""Context counts, token n-grams and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytewren.operators import context as cx
from bytewren.operators import telemetry as tm
from bytewren.plans.registry import BYTES, query, read
from bytewren.sources.streams import explode_bytes


@query(
    f"""WITH {BYTES}, g AS (SELECT stream_id, pos, lag(b) OVER (PARTITION BY stream_id ORDER BY pos) AS c, b FROM b),
    n AS (SELECT stream_id, count(*) OVER (PARTITION BY stream_id, c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
      count(*) OVER (PARTITION BY stream_id, c, b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM g WHERE c IS NOT NULL)
    SELECT stream_id, count(*) AS n, round(sum(-log2((h + 0.5) / (n + 128.0))), 4) AS bits FROM n GROUP BY stream_id"""
)
def order_1_prior_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = cx.order_k_costs(read(spark, sf_dir, "documents"), "doc_id", "text", 1)
    return costs.select("stream_id", "n", F.round("bits", 4).alias("bits"))


@query(
    f"""WITH {BYTES}, l AS (SELECT *, {", ".join(f"lag(b, {o}) OVER w AS l{o}" for o in (1, 2, 3, 4, 8, 12))} FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
    s AS ({" UNION ALL ".join(f"SELECT stream_id, {i} AS skip, concat_ws(' ', {', '.join(f'l{o}' for o in s)}) AS ctx, b FROM l WHERE pos >= {max(s)}" for i, s in enumerate(cx.SKIPS))})
    SELECT skip, count(*) AS n_contexts, CAST(sum(n) AS BIGINT) AS n, max(n) AS n_most FROM (SELECT skip, ctx, count(*) AS n FROM s GROUP BY ALL) GROUP BY skip"""
)
def sparse_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cx.skip_counts(read(spark, sf_dir, "documents"), "text")
    return counts.groupBy("skip").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n"), F.max("n").alias("n_most"))


@query(
    f"""WITH {BYTES}, l AS (SELECT stream_id, pos, b, lag(b) OVER (PARTITION BY stream_id ORDER BY pos) AS c FROM b),
    g AS (SELECT stream_id, b, coalesce(lag(b) OVER (PARTITION BY stream_id, c ORDER BY pos), 0) AS guess FROM l WHERE c IS NOT NULL)
    SELECT stream_id, count(*) AS n, count(*) FILTER (b = guess) AS hits FROM g GROUP BY stream_id"""
)
def icm_last_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.successor_hits(read(spark, sf_dir, "documents"), "doc_id", "text")


_TOKENS = """w AS (SELECT role, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT role, w, generate_subscripts(w, 1) AS i FROM w),
    g AS (""" + " UNION ALL ".join(f"SELECT role, {k} AS k, concat_ws(' ', {', '.join(f'w[i - {k - j}]' for j in range(k))}) AS ctx, w[i] AS token FROM p WHERE i > {k}" for k in range(1, 5)) + """),
    c AS (SELECT role, k, ctx, token, count(*) AS n FROM g GROUP BY ALL)"""


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("role", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.token_grams(_talk(spark, sf_dir), "w", "role")


@query(f"WITH {_TOKENS} SELECT * FROM c")
def token_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir)


@query(f"WITH {_TOKENS} SELECT role, k, ctx, CAST(sum(n) AS BIGINT) AS total, round(max(n) / sum(n), 6) AS confidence FROM c GROUP BY ALL HAVING sum(n) >= 2")
def ngram_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.confidences(_tokens(spark, sf_dir), "role").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_TOKENS}, h AS (SELECT *, [{', '.join(map(str, cx.WEIGHTS))}][k] AS weight FROM c) SELECT role, token, round(sum(weight * 0.5 * ln((n + {cx.ALPHA}) / {cx.ALPHA})), 5) AS bias FROM h GROUP BY role, token")
def ngram_bias_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token's bias summed over the contexts of a role, at scale 0.5."""
    counts = _tokens(spark, sf_dir)
    return counts.groupBy("role", "token").agg(F.round(F.sum(cx.bias_logit(F.col("n"), F.col("k"), 0.5)), 5).alias("bias"))


@query(f"WITH {_TOKENS}, t AS (SELECT role, k, ctx, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT role, count(DISTINCT token) AS v FROM c GROUP BY role) SELECT role, k, ctx, token, round(ln((n + {cx.ALPHA}) / (total + {cx.ALPHA} * v)), 6) AS logit, round(ln({cx.ALPHA} / (total + {cx.ALPHA} * v)), 6) AS unseen FROM c JOIN t USING (role, k, ctx) JOIN v USING (role)")
def ngram_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of the tokens seen after each context of every order, and of any other token.

    Totals come from a window over the counts, not from a join: the tables' size tells nothing of that of the counts, which Spark took for small enough to send.
    """
    talk = _talk(spark, sf_dir).where("role is not null")
    after = talk.select("role", F.explode(F.slice("w", 2, F.greatest(F.size("w"), F.lit(0)))).alias("token")).distinct()
    words = after.groupBy("role").agg(F.count("*").alias("v"))
    totals = cx.token_grams(talk, "w", "role").withColumn("total", F.sum("n").over(Window.partitionBy("role", "k", "ctx")))
    joined = totals.join(F.broadcast(words), "role")  # a row for each of the few roles
    logit = lambda n: F.round(cx.standalone_logit(n, F.col("total"), F.col("v")), 6)
    return joined.select("role", "k", "ctx", "token", logit(F.col("n")).alias("logit"), logit(F.lit(0)).alias("unseen"))


_ASKED = " UNION ALL ".join(f"SELECT id, role, i, {k} AS k, concat_ws(' ', {', '.join(f'w[i - {k - j}]' for j in range(k))}) AS ctx FROM q WHERE i > {k}" for k in range(1, 5))


@query(f"WITH {_TOKENS}, s AS (SELECT role, k, ctx, max(n) / sum(n) AS confidence FROM c GROUP BY ALL HAVING sum(n) >= 2), u AS (SELECT conv_id * 1000 + turn AS id, role, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations), q AS (SELECT id, role, w, generate_subscripts(w, 1) AS i FROM u), a AS ({_ASKED}), m AS (SELECT id, role, i, max(k) AS k, arg_max(confidence, k) AS confidence FROM a JOIN s USING (role, k, ctx) GROUP BY ALL) SELECT role, k, count(*) AS n, round(avg(confidence), 6) AS confidence FROM m GROUP BY role, k")
def ngram_position_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every position the highest order whose context was met twice or more, and its confidence."""
    known = cx.confidences(_tokens(spark, sf_dir).where("role is not null"), "role")
    found = cx.position_confidences(known, "role")
    mean = F.sum(F.col("confidence") * F.col("n")) / F.sum("n")
    return found.groupBy("role", "k").agg(F.sum("n").alias("n"), F.round(mean, 6).alias("confidence"))


@query("WITH w AS (SELECT role, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM conversations), c AS (SELECT role, w, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT role, sum(n) AS t FROM c GROUP BY role), s AS (SELECT role, n, -log2(n / t) / octet_length(encode(w)) AS bits, unnest(regexp_extract_all(hex(encode(w)), '..')) AS h FROM c JOIN t USING (role)) SELECT role, CAST('0x' || h AS INTEGER) AS b, CAST(sum(n) AS BIGINT) AS n, round(sum(n * bits), 4) AS bits FROM s GROUP BY role, b")
def token_bits_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token's cost under its role's shares, dealt evenly to its bytes, and summed by byte."""
    words = read(spark, sf_dir, "conversations").select("role", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("role", "w").agg(F.count("*").alias("n"))
    total = F.broadcast(words.groupBy("role").agg(F.sum("n").alias("t")))  # a row for each of the few roles
    cost = words.join(total, "role").select("role", "n", "w", (-F.log2(F.col("n") / F.col("t")) / F.octet_length("w")).alias("bits"))
    each = explode_bytes(cost, "role", "w", 0, "n", "bits")
    return each.groupBy(F.col("stream_id").alias("role"), "b").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("bits")), 4).alias("bits"))


@query("SELECT r.role, round(t.e, 6) AS entropy, round(greatest(0.2, least(2.5, 0.4 + 0.6 * t.e / 5.5)) * 0.5, 6) AS scale FROM (SELECT DISTINCT role FROM conversations) r JOIN (SELECT role, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM (SELECT role, w, count(*) AS n FROM (SELECT role, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM conversations) GROUP BY ALL) GROUP BY role) t USING (role)")
def ngram_entropy_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-gram's scale from the entropy in nats of each role's tokens."""
    words = read(spark, sf_dir, "conversations").select("role", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("role", "w").agg(F.count("*").alias("n"))
    found = words.groupBy("role").agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias("e"))
    return found.select("role", F.round("e", 6).alias("entropy"), F.round(cx.entropy_scale(F.col("e"), 0.5), 6).alias("scale"))


def _match_sql(tail: str) -> str:
    """Contexts of 4 bytes as a number; of 8 to 128 as digests of pairs of the one half as long."""
    lags = " UNION ALL ".join(f"SELECT stream_id, pos, len, lag(pos, {i}) OVER w AS source FROM k WINDOW w AS (PARTITION BY stream_id, len, ctx ORDER BY pos)" for i in range(1, cx.CANDIDATES + 1))
    longer = ", ".join(f"k{2 * n} AS (SELECT *, md5(lag(c{n}, {n}) OVER (PARTITION BY stream_id ORDER BY pos) || ' ' || c{n}) AS c{2 * n} FROM k{n})" for n in cx.LENGTHS[:-1])
    keys = " UNION ALL ".join(f"SELECT stream_id, pos, {m} AS len, c{m} AS ctx FROM k{cx.LENGTHS[-1]} WHERE pos >= {m}" for m in cx.LENGTHS)
    return f"""WITH {BYTES}, l AS (SELECT stream_id, pos, lag(b, 1) OVER w AS l1, lag(b, 2) OVER w AS l2, lag(b, 3) OVER w AS l3, lag(b, 4) OVER w AS l4 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
    k4 AS (SELECT stream_id, pos, CAST(((CAST(l4 AS BIGINT) * 256 + l3) * 256 + l2) * 256 + l1 AS VARCHAR) AS c4 FROM l), {longer}, k AS ({keys}),
    c AS (SELECT * FROM ({lags}) WHERE source IS NOT NULL AND source + 1 < pos), m AS (SELECT stream_id, pos, max(len) AS match_len FROM c GROUP BY ALL) {tail}"""


@query(_match_sql("SELECT stream_id, count(*) AS hits, CAST(sum(match_len) AS BIGINT) AS total_len, max(match_len) AS longest FROM m GROUP BY stream_id"))
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest context of 4 to 128 bytes that occurred before in the document."""
    return cx.match_stats(read(spark, sf_dir, "documents"), "doc_id", "text").drop("bits")


@query(_match_sql(f", n AS (SELECT doc_id AS stream_id, octet_length(encode(text)) AS n FROM documents), a AS (SELECT stream_id, count(*) AS hits, avg(match_len) AS l FROM m GROUP BY stream_id) SELECT n.stream_id, round(coalesce(hits, 0) / greatest(n, 1), 6) AS hit_rate, round(coalesce(l, 0), 6) AS mean_len, round(coalesce(hits, 0) * coalesce(l, 0) / 1000, 6) AS effectiveness FROM n LEFT JOIN a USING (stream_id)"))
def match_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = cx.match_stats(docs, "doc_id", "text").select("stream_id", "hits", (F.col("total_len") / F.col("hits")).alias("l"))
    sizes = docs.select(F.col("doc_id").alias("stream_id"), F.octet_length("text").alias("n"))
    joined = sizes.join(found, "stream_id", "left")
    return joined.select("stream_id", F.round(F.coalesce("hits", F.lit(0)) / F.greatest("n", F.lit(1)), 6).alias("hit_rate"), F.round(F.coalesce("l", F.lit(0.0)), 6).alias("mean_len"), F.round(tm.effectiveness(F.coalesce("hits", F.lit(0)), F.coalesce("l", F.lit(0.0))), 6).alias("effectiveness"))


@query(_match_sql(f""", v AS (SELECT c.stream_id, c.pos, match_len, x.b AS vote, y.b AS b FROM c JOIN m ON c.stream_id = m.stream_id AND c.pos = m.pos AND c.len = m.match_len JOIN b x ON x.stream_id = c.stream_id AND x.pos = source JOIN b y ON y.stream_id = c.stream_id AND y.pos = c.pos),
    p AS (SELECT stream_id, pos, match_len, (sum(CASE WHEN vote = b THEN match_len ELSE 0 END) + {cx.SMOOTH}) / (sum(match_len) + {256 * cx.SMOOTH}) AS p FROM v GROUP BY ALL) SELECT stream_id, count(*) AS n, round(sum(-log2(p)), 4) AS bits FROM p GROUP BY stream_id"""))
def match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cx.match_stats(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("stream_id", F.col("hits").alias("n"), F.round("bits", 4).alias("bits"))
