"""Vector expressions, vector statistics, quantisation and cumulative frequencies, over the embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewren.functions import vectors as v
from bytewren.operators import vectors as vs
from bytewren.plans.registry import QUERIES, SQL, query, read

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"
DIGEST = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * i))"


def _digest_sql(expression: str, with_: str = "") -> str:
    return f"WITH {E}{with_}, r AS (SELECT vec_id, {expression} AS y FROM e) SELECT vec_id, CAST(len(y) AS INTEGER) AS width, round({DIGEST.format('y')}, 5) AS digest FROM r"


def _each(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A query that applies a vector expression to every embedding and returns its width and digest."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, "embeddings").select("vec_id", f(v.doubles("embedding")).alias("y"))
        return rows.select("vec_id", F.size("y").alias("width"), F.round(v.weighted_sum(F.col("y")), 5).alias("digest"))

    QUERIES[name], SQL[name] = run, _digest_sql(sql)


_STAGED = ", t AS (SELECT vec_id, list_max(x) AS m, x FROM e), u AS (SELECT vec_id, list_transform(x, lambda a: exp(a - m)) AS x FROM t), z AS (SELECT vec_id, x, list_sum(x) AS z FROM u)"
_NORM = "list_transform({0}, lambda a: (a - list_avg({0})) / sqrt(list_var_pop({0}) + 1e-5))"
_each("softmax", v.softmax, "list_transform(x, lambda a: a / z)")
SQL["softmax"] = _digest_sql("list_transform(x, lambda a: a / z)", _STAGED).replace("AS y FROM e)", "AS y FROM z)")
_each("layer_norm", v.layer_norm, _NORM.format("x"))
_each("group_norm", lambda x: v.group_norm(x, 8, 8), "flatten(list_transform(range(0, 8), lambda g: " + _NORM.format("x[g * 8 + 1 : g * 8 + 8]") + "))")
_each("normalize_heads", lambda x: v.normalize_heads(x, 4, 16), "flatten(list_transform(range(0, 4), lambda g: list_transform(x[g * 16 + 1 : g * 16 + 16], lambda a: a / sqrt(list_sum(list_transform(x[g * 16 + 1 : g * 16 + 16], lambda b: b * b))))))")
_each("elementwise_add_scaled", lambda x: v.add_scaled(x, F.reverse(x), 0.5), "list_transform(range(1, len(x) + 1), lambda i: x[i] + x[len(x) + 1 - i] * 0.5)")
_each("elementwise_sub_mul", lambda x: v.mul(v.sub(x, F.reverse(x)), v.add(x, F.reverse(x))), "list_transform(range(1, len(x) + 1), lambda i: (x[i] - x[len(x) + 1 - i]) * (x[i] + x[len(x) + 1 - i]))")
_each("activation_tanh", v.each_tanh, "list_transform(x, lambda a: (exp(2 * a) - 1) / (exp(2 * a) + 1))")
_each("activation_sigmoid", v.each_sigmoid, "list_transform(x, lambda a: 1 / (1 + exp(-a)))")
_each("activation_squared_relu", v.squared_relu, "list_transform(x, lambda a: greatest(a, 0) * greatest(a, 0))")
_each("logit_squash_roundtrip", lambda x: F.transform(v.each_sigmoid(x), lambda p: v.squash(v.logit(p))), "list_transform(x, lambda a: greatest(1e-4, least(0.9999, 1 / (1 + exp(-a)))))")
_each("logit_bins", lambda x: F.transform(x, lambda a: v.logit_bin(a * 8)), "list_transform(x, lambda a: CASE WHEN a * 8 < -1 THEN 0 WHEN a * 8 < 0 THEN 1 WHEN a * 8 < 1 THEN 2 ELSE 3 END)")
_each("bit_costs_of_probabilities", lambda x: F.transform(v.each_sigmoid(x), lambda p: v.bit_cost(p)), "list_transform(x, lambda a: -log2(greatest(1 / (1 + exp(-a)), 1e-15)))")

# Scales first, then integers: an expression inside a lambda would be worked out for every element.
_Q = """, m AS (SELECT *, list_max(list_transform(x, lambda a: abs(a))) AS m FROM {0}), s AS (SELECT *, CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END AS s8, CASE WHEN m > 0 THEN m / 7 ELSE 1.0 END AS s4 FROM m),
    q AS (SELECT *, list_transform(x, lambda a: CAST(greatest(-127, least(127, round(a / s8))) AS BIGINT)) AS q8, list_transform(x, lambda a: CAST(greatest(-8, least(7, round(a / s4))) AS BIGINT)) AS q4 FROM s)"""


def _each_q(name: str, f: Callable[[Column], Column], sql: str) -> None:
    _each(name, f, sql)
    SQL[name] = _digest_sql(sql, _Q.format("e")).replace("AS y FROM e)", "AS y FROM q)")


_each_q("q8_quantize", v.q8, "q8")
_each_q("q8_dequantize", lambda x: v.dequantize(v.q8(x), v.scale_of(x, v.Q8_STEPS)), "list_transform(q8, lambda a: a * s8)")
_each_q("q4_quantize", lambda x: v.q4_pack(v.q4(x)), "list_transform(range(0, 32), lambda i: ((q4[2 * i + 1] + 16) % 16) + ((q4[2 * i + 2] + 16) % 16) * 16)")
_each_q("q4_roundtrip", lambda x: v.dequantize(v.q4_unpack(v.q4_pack(v.q4(x))), v.scale_of(x, v.Q4_STEPS)), "list_transform(q4, lambda a: a * s4)")
_CDF = f"list_transform(x, lambda a: CAST(floor(a / z * ({v.CDF_TOTAL} - len(x))) AS BIGINT))"


@query(f"WITH {E}{_STAGED}, p AS (SELECT vec_id, list_transform(x, lambda a: a / z) AS p FROM z) SELECT vec_id, round(-list_sum(list_transform(p, lambda a: a * ln(a))), 6) AS entropy FROM p")
def entropy_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v.softmax(v.doubles("embedding")).alias("p"))
    return rows.select("vec_id", F.round(v.entropy_nats(F.col("p")), 6).alias("entropy"))


@query(f"WITH {E}, d AS (SELECT vec_id, unnest(x) AS y, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim FROM e), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, dim) AS INTEGER) AS rank FROM d) SELECT vec_id, rank, dim, round(y, 6) AS y FROM r WHERE rank <= 10")
def top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest elements of each vector, the lower index first on ties: sorted within the row, without a shuffle."""
    x = v.doubles("embedding")
    order = F.slice(F.array_sort(F.transform(x, lambda a, i: F.struct((-a).alias("minus"), i.alias("dim")))), 1, 10)
    each = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(order).alias("i", "s"))
    return each.select("vec_id", (F.col("i") + 1).alias("rank"), F.col("s.dim").alias("dim"), F.round(-F.col("s.minus"), 6).alias("y"))


@query(f"WITH {E} SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS first_max, CAST(len(x) - list_position(list_reverse(x), list_max(x)) AS INTEGER) AS last_max, round(list_max(x), 6) AS most FROM e")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v.doubles("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", v.argmax(x).alias("first_max"), v.argmax_last(x).alias("last_max"), F.round(F.array_max(x), 6).alias("most"))


_N = f"WITH {E}, n AS (SELECT label, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM e)"


@query(f"{_N}, s AS (SELECT label, list_sort(list(n)) AS s FROM n GROUP BY label) SELECT label, CAST(len(s) AS BIGINT) AS n, round(list_avg(s), 6) AS mean_norm, round(s[len(s) // 2 + 1], 6) AS median_norm, round(s[1], 6) AS min_norm, round(s[-1], 6) AS max_norm FROM s")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vs.norm_stats(read(spark, sf_dir, "embeddings"), "embedding", "label")
    return found.select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean_norm", "median_norm", "min_norm", "max_norm")))


_C = f"WITH {E}, d AS (SELECT label, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM e), c AS (SELECT label, i, avg(y) AS m FROM d GROUP BY ALL), g AS (SELECT i, avg(y) AS m FROM d GROUP BY i)"


@query(f"{_C} SELECT label, round(sum(m * i), 5) AS digest FROM c GROUP BY label")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.centroids(read(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.round(v.weighted_sum(F.col("centroid")), 5).alias("digest"))


@query(f"{_C}, r AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT d.label, round(sum((y - m) * (y - m)) / any_value(n), 6) AS dispersion FROM d JOIN c USING (label, i) JOIN r ON r.label = d.label GROUP BY d.label")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.dispersion(read(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.round("dispersion", 6).alias("dispersion"))


@query(f"{_C} SELECT label, round(sqrt(sum((c.m - g.m) * (c.m - g.m))), 6) AS distance FROM c JOIN g USING (i) GROUP BY label")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    both = vs.with_row(vs.centroids(rows, "embedding", "label").withColumnRenamed("centroid", "c"), vs.centroids(rows, "embedding"))
    return both.select("label", F.round(v.norm(v.sub(F.col("c"), F.col("centroid"))), 6).alias("distance"))


@query(f"WITH {E}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM e) SELECT round(avg(n) FILTER (vec_id BETWEEN 32 AND 126), 6) AS printable_mean, round(avg(n) FILTER (vec_id BETWEEN 128 AND 255), 6) AS high_mean, round(avg(n) FILTER (vec_id < 256) / avg(n) FILTER (vec_id >= 256), 6) AS ratio FROM n")
def band_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = read(spark, sf_dir, "embeddings").select("vec_id", v.norm(v.doubles("embedding")).alias("n"))
    mean = lambda cond: F.avg(F.when(cond, F.col("n")))
    i = F.col("vec_id")
    return norms.agg(F.round(mean(i.between(32, 126)), 6).alias("printable_mean"), F.round(mean(i.between(128, 255)), 6).alias("high_mean"), F.round(mean(i < 256) / mean(i >= 256), 6).alias("ratio"))


def _surgery(method: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = vs.surgery(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", method)
        return out.select(F.col("id").alias("vec_id"), F.round(v.weighted_sum(F.col("vector")), 4).alias("digest"))

    QUERIES[f"surgery_{method}"], SQL[f"surgery_{method}"] = run, sql


_X = f"WITH {E}, d AS (SELECT vec_id, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM e)"
_surgery("center", f"{_X}, g AS (SELECT i, avg(y) AS m FROM d GROUP BY i) SELECT vec_id, round(sum(i * CASE WHEN vec_id < 256 THEN 0.7 * y + 0.3 * m ELSE y END), 4) AS digest FROM d JOIN g USING (i) GROUP BY vec_id")
_surgery("spread", f"{_X}, g AS (SELECT i, avg(y) AS m FROM d WHERE vec_id < 256 GROUP BY i) SELECT vec_id, round(sum(i * CASE WHEN vec_id < 256 THEN m + 1.5 * (y - m) ELSE y END), 4) AS digest FROM d JOIN g USING (i) GROUP BY vec_id")
_surgery("norm", f"{_X}, n AS (SELECT vec_id, sqrt(sum(y * y)) AS n FROM d GROUP BY vec_id), s AS (SELECT list_sort(list(n)) AS s FROM n WHERE vec_id >= 256) SELECT vec_id, round(sum(i * CASE WHEN vec_id < 256 AND n > 1e-8 THEN y * (s[len(s) // 2 + 1] / n) ELSE y END), 4) AS digest FROM d JOIN n USING (vec_id), s GROUP BY vec_id")


def _first(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings")
    return rows, vs.test_vector(rows, "vec_id", "embedding", 64)


_W = f"WITH {E}, p AS (SELECT list(x[vec_id + 1] ORDER BY vec_id) AS w FROM e WHERE vec_id < 64), w AS (SELECT list_transform(w, lambda a: a / greatest(list_max(list_transform(w, lambda b: abs(b))), 1e-8)) AS w FROM p)"
_DOT = "list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * w[i]))"


@query(f"{_W} SELECT vec_id, round({_DOT}, 6) AS y FROM e, w")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.matvec(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first(spark, sf_dir)[1]).select(F.col("id").alias("vec_id"), F.round("y", 6).alias("y"))


@query(f"{_X} SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(sum(a.y * b.y), 5) AS y FROM d a JOIN d b USING (vec_id) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.gram(read(spark, sf_dir, "embeddings"), "embedding").withColumn("y", F.round("y", 5))


@query(f"{_X} SELECT CAST(i - 1 AS INTEGER) AS dim, count(*) AS n, round(sum(y * (vec_id % 101 + 1)), 5) AS digest FROM d GROUP BY i")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v.doubles("embedding")).alias("dim", "y"))
    return each.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * (F.col("vec_id") % 101 + 1)), 5).alias("digest"))


_P = f"""{_W}, u AS (SELECT vec_id, x FROM e UNION ALL SELECT -1, w FROM w){_Q.format("u")}, o AS (SELECT q8 AS w8, s8 AS sw FROM q WHERE vec_id = -1),
    p2 AS (SELECT vec_id, {_DOT} AS exact, CAST(list_sum(list_transform(range(1, 65), lambda i: q8[i] * w8[i])) AS DOUBLE) * (s8 * sw) AS q8, CAST(list_sum(list_transform(range(1, 65), lambda i: q4[i] * w8[i])) AS DOUBLE) * (s4 * sw) AS q4 FROM q, o, w WHERE vec_id >= 0)"""


@query(f"{_P} SELECT vec_id, round(exact, 6) AS exact, round(q8, 6) AS q8, round(q4, 6) AS q4 FROM p2")
def quantized_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, one = _first(spark, sf_dir)
    return vs.quantized_products(rows, "vec_id", "embedding", one).select(F.col("id").alias("vec_id"), *(F.round(c, 6).alias(c) for c in ("exact", "q8", "q4")))


@query(f"{_P}, z AS (SELECT 'q8' AS level, abs(exact - q8) AS e, greatest(abs(exact), 1e-8) AS d FROM p2 UNION ALL SELECT 'q4', abs(exact - q4), greatest(abs(exact), 1e-8) FROM p2), g AS (SELECT level, max(e) AS m, avg(e / d) AS r FROM z GROUP BY level) SELECT level, round(m, 6) AS max_abs, round(r, 6) AS mean_rel, m < 0.5 AND r < 0.05 AS passes FROM g")
def quantization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, one = _first(spark, sf_dir)
    found = vs.quality(vs.quantized_products(rows, "vec_id", "embedding", one))
    return found.select("level", F.round("max_abs", 6).alias("max_abs"), F.round("mean_rel", 6).alias("mean_rel"), "passes")


@query(f"SELECT coalesce(max_by(level, CASE level WHEN 'q8' THEN sqrt(256 / 68.0) ELSE sqrt(256 / 36.0) END) FILTER (passes), 'f32') AS best FROM ({SQL['quantization_quality']})")
def best_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of storage for the vectors: the smallest that is good enough."""
    rows, one = _first(spark, sf_dir)
    return vs.best_level(vs.quality(vs.quantized_products(rows, "vec_id", "embedding", one)), 64)


@query("SELECT level, label, count(*) AS n, CAST(count(*) * CASE level WHEN 'f32' THEN 256 WHEN 'q8' THEN 68 ELSE 36 END AS BIGINT) AS bytes, CAST(count(*) * (256 - CASE level WHEN 'f32' THEN 256 WHEN 'q8' THEN 68 ELSE 36 END) AS BIGINT) AS saved FROM embeddings, (SELECT unnest(['f32', 'q8', 'q4']) AS level) GROUP BY level, label")
def quantized_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    sizes = F.array(*(F.struct(F.lit(level).alias("level"), vs.storage_bytes(F.col("n"), 64, level).cast("long").alias("bytes")) for level in ("f32", "q8", "q4")))
    return counts.select("label", "n", F.explode(sizes).alias("s")).select("s.level", "label", "n", "s.bytes", (F.col("n") * 256 - F.col("s.bytes")).cast("long").alias("saved"))


@query(
    f"""WITH {E}{_STAGED}, x AS (SELECT vec_id, {_CDF} AS extra FROM z), d AS (SELECT vec_id, unnest(extra) AS f, generate_subscripts(extra, 1) AS i FROM x),
    k AS (SELECT vec_id, {v.CDF_TOTAL} - count(*) - sum(f) AS rest, max_by(i, f * 1000 + i) AS top FROM d GROUP BY vec_id),
    a AS (SELECT d.vec_id, i, f + 1 + CASE WHEN i = top THEN rest ELSE 0 END AS f FROM d JOIN k USING (vec_id)), c AS (SELECT vec_id, i, sum(f) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM a)
    SELECT vec_id, CAST(max(c) AS BIGINT) AS total, CAST(sum(c * i) AS BIGINT) AS digest, CAST(count(*) FILTER (c <= 8388608) AS INTEGER) AS middle FROM c GROUP BY vec_id"""
)
def cdf_from_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative frequencies of each vector's softmax; middle is the symbol at half of the total."""
    tables = read(spark, sf_dir, "embeddings").select("vec_id", v.cdf(v.softmax(v.doubles("embedding"))).alias("c"))
    return tables.select("vec_id", F.element_at("c", -1).alias("total"), F.aggregate(F.transform("c", lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x).alias("digest"), v.cdf_symbol(F.col("c"), F.lit(1 << 23)).alias("middle"))


@query(f"SELECT label, n, CAST({v.CDF_TOTAL} // n * n AS BIGINT) AS total, CAST({v.CDF_TOTAL} // n AS BIGINT) AS each FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def uniform_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    made = counts.select("label", "n", v.uniform_cdf(F.col("n").cast("int")).alias("c"))
    return made.select("label", "n", F.element_at("c", -1).alias("total"), F.element_at("c", 2).alias("each"))
