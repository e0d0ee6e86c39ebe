"""Folds, coding, tensors, vocabularies, backbones and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewren.functions import hashes
from bytewren.functions import vectors as v
from bytewren.operators import backbone, coder, hybrid, predictors
from bytewren.operators import telemetry as tm
from bytewren.plans.registry import BYTES, query, read
from bytewren.sources import telemetry, tensors, vocabulary
from bytewren.streaming import folds


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations as streams, dealt evenly: a file may be a single partition."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as streams: the table of the learners that run at about a KB a second."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def _fold(rows: DataFrame, **options) -> DataFrame:
    found = predictors.fold_streams(rows, "id", "text", **options)
    return found.select("stream_id", "n_bytes", F.round("bits", 3).alias("bits"), F.transform("bit_costs", lambda x: F.round(x, 3)).alias("bit_costs"), "match_hits", "match_len")


@query(
    f"""WITH {BYTES}, t AS (SELECT stream_id, list(b >> 7 ORDER BY pos) AS bits FROM b GROUP BY stream_id),
    s AS (SELECT stream_id, list_reduce(list_prepend(CAST(0 AS BIGINT), bits), lambda a, x: ((a // 65536) * 9 // 10 + 16 * (1 - x)) * 65536 + ((a % 65536) * 9 // 10 + 16 * x)) AS c FROM t)
    SELECT stream_id, CAST(c // 65536 AS BIGINT) AS n0, CAST(c % 65536 AS BIGINT) AS n1, round((c % 65536 + 8) / (c // 65536 + c % 65536 + 16), 6) AS p FROM s"""
)
def decayed_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the top bit over a stream, decayed by a tenth before each addition: an ordered fold inside the row."""
    chars = F.split(F.decode(F.col("text").cast("binary"), "ISO-8859-1"), "")
    down = lambda n: F.floor(n * predictors.DECAY_NUM / predictors.DECAY_DEN)
    start = F.struct(F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"))
    step = lambda a, c: F.struct((down(a["n0"]) + F.when(F.ascii(c) < 128, 16).otherwise(0)).cast("long").alias("n0"), (down(a["n1"]) + F.when(F.ascii(c) >= 128, 16).otherwise(0)).cast("long").alias("n1"))
    made = read(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("stream_id"), F.aggregate(chars, start, step).alias("c"))
    return made.select("stream_id", "c.n0", "c.n1", F.round((F.col("c.n1") + 8) / (F.col("c.n0") + F.col("c.n1") + 16), 6).alias("p"))


@query()
def cm_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(_talk(spark, sf_dir))


@query()
def cm_eval_order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(_talk(spark, sf_dir), chain=True)


@query()
def cm_eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(_talk(spark, sf_dir), match=True)


@query()
def cm_eval_lstm_mixer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(_passages(spark, sf_dir), mixer="lstm")


def _hybrid(spark: SparkSession, sf_dir: str, rows: DataFrame, **options) -> DataFrame:
    """Under a backbone whose seeded weights come from a tensor file, read as any others would be."""
    tokens = _words(spark, sf_dir, 256)
    config = backbone.Config(vocabulary=max(tokens.values()) + 1)
    file = spark.createDataFrame([(tensors.pack({n: ("F32", x) for n, x in backbone.random_weights(config).items()}),)], "file binary")
    read_back = tensors.read_tensors(file, "file").collect()  # a model's tensors
    weights = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in read_back}
    found = hybrid.hybrid_fold(rows, "id", "text", tokens, config, weights, **options)
    return found.select("stream_id", "n_bytes", "n_tokens", F.round("bits", 3).alias("bits"), F.transform("bit_costs", lambda x: F.round(x, 3)).alias("bit_costs"), "match_hits", "match_len", "skipped_tokens", "skipped_bytes")


@query()
def hybrid_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbone blended with a byte expert, match model and context models under the hierarchical mixer."""
    return _hybrid(spark, sf_dir, _passages(spark, sf_dir), mixer="hierarchical", match=True, expert=True, blend=0.005)


@query()
def hybrid_eval_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_eval over the conversations under the logistic mixer, with tokens of 2 % or more skipped."""
    return _hybrid(spark, sf_dir, _talk(spark, sf_dir), mixer="logistic", match=True, skip=0.02)


@query()
def token_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as tokens under n-grams and the bias head with adaptive weights, surprise-scaled rate and confidence skip."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, data in zip(frame["stream_id"], frame["content"]):
                made = list(predictors.token_costs(data, 256, skip=0.95, tau=100.0))
                rows.append((i, len(made), round(sum(b for _, b, _ in made), 3), sum(s for *_, s in made)))
            yield pd.DataFrame(rows, columns=["stream_id", "n_tokens", "bits", "skipped"])

    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return _talk(spark, sf_dir).select(F.col("id").alias("stream_id"), content.alias("content")).mapInPandas(run, "stream_id long, n_tokens long, bits double, skipped long")


@query("SELECT conv_id * 1000 + turn AS stream_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS lossless FROM conversations")
def range_code_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coder.code_streams(_talk(spark, sf_dir), "id", "text").select("stream_id", "n_bytes", "lossless")


@query("SELECT conv_id * 1000 + turn AS stream_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(octet_length(encode(text)) AS BIGINT) AS n_symbols FROM conversations")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container's header read with built-in expressions."""
    made = coder.code_streams(_talk(spark, sf_dir), "id", "text")
    ours = made.where(F.expr("substring(coded, 1, 8)") == F.lit(coder.MAGIC.decode()).cast("binary"))
    return ours.select("stream_id", hashes.little_endian("coded", 9, 4).alias("n_bytes"), hashes.little_endian("coded", 13, 4).alias("n_symbols"))


def _words(spark: SparkSession, sf_dir: str, most: int) -> dict[bytes, int]:
    """Single bytes, then the ``most`` commonest words of the passages with a blank before them, by count and word."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    common = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()
    return {bytes([b]): b for b in range(256)} | {b" " + r["w"].encode(): 256 + i for i, r in enumerate(common)}


@query("SELECT item_id AS stream_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS lossless FROM benchmark")
def token_code_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages coded token by token under n-grams and the bias head, and decoded again."""
    return coder.code_tokens(_passages(spark, sf_dir), "id", "text", _words(spark, sf_dir, 256)).select("stream_id", "n_bytes", "lossless")


@query()
def call_transform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-address transform of the embeddings' raw bytes, in which call bytes occur, with a check that it can be undone."""

    @F.pandas_udf("binary")
    def raw(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: np.asarray(x, "<f4").tobytes())

    return coder.call_stats(read(spark, sf_dir, "embeddings").select("vec_id", raw("embedding").alias("raw")), "vec_id", "raw")


@query("WITH q AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 32) / 32) AS x FROM embeddings) SELECT vec_id, name, CAST(n AS INTEGER) AS width, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * i)), 5) AS digest FROM q, (SELECT unnest(['F32', 'F16', 'BF16']) AS name)")
def tensor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, in steps of 1/32 that all three types hold, as a tensor file of three types, read again."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: tensors.pack({d: (d, np.floor(np.asarray(x, np.float64) * 32).astype(np.float32) / 32) for d in ("F32", "F16", "BF16")}))

    files = read(spark, sf_dir, "embeddings").select("vec_id", pack("embedding").alias("file"))
    found = tensors.read_tensors(files, "file", "vec_id")
    return found.select("vec_id", "name", F.size("data").alias("width"), F.round(v.weighted_sum(v.doubles("data")), 5).alias("digest"))


@query("WITH w AS (SELECT unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM conversations) SELECT w AS token, CAST(octet_length(encode(w)) AS INTEGER) AS n_bytes FROM w GROUP BY w")
def vocabulary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' words written as vocabulary lines and parsed again."""
    words = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").distinct()

    @F.pandas_udf("string")
    def line(texts: pd.Series) -> pd.Series:
        return texts.map(lambda w: f"1 {w.encode()!r} {len(w.encode())}")

    parsed = vocabulary.parse(words.select(line("w").alias("value")))
    return parsed.select(F.decode("bytes", "UTF-8").alias("token"), F.octet_length("bytes").alias("n_bytes"))


@query("WITH w AS (SELECT unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM conversations) SELECT count(DISTINCT w) AS tokens, CAST(max(octet_length(encode(w))) AS INTEGER) AS longest, CAST(sum(octet_length(encode(w))) AS BIGINT) AS bytes FROM (SELECT DISTINCT w FROM w)")
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the vocabulary of the conversations' words, its longest one, and the bytes of all."""
    return vocabulary_lines(spark, sf_dir).agg(F.count("*").alias("tokens"), F.max("n_bytes").alias("longest"), F.sum("n_bytes").alias("bytes"))


@query()
def greedy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by greedy longest match over single bytes and the 2,000 commonest words."""
    talk = read(spark, sf_dir, "conversations")
    common = talk.select(F.explode(F.split("text", " ")).alias("w")).where("w <> '' and octet_length(w) > 1").groupBy("w").count().orderBy(F.desc("count"), "w").limit(2000)
    numbered = common.agg(F.collect_list("w").alias("ws")).select(F.posexplode("ws").alias("i", "w")).select((F.col("i") + 256).alias("token_id"), F.col("w").cast("binary").alias("bytes"))  # 2,000 rows
    single = spark.range(256).select(F.col("id").cast("int").alias("token_id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("bytes"))
    found = vocabulary.tokenize(talk.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text", single.union(numbered))
    return found.select("stream_id", F.size("tokens").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t).alias("token_sum"))


@query()
def backbone_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrent backbone with random weights over whole passages; shows that the kernels run, not a trained model's costs."""
    return backbone.backbone_costs(_passages(spark, sf_dir), "id", "text").withColumn("bits", F.round("bits", 3))


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, else one in the warehouse, which a cluster shares."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bytewren_stream"


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows in complete mode, so that the last window is there too."""
    stream = folds.read_stream(spark, read(spark, sf_dir, "events"), f"{sf_dir}/events.parquet")
    out = folds.run_once(folds.event_windows(stream, "ts", "event_type", "value"), "complete", _folder(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def streaming_cm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context mixer for each conversation, kept in the state store between its turns."""
    stream = folds.read_stream(spark, read(spark, sf_dir, "conversations"), f"{sf_dir}/conversations.parquet")
    out = folds.run_once(folds.fold_costs(stream, "conv_id", "turn", "text"), "update", _folder(spark))
    return out.select("stream_id", "n_bytes", F.round("bits", 3).alias("bits"))


@query(
    f"""WITH {BYTES}, l AS (SELECT stream_id, list(b ORDER BY pos) AS bs FROM b GROUP BY stream_id)
    SELECT doc_id AS stream_id, lpad(lower(hex(CAST(CASE WHEN bs IS NULL THEN CAST('14695981039346656037' AS UHUGEINT)
      ELSE list_reduce(list_prepend(CAST('14695981039346656037' AS UHUGEINT), list_transform(bs, lambda x: CAST(x AS UHUGEINT))), lambda h, x: (xor(h, x) * CAST(1099511628211 AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) END AS UBIGINT))), 16, '0') AS fnv
    FROM documents LEFT JOIN l ON stream_id = doc_id"""
)
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a of whole texts: wrapping multiplication, which SQL's checked arithmetic hasn't."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), hashes.fnv1a_hex(text).alias("fnv"))


def _fold_sql(start: str, factor: str) -> str:
    big = lambda x: f"CAST('{x}' AS UHUGEINT)"
    folded = f"list_reduce(list_prepend({big(start)}, list_transform(bs, lambda x: CAST(x AS UHUGEINT))), lambda h, x: (xor(h, x) * {big(factor)}) % {big('18446744073709551616')})"
    return f"lpad(lower(hex(CAST(CASE WHEN bs IS NULL OR len(bs) = 0 THEN {big(start)} ELSE {folded} END AS UBIGINT))), 16, '0')"


@query(f"WITH l AS (SELECT page_id, list_transform(regexp_extract_all(hex(encode(html)), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS bs FROM pages) SELECT page_id, {_fold_sql('14695981039346656037', '1099511628211')} || {_fold_sql('1099511628211', '14695981039346656037')} AS fingerprint FROM l")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", hashes.fingerprint_hex(F.col("html").cast("binary")).alias("fingerprint"))


@query("SELECT doc_id, text AS shown, CAST(octet_length(encode(text)) AS INTEGER) AS n FROM documents")
def lossy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashes.lossy_text(F.col("text").cast("binary")).alias("shown"), F.octet_length("text").alias("n"))


@query()
def telemetry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-mixing costs of the turns as log records, one for each turn, cumulative in the order of ids.

    The costs are written first, as they are read twice: for sums by range of ids and for the records inside a range.
    """
    made = predictors.fold_streams(_talk(spark, sf_dir), "id", "text", match=True)
    place = f"{_folder(spark).rstrip('/')}/bytewren-records-{uuid.uuid4().hex}"
    made.write.parquet(place)
    made = spark.read.schema(made.schema).parquet(place)
    total = tm.cumulative(made, "stream_id", n_bytes="bytes", bits="all_bits")
    windows = total.select("bytes", (F.col("all_bits") / F.col("bytes")).alias("bpb"), (F.col("bits") / F.col("n_bytes")).alias("bpb_w"), F.transform("bit_costs", lambda c: c / F.col("n_bytes")).alias("bit_costs"), "match_hits", (F.col("match_len") / F.greatest("match_hits", F.lit(1))).alias("match_avg_len"))
    return telemetry.hybrid_records(windows, F.lit(1.0))
