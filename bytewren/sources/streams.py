"""Byte streams: each row of a text or binary table is one ordered stream of bytes.

Bytes are reached through Latin-1, in which every byte is one character. So
splitting, slicing and exploding stay in built-in expressions, need no shuffle,
and cost the same for every position of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Arrow batches handed to Python stay within these bounds, whatever the text length; bytes that a worker pools.
BATCH_ROWS, BATCH_BYTES, POOL = 2000, 16 << 20, 4 << 20
#: Ids that occur twice or more are sent to all executors up to this number.
FEW = 100_000


def latin(content: Column | str) -> Column:
    """A string with one character for each byte of a text (as UTF-8) or binary column."""
    column = F.col(content) if isinstance(content, str) else content
    return F.decode(column.cast("binary"), "ISO-8859-1")


def byte_count(content: str) -> Column:
    return F.octet_length(F.col(content).cast("binary")).cast("long")


def streams(df: DataFrame, id_col: str, content_col: str, limit: int = 0, *keep: str) -> DataFrame:
    """(stream_id, *keep, chars): the first ``limit`` bytes (0: all) as an array of one-byte strings. Null content is an empty stream.

    The prefix is cut before anything is exploded, as a filter on positions would not be pushed there.
    """
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    if limit:
        content = F.substring(content, 1, limit)
    chars = F.filter(F.split(latin(content), ""), lambda c: c != "")
    return df.select(F.col(id_col).alias("stream_id"), *keep, chars.alias("chars"))


def explode_bytes(df: DataFrame, id_col: str, content_col: str, limit: int = 0, *keep: str) -> DataFrame:
    """(stream_id, *keep, pos, b): a row for each byte. An empty stream has no rows."""
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    if limit:
        content = F.substring(content, 1, limit)
    each = df.select(F.col(id_col).alias("stream_id"), *keep, F.posexplode(F.split(latin(content), "")).alias("pos", "ch"))
    return each.where("ch <> ''").select("stream_id", *keep, "pos", F.ascii("ch").alias("b"))


def with_lags(df: DataFrame, *lags: int) -> DataFrame:
    """(stream_id, pos, b, lag1, ...): every byte with the bytes so many places before it (null before the start), from streams()."""
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), n), F.slice("chars", 1, F.greatest(F.size("chars") - n, F.lit(0)))).alias(f"c{n}") for n in lags]
    names = [f"c{n}" for n in lags]
    zipped = df.select("stream_id", "chars", *shifted)
    # Where a stream is shorter than a lag its shifted copy is too long; the surplus has no byte of its own.
    each = zipped.select("stream_id", F.posexplode(F.arrays_zip("chars", *names)).alias("pos", "z")).where("z.chars is not null")
    return each.select("stream_id", "pos", F.ascii("z.chars").alias("b"), *(F.ascii(f"z.{n}").alias(f"lag{n[1:]}") for n in names))


def with_lag_chars(df: DataFrame, *lags: int) -> DataFrame:
    """(stream_id, pos, ch, c1, ...): as with_lags, bytes as one-character strings, which make short keys."""
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), n), F.slice("chars", 1, F.greatest(F.size("chars") - n, F.lit(0)))).alias(f"c{n}") for n in lags]
    names = [f"c{n}" for n in lags]
    each = df.select("stream_id", "chars", *shifted).select("stream_id", F.posexplode(F.arrays_zip("chars", *names)).alias("pos", "z")).where("z.chars is not null")
    return each.select("stream_id", "pos", F.col("z.chars").alias("ch"), *(F.col(f"z.{n}").alias(n) for n in names))


def grams(df: DataFrame, order: int) -> DataFrame:
    """(stream_id, pos, ctx, nxt): the ``order`` bytes before each byte as an exact key, and the byte; from streams(), warm-up left out."""
    n = F.greatest(F.size("chars") - order, F.lit(0))
    parts = [F.slice("chars", i + 1, n).alias(f"g{i}") for i in range(order + 1)]
    zipped = df.select("stream_id", F.arrays_zip(*parts).alias("z"))
    each = zipped.select("stream_id", F.posexplode("z").alias("i", "g"))
    ctx = F.concat(*(F.col(f"g.g{i}") for i in range(order))) if order else F.lit("")
    return each.select("stream_id", (F.col("i") + order).alias("pos"), ctx.alias("ctx"), F.col(f"g.g{order}").alias("nxt"))


def binary_files(spark: SparkSession, path: str, limit: int = 0, glob: str | None = None) -> DataFrame:
    """(path, content, n_bytes): whole files as streams, each cut to its first ``limit`` bytes (0: all)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    content = F.substring(F.col("content"), 1, limit) if limit else F.col("content")
    return reader.load(path).select("path", content.alias("content"), F.least("length", F.lit(limit)).alias("n_bytes") if limit else F.col("length").alias("n_bytes"))


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory when contents are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pooled(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Frames put together until they hold POOL bytes of content, so that streams of like length meet."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += sum(map(len, frame[column]))
        if size >= POOL:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def gathered(df: DataFrame, id_col: str, content_col: str, limit: int = 0) -> DataFrame:
    """(stream_id, parts): a row for each id with the contents of its rows, cut to ``limit`` bytes (0: all).

    Ids are counted first, which reads no contents. Only rows whose id occurs again are moved.
    """
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(id_col).alias("stream_id"), (F.substring(content, 1, limit) if limit else content).alias("content"))
    again = rows.groupBy("stream_id").count().where("count > 1").select(F.col("stream_id").alias("_again"))
    n = again.count()
    if not n:
        return rows.select("stream_id", F.array("content").alias("parts"))
    again = F.broadcast(again) if n <= FEW else again
    same = rows["stream_id"].eqNullSafe(again["_again"])
    once = rows.join(again, same, "left_anti").select("stream_id", F.array("content").alias("parts"))
    return once.union(rows.join(again, same, "left_semi").groupBy("stream_id").agg(F.collect_list("content").alias("parts")))


def per_stream(df: DataFrame, id_col: str, content_col: str, schema: str, rows: Callable[[list[bytes]], list[tuple]], limit: int = 0) -> DataFrame:
    """(stream_id, *schema): the rows that a function makes of the contents of each id, where the contents lie."""
    parts = gathered(df, id_col, content_col, limit)
    bounded(df.sparkSession)
    made = StructType.fromDDL(schema)
    names = made.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, contents in enumerate(batch.column(1)):
                found = rows([c.as_py() for c in contents.values])
                at += [i] * len(found)
                out += found
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], ["stream_id", *names])

    types = [to_arrow_type(f.dataType) for f in made]
    return parts.mapInArrow(run, StructType([StructField("stream_id", parts.schema["stream_id"].dataType), *made]))


#: Bytes of streams that are counted together.
COUNTED = 8 << 20


def counted(df: DataFrame, content_col: str, keys: Callable[[np.ndarray, np.ndarray, int], Iterator[tuple[int, np.ndarray]]], group: str | None = None) -> DataFrame:
    """(group, kind, key, n): how often each key occurs, summed over COUNTED bytes at a time in the worker; to be summed further.

    keys: from the bytes of streams one after the other and the place of each in its stream, (kind, keys of 64 bits) of the positions that have one.
    A stream's positions before the present one lie right before it.
    """
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(*([group] if group else [F.lit(0).alias("_g")]), content.alias("content"))
    name, kept = rows.columns[0], rows.schema[0]
    bounded(df.sparkSession)
    kind = to_arrow_type(kept.dataType)

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        for value, streams_ in held.items():
            b = np.frombuffer(b"".join(streams_), np.uint8)
            sizes = np.array([len(x) for x in streams_])
            pos = np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for what, key in keys(b, pos, len(streams_)):
                found, n = np.unique(key, return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([value], kind).take(pa.array(np.zeros(len(found), np.int64))), pa.array(np.full(len(found), what, np.int32)), pa.array(found, pa.int64()), pa.array(n, pa.int64())], [name, "kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(value, []).append(data.as_py())
                size += len(held[value][-1])
                if size >= COUNTED:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    return rows.mapInArrow(run, StructType([kept, *StructType.fromDDL("kind int, key long, n long")]))
