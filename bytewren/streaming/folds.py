"""Folds as Structured Streaming: a stream's parts arrive in order, its predictor waits in the state store between them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewren.operators.predictors import stream_totals
from bytewren.sources.streams import bounded, pooled


def read_stream(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    """A table's files as a stream, with the schema of a batch read of it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(like.schema)
    first = like.inputFiles()[0]
    return reader.parquet(path) if first.rstrip("/").rpartition("/")[2] != name else reader.option("pathGlobFilter", name).parquet(folder)


def fold_costs(parts: DataFrame, key: str, order: str, content: str, limit: int = 2**31 - 1) -> DataFrame:
    """(stream_id, n_bytes, bits) for each part of a stream as it comes, under a context mixer that knows all parts before.

    What the mixer has learnt follows from the bytes, and takes a thousand times their size. So the state store keeps
    the bytes, and the mixer goes through them again before it comes to the new ones.
    """
    cut = parts.select(F.col(key).alias("stream_id"), F.col(order).alias("ordering"), F.substring(F.col(content).cast("binary"), 1, limit).alias("content"))
    bounded(parts.sparkSession)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = bytes(state.get[0]) if state.exists else b""
        come = pd.concat([f for f in frames if len(f)]).sort_values("ordering")
        after = before + b"".join(bytes(x) for x in come["content"] if x)
        state.update((after,))
        yield pd.DataFrame({"stream_id": [key[0]], "since": [len(before)], "content": [after]})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pooled(frames, "content"):
            ids, since, data = frame["stream_id"].tolist(), frame["since"].tolist(), [bytes(x) for x in frame["content"]]
            rows = [(ids[i], len(data[i]) - since[i], float(bits.sum())) for i, bits, _, _ in stream_totals(data, since)]
            yield pd.DataFrame(rows, columns=["stream_id", "n_bytes", "bits"])

    read = cut.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, since long, content binary", "seen binary", "update", "NoTimeout")
    return read.mapInPandas(fold, "stream_id long, n_bytes long, bits double")


def event_windows(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, key, n, total) by event-time windows with a watermark. The reference has none: its windows are counts of bytes."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that is available now, through the stream, into Parquet; read again as a batch. State and offsets go to ``folder`` too."""
    place = f"{folder.rstrip('/')}/bytewren-stream-{uuid.uuid4().hex}"
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")
