"""Telemetry records and run snapshots: schemas, JSON lines, and a file of tagged sections."""

from __future__ import annotations

import json
import pickle
import struct
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from bytewren.operators.predictors import ContextMixer, MatchModel

#: Records of the two kinds of run, and of a run as a whole (fixed formats).
HYBRID = "ts string, sec double, bytes long, bpb double, bpb_w double, bps long, bit_costs array<double>, match_hits long, match_avg_len double"
BASELINE = "ts string, sec double, bytes long, tokens long, bpb double, bpb_w double, bps long, w_ng double, w_b double, lr double, surp double"
RUN = (
    "input_path string, input_sha256 string, input_size_total long, bytes_evaluated long, bpb_final double, per_bit_costs array<double>, "
    "throughput_bps double, elapsed_secs double, token_count long, bytes_per_token double, model_name string, weights_path string, mixer_type string, "
    "mixer_params long, emb_surgery string, e8e9_enabled boolean, cm_model_count int, cm_memory_mb double, match_memory_mb double, lstm_adam_t long, "
    "match_total_bytes long, domain_cluster string, timestamp string"
)

MAGIC, VERSION, END = b"BWRNSNAP", 1, 0xFF
SECTION = struct.Struct("<BQ")


def read_log(spark: SparkSession, path: str, schema: str = HYBRID) -> DataFrame:
    """JSON lines under a fixed schema, so that nothing is inferred; the file is kept as a column."""
    return spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))


def write_log(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)


def hybrid_records(windows: DataFrame, seconds: Column) -> DataFrame:
    """Records in the log's order and with its digits from a table of windows (bytes, bpb, bpb_w, bit_costs, match_hits, match_avg_len)."""
    return windows.select(
        F.lit(None).cast("string").alias("ts"),
        F.round(seconds, 1).alias("sec"),
        "bytes",
        F.round("bpb", 6).alias("bpb"),
        F.round("bpb_w", 6).alias("bpb_w"),
        F.round(F.col("bytes") / F.greatest(seconds, F.lit(0.001))).cast("long").alias("bps"),
        F.transform("bit_costs", lambda c: F.round(c, 4)).alias("bit_costs"),
        "match_hits",
        F.round("match_avg_len", 1).alias("match_avg_len"),
    )


def baseline_records(windows: DataFrame, seconds: Column) -> DataFrame:
    """As hybrid_records for a run over tokens: windows (bytes, tokens, bpb, bpb_w, w_ng, w_b, lr, surp)."""
    rounded = {"bpb": 6, "bpb_w": 6, "w_ng": 4, "w_b": 4, "lr": 4, "surp": 4}
    rate = F.round(F.col("bytes") / F.greatest(seconds, F.lit(0.001))).cast("long").alias("bps")
    return windows.select(F.lit(None).cast("string").alias("ts"), F.round(seconds, 1).alias("sec"), "bytes", "tokens", *(F.round(c, rounded[c]).alias(c) for c in ("bpb", "bpb_w")), rate, *(F.round(c, rounded[c]).alias(c) for c in ("w_ng", "w_b", "lr", "surp")))


class Progress(StreamingQueryListener):
    """A line for each batch of a stream: rows so far, rows a second, seconds since it began."""

    def __init__(self, out=None) -> None:
        self.out, self.rows, self.began = out or sys.stderr, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.rows, self.began = 0, time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        took = max(time.monotonic() - self.began, 0.001)
        print(f"{event.progress.name or event.progress.id}: {self.rows} rows, {self.rows / took:.0f} a second, {took:.1f} s", file=self.out, flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


#: Tags of a snapshot's sections: context mixer and match model (fixed values).
MIXER, MATCH = 1, 4


def state_sections(cm: ContextMixer, match: MatchModel | None = None) -> dict[int, bytes]:
    """What a fold has learnt, as sections of a snapshot. They are pickles: read only those you have written."""
    return {MIXER: pickle.dumps(cm.saved())} | ({MATCH: pickle.dumps(match)} if match else {})


def restore_state(sections: dict[int, bytes]) -> tuple[ContextMixer, MatchModel | None]:
    return ContextMixer.restored(pickle.loads(sections[MIXER])), pickle.loads(sections[MATCH]) if MATCH in sections else None


def write_snapshot(metadata: dict, sections: dict[int, bytes]) -> bytes:
    """A snapshot file: magic, version, tagged sections (tag 6 is the metadata as JSON), end mark."""
    out = MAGIC + struct.pack("<I", VERSION)
    for tag, payload in {6: json.dumps(metadata).encode(), **sections}.items():
        out += SECTION.pack(tag, len(payload)) + payload
    return out + bytes((END,))


def read_snapshot(data: bytes) -> tuple[dict, dict[int, bytes]]:
    """(metadata, other sections by tag); unknown tags are kept, and ValueError is raised for a file that is cut short or another's."""
    if data[:8] != MAGIC or len(data) < 13 or struct.unpack_from("<I", data, 8)[0] > VERSION:
        raise ValueError("not a snapshot of this version")
    at, found = 12, {}
    while at < len(data) and data[at] != END:
        if at + SECTION.size > len(data):
            raise ValueError("a section is cut short")
        tag, size = SECTION.unpack_from(data, at)
        found[tag] = data[at + SECTION.size : at + SECTION.size + size]
        at += SECTION.size + size
        if len(found[tag]) < size:
            raise ValueError("a section is cut short")
    if at >= len(data):
        raise ValueError("the end mark is missing")
    return json.loads(found.pop(6, b"{}")), found
