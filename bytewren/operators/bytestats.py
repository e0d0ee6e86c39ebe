"""Histograms, entropies and reversible transforms of byte streams."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewren.sources.streams import bounded, counted, explode_bytes, per_stream, streams, with_lags

#: Bytes looked at for a transform, least gain in bits a byte, and samples that a plane needs.
SAMPLE, GAIN, PLANE_SAMPLES = 8192, 0.15, 64
DELTAS, PLANES = (1, 2, 4, 8), (2, 4, 8)
#: Bytes that end a word (fixed values): white space, ASCII punctuation but _ and $, 0 and 255.
SEPARATORS = [0, 9, 10, 13, *range(32, 36), *range(37, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127), 255]


def histogram(df: DataFrame, *keys: str, value: str = "b") -> DataFrame:
    """(*keys, value, n): counts are summed within tasks before they are shuffled."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """(*keys, total, entropy) in bits: log2 N - sum(n log2 n) / N, one pass over a histogram."""
    summed = hist.groupBy(*keys).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("_s"))
    return summed.select(*keys, "total", (F.log2("total") - F.col("_s") / F.col("total")).alias("entropy"))


def plane_entropy(df: DataFrame, stride: int, *keys: str) -> DataFrame:
    """(*keys, entropy): entropies of the bytes at each position modulo ``stride``, weighted by their number; 8 if a stream is shorter than the stride."""
    planes = entropy(histogram(df.withColumn("plane", F.col("pos") % stride), *keys, "plane"), *keys, "plane")
    total = F.sum("total")
    return planes.groupBy(*keys).agg(F.when(total < stride, 8.0).otherwise(F.sum(F.col("entropy") * F.col("total")) / total).alias("entropy"))


def delta(stride: int) -> Column:
    """The byte minus the byte ``stride`` places before it, modulo 256; the first bytes as they are. For with_lags()."""
    lagged = F.col(f"lag{stride}")
    return F.coalesce(F.pmod(F.col("b") - lagged, F.lit(256)), F.col("b"))


def delta_decode(df: DataFrame, stride: int, value: str = "d") -> Column:
    """The inverse of delta: a running sum in each lane, modulo 256."""
    lane = Window.partitionBy("stream_id", F.col("pos") % stride).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.pmod(F.sum(value).over(lane), F.lit(256)).cast("int")


def plane_position(stride: int, pos: Column, n: Column) -> Column:
    """Where byte ``pos`` of ``n`` goes when bytes are grouped by position modulo ``stride``."""
    lane = pos % stride
    whole = F.floor(n / stride)
    return (lane * whole + F.least(lane, n % stride) + F.floor(pos / stride)).cast("int")


def plane_source(stride: int, at: Column, n: Column) -> Column:
    """The inverse of plane_position; the first n modulo stride planes have one byte more."""
    whole, rest = F.floor(n / stride), n % stride
    border = rest * (whole + 1)
    first = F.floor(at / (whole + 1)) + (at % (whole + 1)) * stride
    later = rest + F.floor((at - border) / F.greatest(whole, F.lit(1))) + ((at - border) % F.greatest(whole, F.lit(1))) * stride
    return F.when(at < border, first).otherwise(later).cast("int")


def _bits(counts: np.ndarray) -> float:
    """Entropy of a histogram in bits, times its sum."""
    n = counts[counts > 0].astype(np.float64)
    total = n.sum()
    return float(total * np.log2(total) - (n * np.log2(n)).sum()) if len(n) else 0.0


def _delta(b: np.ndarray, stride: int) -> np.ndarray:
    """As delta() for an array of bytes."""
    d = b.copy()
    d[stride:] -= b[: max(len(b) - stride, 0)]
    return d


def _delta_histogram(parts: list[np.ndarray], stride: int) -> np.ndarray:
    return sum(np.bincount(_delta(b, stride), minlength=256) for b in parts)


def _plane_histograms(parts: list[np.ndarray], stride: int) -> list[np.ndarray]:
    return [sum(np.bincount(b[lane::stride], minlength=256) for b in parts) for lane in range(stride)]


def stream_entropies(df: DataFrame, id_col: str, content_col: str, deltas: tuple[int, ...] = (), planes: tuple[int, ...] = ()) -> DataFrame:
    """(stream_id, stride, entropy) under each delta and of each byte-plane's mean; 8 if a stream is shorter than the planes' stride. Empty streams have no rows."""

    def rows(contents: list[bytes]) -> list[tuple]:
        parts = [np.frombuffer(x, np.uint8) for x in contents]
        n = sum(map(len, parts))
        if not n:
            return []
        out = [(s, _bits(_delta_histogram(parts, s)) / n) for s in deltas]
        return out + [(s, 8.0 if n < s else sum(map(_bits, _plane_histograms(parts, s))) / n) for s in planes]

    return per_stream(df, id_col, content_col, "stride int, entropy double", rows)


def bit_ones(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, j, ones, n): ones at each bit of a stream's bytes, most significant first. Empty streams have no rows."""

    def rows(contents: list[bytes]) -> list[tuple]:
        counts = sum(np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in contents)
        n = int(counts.sum())
        return [(j, int(counts[np.arange(256) >> (7 - j) & 1 == 1].sum()), n) for j in range(8)] if n else []

    return per_stream(df, id_col, content_col, "j int, ones long, n long", rows)


def pair_counts(df: DataFrame, content_col: str, group: str) -> DataFrame:
    """(group, p, c, n): counts of a byte after the one before, -1 at a stream's beginning."""

    def count(b: np.ndarray, pos: np.ndarray, _):
        yield 0, np.where(pos > 0, np.roll(b, 1).astype(np.int64), -1) << 8 | b

    found = counted(df, content_col, count, group).groupBy(group, "key").agg(F.sum("n").alias("n"))
    return found.select(group, F.shiftright("key", 8).cast("int").alias("p"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("c"), "n")


def delta_trip(df: DataFrame, id_col: str, content_col: str, stride: int) -> DataFrame:
    """(stream_id, n_bytes, encoded_sum, mismatches) of the delta, its bytes weighed by position, and of its inverse by running sums. Empty streams have no rows."""

    def rows(contents: list[bytes]) -> list[tuple]:
        n = digest = wrong = 0
        for x in contents:
            b = np.frombuffer(x, np.uint8)
            d = _delta(b, stride)
            back = np.empty_like(b)
            for lane in range(stride):
                back[lane::stride] = np.cumsum(d[lane::stride], dtype=np.uint8)
            n, digest, wrong = n + len(b), digest + weighed(d), wrong + int((back != b).sum())
        return [(n, digest, wrong)] if n else []

    return per_stream(df, id_col, content_col, "n_bytes long, encoded_sum long, mismatches long", rows)


def weighed(b: np.ndarray) -> int:
    """Sum of bytes by their position modulo 97, from 1."""
    return int((b.astype(np.int64) * (np.arange(len(b)) % 97 + 1)).sum())


def best_transform(contents: list[bytes]) -> tuple[int, float, float, str]:
    """(bytes of the sample, entropy as it is, least entropy, transform) from the first SAMPLE bytes of each content.

    Candidates are tried in order; one replaces the best so far only if it gains more than GAIN, so the order matters.
    """
    parts = [np.frombuffer(x, np.uint8, min(len(x), SAMPLE)) for x in contents if len(x)]
    n = sum(map(len, parts))
    if n < 16:
        return n, 0.0, 0.0, "identity"
    raw = _bits(sum(np.bincount(b, minlength=256) for b in parts)) / n
    best, name = raw, "identity"
    for s in DELTAS:
        if n > s and (h := _bits(_delta_histogram(parts, s)) / n) < best - GAIN:
            best, name = h, f"delta_{s}"
    for s in PLANES:
        if n // s >= PLANE_SAMPLES and (h := sum(map(_bits, _plane_histograms(parts, s))) / n) < best - GAIN:
            best, name = h, f"byteplane_{s}"
    return n, raw, best, name


def detect_transform(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, n_sample, raw_entropy, best_entropy, transform) from a stream's first SAMPLE bytes, a row for each of ``df``."""
    rows = lambda contents: [best_transform(contents)] * len(contents)
    found = per_stream(df, id_col, content_col, "n_sample long, raw_entropy double, best_entropy double, transform string", rows, SAMPLE)
    known = F.col("stream_id").isNotNull()
    nothing = {"n_sample": 0, "raw_entropy": 0.0, "best_entropy": 0.0, "transform": "identity"}
    return found.select("stream_id", *(F.when(known, F.col(c)).otherwise(F.lit(x)).alias(c) for c, x in nothing.items()))


def parse_transform(text: str) -> tuple[str, int] | None:
    """identity, delta:N or byteplane:N as (name, stride); auto, and a stride that is no number, as None: detect it. Unknown names are identity."""
    name, _, stride = text.partition(":")
    if name == "auto":
        return None
    if name in ("delta", "byteplane"):
        return (name, int(stride)) if stride.isdigit() else None
    return "identity", 0


def apply_transform(df: DataFrame, id_col: str, content_col: str, name: str, stride: int) -> DataFrame:
    """(stream_id, pos, b) after a transform."""
    if name == "delta":
        return with_lags(streams(df, id_col, content_col), stride).select("stream_id", "pos", delta(stride).cast("int").alias("b"))
    each = explode_bytes(df.withColumn("_n", F.octet_length(F.col(content_col).cast("binary"))), id_col, content_col, 0, "_n")
    if name == "byteplane" and stride > 1:
        each = each.withColumn("pos", plane_position(stride, F.col("pos"), F.col("_n")))
    return each.select("stream_id", "pos", "b")


def reverse_transform(each: DataFrame, name: str, stride: int) -> DataFrame:
    """(stream_id, pos, b) as before apply_transform."""
    if name == "delta":
        return each.select("stream_id", "pos", delta_decode(each, stride, "b").alias("b"))
    if name == "byteplane" and stride > 1:
        n = F.count("*").over(Window.partitionBy("stream_id"))
        return each.withColumn("_n", n).select("stream_id", plane_source(stride, F.col("pos"), F.col("_n")).alias("pos"), "b")
    return each


def transform_label(transform: tuple[str, int] | None) -> str:
    """A parsed transform as text, as parse_transform reads it."""
    if transform is None:
        return "auto"
    name, stride = transform
    return f"{name}:{stride}" if stride else name


def _transformed(b: np.ndarray, transform: str) -> np.ndarray:
    name, _, stride = transform.partition("_")
    if name == "delta":
        return _delta(b, int(stride))
    return np.concatenate([b[lane :: int(stride)] for lane in range(int(stride))]) if name == "byteplane" else b


def adaptive_encode(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, transform, pos, b): every stream under the transform detected on its sample.

    A stream is transformed where its row lies. Rows with one id have one transform; a stream without an id has none.
    """

    def rows(contents: list[bytes]) -> list[tuple]:
        transform = best_transform(contents)[3]
        return [(transform, _transformed(np.frombuffer(x, np.uint8), transform).tobytes()) for x in contents]

    made = per_stream(df.where(F.col(id_col).isNotNull()), id_col, content_col, "transform string, encoded binary", rows)
    return explode_bytes(made, "stream_id", "encoded", 0, "transform")


def adaptive_digest(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, transform, n_bytes, encoded_sum): adaptive_encode's bytes, weighed by position. Empty streams have no rows."""

    def rows(contents: list[bytes]) -> list[tuple]:
        transform, n = best_transform(contents)[3], sum(map(len, contents))
        return [(transform, n, sum(weighed(_transformed(np.frombuffer(x, np.uint8), transform)) for x in contents))] if n else []

    return per_stream(df.where(F.col(id_col).isNotNull()), id_col, content_col, "transform string, n_bytes long, encoded_sum long", rows)


def case_fold(b: Column) -> Column:
    """A-Z to a-z, all other bytes as they are."""
    return F.when(b.between(65, 90), b + 32).otherwise(b)


def is_separator(b: Column) -> Column:
    return b.isin(SEPARATORS)


def word_segments(df: DataFrame, id_col: str, content_col: str, limit: int = 0) -> DataFrame:
    """(stream_id, word_no, word, previous, before_that): case-folded runs of bytes between separators, with the two words before.

    Words are cut within the row, by the separators as a character class; only the
    lag over words needs an order, and it is that of the array.
    """
    chars = "".join(f"\\x{b:02X}" for b in SEPARATORS)
    content = F.substring(F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary")), 1, limit or 2**31 - 1)
    folded = F.translate(F.decode(content, "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.select(F.col(id_col).alias("stream_id"), F.regexp_extract_all(folded, F.lit(f"[^{chars}]+"), F.lit(0)).alias("w"))
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("word"), F.slice(F.concat(F.array(F.lit(None)), "w"), 1, n).alias("previous"), F.slice(F.concat(F.array(F.lit(None), F.lit(None)), "w"), 1, n).alias("before_that"))
    return words.select("stream_id", F.posexplode(zipped).alias("word_no", "z")).select("stream_id", "word_no", "z.word", "z.previous", "z.before_that")


#: Separators to blanks, A-Z to a-z.
_WORDS = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(data: bytes) -> list[bytes]:
    """Case-folded runs of bytes between separators."""
    return [w for w in data.translate(_WORDS).split(b" ") if w]


def word_stats(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, n_words, n_distinct, n_word_bytes, n_contexts, n_pairs): words of each stream, and the different pairs before a word. Streams without words have no rows."""

    def rows(contents: list[bytes]) -> list[tuple]:
        each = [words(x) for x in contents]
        n = sum(map(len, each))
        pairs = set().union(*(zip(w, w[1:-1]) for w in each))
        return [(n, len(set().union(*each)), sum(len(x) for w in each for x in w), len(pairs), sum(max(len(w) - 2, 0) for w in each))] if n else []

    return per_stream(df, id_col, content_col, "n_words long, n_distinct long, n_word_bytes long, n_contexts long, n_pairs long", rows)


def word_pairs(df: DataFrame, content_col: str, most: int = 200_000) -> DataFrame:
    """(previous, word, n): counts of neighbouring words of a stream. A worker sums them until it holds ``most`` pairs."""
    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    bounded(df.sparkSession)

    def send(held: Counter) -> pa.RecordBatch:
        text = lambda k: pa.array([p[k].decode("latin-1") for p in held], pa.string())
        return pa.RecordBatch.from_arrays([text(0), text(1), pa.array(held.values(), pa.int64())], ["previous", "word", "n"])

    def run(batches):
        held = Counter()
        for batch in batches:
            for x in batch.column(0):
                w = words(x.as_py())
                held.update(zip(w, w[1:]))
                if len(held) >= most:
                    yield send(held)
                    held = Counter()
        yield send(held)

    return df.select(content.alias("content")).mapInArrow(run, "previous string, word string, n long").groupBy("previous", "word").agg(F.sum("n").alias("n"))
