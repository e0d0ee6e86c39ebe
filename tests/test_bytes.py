"""Transforms, histograms and words of byte streams against their plain definitions, on drawn streams."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytewren.operators import bytestats as bs
from bytewren.sources.streams import explode_bytes, streams, with_lags

LETTERS = "aàbcdeéfghiîjklmnoöpqrstuvwxyzß"


def drawn(seed=20):
    """Streams by kind: drawn lengths and values, empty and null ones, single bytes, slopes, columns of numbers, words."""
    rng = np.random.default_rng(seed)
    out = {1: b"", 2: None, 3: bytes([200]), 4: rng.bytes(2), 5: rng.bytes(3)}
    for _ in range(6):
        out[len(out) + 1] = rng.bytes(int(rng.integers(4, 1500)))
    for _ in range(4):  # repeats of few values
        out[len(out) + 1] = bytes(rng.choice(rng.integers(0, 256, 3), int(rng.integers(20, 400))).tolist())
    for width in (1, 2, 4):  # numbers that rise slowly
        rise = np.cumsum(rng.integers(0, 3, 900))
        out[len(out) + 1] = rise.astype(f"<u{width}").tobytes()
    words = ["".join(rng.choice(list(LETTERS), int(rng.integers(1, 9)))) for _ in range(60)]
    out[len(out) + 1] = " ".join(rng.choice(words, 500)).encode()
    return out


STREAMS = drawn()
FULL = {i: c for i, c in STREAMS.items() if c}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(STREAMS.items()), "id long, content binary").cache()


def collected(rows, *columns):
    out = {}
    for r in rows.collect():
        out.setdefault(r["stream_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def plain_entropy(values):
    n = len(values)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(values).values()) / n if n else 0.0


def plain_planes(c, stride):
    return 8.0 if len(c) < stride else sum(plain_entropy(c[k::stride]) * len(c[k::stride]) for k in range(stride)) / len(c)


@pytest.mark.parametrize("limit", [0, 1, 333])
def test_explode(df, limit):
    cut = {i: list(enumerate(c[:limit] if limit else c)) for i, c in FULL.items()}
    assert collected(explode_bytes(df, "id", "content", limit), "pos", "b") == cut


@pytest.mark.parametrize("stride", [1, 3, 8, 1000])
def test_delta(df, stride):
    encoded = with_lags(streams(df, "id", "content"), stride).withColumn("d", bs.delta(stride))
    want = {i: [(p, (b - (c[p - stride] if p >= stride else 0)) % 256) for p, b in enumerate(c)] for i, c in FULL.items()}
    assert collected(encoded, "pos", "d") == want
    assert encoded.withColumn("back", bs.delta_decode(encoded, stride)).where("back <> b").count() == 0


@pytest.mark.parametrize("stride", [2, 3, 4, 8])
def test_byteplane(df, stride):
    sized = explode_bytes(df.withColumn("n", F.octet_length("content")), "id", "content", 0, "n").withColumn("q", bs.plane_position(stride, F.col("pos"), F.col("n")))
    planes = {i: b"".join(c[k::stride] for k in range(stride)) for i, c in FULL.items()}
    assert collected(sized, "q", "b") == {i: list(enumerate(p)) for i, p in planes.items()}
    assert sized.where(bs.plane_source(stride, F.col("q"), F.col("n")) != F.col("pos")).count() == 0


def test_entropy(df):
    each = explode_bytes(df, "id", "content")
    found = {r.stream_id: r.entropy for r in bs.entropy(bs.histogram(each, "stream_id"), "stream_id").collect()}
    assert found == pytest.approx({i: plain_entropy(c) for i, c in FULL.items()}, abs=1e-9)
    for stride in (2, 3, 7):
        planes = {r.stream_id: r.entropy for r in bs.plane_entropy(each, stride, "stream_id").collect()}
        assert planes == pytest.approx({i: plain_planes(c, stride) for i, c in FULL.items()}, abs=1e-9)


def plain_choice(c):
    """The transform chosen for a stream, by trying one after the other."""
    c = (c or b"")[: bs.SAMPLE]
    if len(c) < 16:
        return "identity"
    name, best = "identity", plain_entropy(c)
    tries = [(f"delta_{s}", len(c) > s, lambda s=s: plain_entropy(bytes((b - (c[p - s] if p >= s else 0)) % 256 for p, b in enumerate(c)))) for s in bs.DELTAS]
    tries += [(f"byteplane_{s}", len(c) // s >= bs.PLANE_SAMPLES, lambda s=s: plain_planes(c, s)) for s in bs.PLANES]
    for other, enough, value in tries:
        if enough and value() < best - bs.GAIN:
            name, best = other, value()
    return name


def plain_apply(c, name):
    kind, _, s = name.partition("_")
    s = int(s or 0)
    if kind == "delta":
        return bytes((b - (c[p - s] if p >= s else 0)) % 256 for p, b in enumerate(c))
    return b"".join(c[k::s] for k in range(s)) if kind == "byteplane" else c


def test_detect_and_adapt(df):
    found = {r.stream_id: r.transform for r in bs.detect_transform(df, "id", "content").collect()}
    assert found == {i: plain_choice(c) for i, c in STREAMS.items()}
    assert len(set(found.values())) > 2
    encoded = collected(bs.adaptive_encode(df, "id", "content"), "pos", "b", "transform")
    assert encoded == {i: [(p, b, found[i]) for p, b in enumerate(plain_apply(c, found[i]))] for i, c in FULL.items()}


def test_repeated_ids_multiply_nothing(spark):
    rows = spark.createDataFrame([(1, b"ab" * 40), (1, b"ab" * 40)], "id long, content binary")
    assert bs.adaptive_encode(rows, "id", "content").count() == 160


@pytest.mark.parametrize("name, stride", [("identity", 0), ("delta", 2), ("byteplane", 4)])
def test_apply_transform_and_back(df, name, stride):
    done = bs.apply_transform(df, "id", "content", name, stride)
    assert collected(done, "pos", "b") == {i: list(enumerate(plain_apply(c, f"{name}_{stride}"))) for i, c in FULL.items()}
    assert collected(bs.reverse_transform(done, name, stride), "pos", "b") == {i: list(enumerate(c)) for i, c in FULL.items()}


def test_parse_transform():
    assert bs.parse_transform("identity") == bs.parse_transform("nonsense:3") == ("identity", 0)
    assert bs.parse_transform("auto") is bs.parse_transform("delta:many") is None
    assert bs.parse_transform("delta:16") == ("delta", 16) and bs.parse_transform("byteplane:2") == ("byteplane", 2)
    assert [bs.transform_label(bs.parse_transform(t)) for t in ("identity", "auto", "delta:16", "byteplane:2")] == ["identity", "auto", "delta:16", "byteplane:2"]


def test_words(spark):
    rng = random.Random(21)
    letters = "abXYZ_$09é"
    texts = ["".join(rng.choice(letters + " .,;!?-\n\t\0") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = collected(bs.word_segments(rows, "id", "t"), "word_no", "word", "previous", "before_that")
    want = {}
    for i, t in enumerate(texts):
        words, word = [], b""
        for b in (t or "").encode() + b" ":
            if b in bs.SEPARATORS:
                words += [word.decode("latin-1")] if word else []
                word = b""
            else:
                word += bytes([b + 32 if 65 <= b <= 90 else b])
        if words:
            want[i] = [(k, w, words[k - 1] if k > 0 else None, words[k - 2] if k > 1 else None) for k, w in enumerate(words)]
    assert found == want
