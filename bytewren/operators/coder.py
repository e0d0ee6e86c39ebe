"""Range coding of streams under an adaptive model, a container for it, and the call-address transform."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.operators.predictors import AdaptiveMixer, BiasHead, TokenNgrams
from bytewren.sources import vocabulary
from bytewren.sources.streams import bounded, pooled

TOTAL, TOP = 1 << 24, 1 << 24
MASK = (1 << 32) - 1
#: Container: magic, bytes of the stream, symbols, then the model's parameters, which a decoder needs as well.
HEAD, MAGIC = struct.Struct("<8sIId"), b"BWRNSTR1"
CALLS = (0xE8, 0xE9)


def cdf(p: np.ndarray) -> np.ndarray:
    """Cumulative frequencies up to TOTAL, each symbol at least 1; the rounding rest goes to the commonest, the last on ties."""
    n = len(p)
    room, mass = TOTAL - n, float(p.sum())
    extra = np.floor(p / mass * room).astype(np.int64) if mass > 0 else np.zeros(n, np.int64)
    extra[n - 1 - int(np.argmax(extra[::-1]))] += room - int(extra.sum())
    return np.concatenate([[0], np.cumsum(extra + 1)])


def uniform(n: int) -> np.ndarray:
    return np.arange(n + 1) * (TOTAL // n)


class Encoder:
    """Carries wait in a cached byte and a count of full bytes after it."""

    def __init__(self) -> None:
        self.low, self.range, self.out, self.cache, self.pending = 0, MASK, bytearray(), None, 0

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low > MASK:
            carry = self.low >> 32
            if self.cache is not None:
                self.out.append((self.cache + carry) & 255)
            self.out += bytes([(255 + carry) & 255]) * self.pending
            self.pending, self.cache = 0, self.low >> 24 & 255
        else:
            self.pending += 1
        self.low = (self.low & 0xFFFFFF) << 8

    def encode(self, low: int, high: int, total: int) -> None:
        step = self.range // total
        self.low += low * step
        self.range = step * (high - low) if high < total else self.range - step * low
        while self.range < TOP:
            self._shift()
            self.range <<= 8

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range, self.code = data, 4, MASK, int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def position(self, total: int) -> int:
        self.step = self.range // total
        return min(self.code // self.step, total - 1)

    def take(self, low: int, high: int, total: int) -> None:
        self.code -= low * self.step
        self.range = self.step * (high - low) if high < total else self.range - self.step * low
        while self.range < TOP:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.code, self.range, self.at = (self.code << 8 | byte) & MASK, self.range << 8, self.at + 1


class ByteModel:
    """Order-one counts, decayed when they grow large: what the codec predicts with."""

    def __init__(self, gain: float) -> None:
        self.gain, self.counts, self.last = gain, {}, -1

    def table(self) -> np.ndarray:
        return uniform(256) if self.last < 0 else cdf(self.counts.get(self.last, np.full(256, 1.0)))

    def observe(self, byte: int) -> None:
        if self.last >= 0:
            counts = self.counts.setdefault(self.last, np.full(256, 1.0))
            counts[byte] += self.gain
            if counts.sum() > 65_536:
                counts *= 0.5
        self.last = byte


def compress(data: bytes, gain: float = 32.0) -> bytes:
    encoder, model = Encoder(), ByteModel(gain)
    for byte in data:
        table = model.table()
        encoder.encode(int(table[byte]), int(table[byte + 1]), int(table[-1]))
        model.observe(byte)
    return HEAD.pack(MAGIC, len(data), len(data), gain) + (encoder.finish() if data else b"")


def read_container(blob: bytes) -> tuple[int, int, float, bytes]:
    """(bytes, symbols, gain, payload); raises ValueError for anything else."""
    if len(blob) < HEAD.size or not blob.startswith(MAGIC):
        raise ValueError("not a container of this format")
    _, size, symbols, gain = HEAD.unpack_from(blob)
    return size, symbols, gain, blob[HEAD.size :]


def decompress(blob: bytes) -> bytes:
    size, _, gain, payload = read_container(blob)
    decoder, model, out = Decoder(payload), ByteModel(gain), bytearray()
    for _ in range(size):
        table = model.table()
        byte = int(np.searchsorted(table, decoder.position(int(table[-1])), "right")) - 1
        decoder.take(int(table[byte]), int(table[byte + 1]), int(table[-1]))
        model.observe(byte)
        out.append(byte)
    return bytes(out)


class TokenEnsemble:
    """What the token codec predicts with: n-grams and a bias head, mixed adaptively; the first token is uniform."""

    def __init__(self, size: int) -> None:
        self.grams, self.head, self.mixer = TokenNgrams(size, 0.5), BiasHead(size), AdaptiveMixer()
        self.base, self.p = np.zeros(size), None

    def table(self) -> np.ndarray:
        if not self.grams.last:
            return uniform(len(self.base))
        self.parts = self.grams.bias(), self.head.bias.copy()
        self.p = self.mixer.mix(self.base, *self.parts)
        return cdf(self.p)

    def observe(self, token: int) -> None:
        if self.grams.last:
            self.mixer.update(self.p, *self.parts, token)
            self.head.update(self.p, token)
        self.grams.observe(token)


#: Container of tokens: magic, bytes of the stream, tokens.
TOKEN_HEAD, TOKEN_MAGIC = struct.Struct("<8sII"), b"BWRNTOK1"


def compress_tokens(data: bytes, tokens: dict[bytes, int]) -> bytes:
    """A stream cut by greedy longest match and coded token by token; every single byte of it must be a token."""
    if missing := [b for b in set(data) if bytes([b]) not in tokens]:
        raise ValueError(f"the vocabulary lacks the bytes {sorted(missing)}")
    ids = vocabulary.tokens(data, tokens)
    encoder, model = Encoder(), TokenEnsemble(max(tokens.values()) + 1)
    for token in ids:
        table = model.table()
        encoder.encode(int(table[token]), int(table[token + 1]), int(table[-1]))
        model.observe(token)
    return TOKEN_HEAD.pack(TOKEN_MAGIC, len(data), len(ids)) + (encoder.finish() if ids else b"")


def decompress_tokens(blob: bytes, tokens: dict[bytes, int]) -> bytes:
    if len(blob) < TOKEN_HEAD.size or not blob.startswith(TOKEN_MAGIC):
        raise ValueError("not a container of tokens")
    _, size, count = TOKEN_HEAD.unpack_from(blob)
    bytes_of = {i: t for t, i in tokens.items()}
    decoder, model, out = Decoder(blob[TOKEN_HEAD.size :]), TokenEnsemble(max(tokens.values()) + 1), []
    for _ in range(count):
        table = model.table()
        token = int(np.searchsorted(table, decoder.position(int(table[-1])), "right")) - 1
        decoder.take(int(table[token]), int(table[token + 1]), int(table[-1]))
        model.observe(token)
        out.append(bytes_of[token])
    data = b"".join(out)
    if len(data) != size:
        raise ValueError("the container's length is another")
    return data


def token_count(blob: bytes) -> int:
    return TOKEN_HEAD.unpack_from(blob)[2]


def code_tokens(df: DataFrame, id_col: str, content_col: str, tokens: dict[bytes, int]) -> DataFrame:
    """(stream_id, n_bytes, n_tokens, coded, lossless): each stream coded token by token, decoded and compared, in place."""
    sent = df.sparkSession.sparkContext.broadcast(tokens)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            coded = [compress_tokens(d, sent.value) for d in frame["content"]]
            back = [decompress_tokens(c, sent.value) == d for c, d in zip(coded, frame["content"])]
            yield pd.DataFrame({"stream_id": frame["stream_id"], "n_bytes": [len(d) for d in frame["content"]], "n_tokens": [token_count(c) for c in coded], "coded": coded, "lossless": back})

    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    return df.select(F.col(id_col).alias("stream_id"), content.alias("content")).mapInPandas(run, "stream_id long, n_bytes long, n_tokens long, coded binary, lossless boolean")


def call_transform(data: bytes, decode: bool = False) -> tuple[bytes, dict[str, int]]:
    """Relative addresses after call and jump bytes made absolute, or back. A bijection.

    Within a stream of n bytes the address a relative r at i stands for is (r + i)
    mod n, for 0 <= r < n; any other address is left as it is. Both directions
    map 0..n-1 onto itself, so what the decoder sees tells what the encoder did.
    The four bytes after a hit are skipped.
    """
    n, out, i = len(data), bytearray(data), 0
    stats = {"e8": 0, "e9": 0, "transformed": 0, "skipped": 0}
    while i + 4 < n:
        if out[i] not in CALLS:
            i += 1
            continue
        stats["e8" if out[i] == CALLS[0] else "e9"] += 1
        address = int.from_bytes(out[i + 1 : i + 5], "little", signed=True)
        if 0 <= address < n:
            out[i + 1 : i + 5] = ((address - i if decode else address + i) % n).to_bytes(4, "little")
            stats["transformed"] += 1
        else:
            stats["skipped"] += 1
        i += 5
    return bytes(out), stats


def code_streams(df: DataFrame, id_col: str, content_col: str, limit: int = 2**31 - 1) -> DataFrame:
    """(stream_id, n_bytes, coded, lossless): each stream compressed, decompressed and compared, in place; streams step together (see coding)."""
    bounded(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bytewren.operators import coding

        for frame in pooled(frames, "content"):
            ids, data = frame["stream_id"].tolist(), [bytes(x) for x in frame["content"]]
            rows = [(ids[i], len(data[i]), coded, back) for i, coded, back in coding.round_trips(data)]
            yield pd.DataFrame(rows, columns=["stream_id", "n_bytes", "coded", "lossless"])

    content = F.substring(F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary")), 1, limit)
    return df.select(F.col(id_col).alias("stream_id"), content.alias("content")).mapInPandas(run, "stream_id long, n_bytes long, coded binary, lossless boolean")


def call_stats(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(stream_id, e8, e9, transformed, skipped, lossless) of the call-address transform of whole streams."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [call_transform(d) for d in frame["content"]]
            stats = pd.DataFrame([s for _, s in made], columns=["e8", "e9", "transformed", "skipped"])
            stats.insert(0, "stream_id", frame["stream_id"].to_numpy())
            stats["lossless"] = [call_transform(x, True)[0] == d for (x, _), d in zip(made, frame["content"])]
            yield stats

    content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
    return df.select(F.col(id_col).alias("stream_id"), content.alias("content")).mapInPandas(run, "stream_id long, e8 long, e9 long, transformed long, skipped long, lossless boolean")
