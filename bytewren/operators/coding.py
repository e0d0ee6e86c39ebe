"""The range coder of coder.py over many streams at once: the same containers, a byte of all streams at a time.

After a byte a stream has met few others, and all the rest are alike; so a table of 256 cumulative frequencies is a short
row, and encoder and decoder step through the rows of all streams together, longest first.
"""

from __future__ import annotations

import numpy as np

from bytewren.operators.coder import HEAD, MAGIC, MASK, TOP, TOTAL, Encoder, compress, decompress, read_container
from bytewren.operators.lockstep import batches

#: Streams and bytes coded together, and the longest stream that is.
TOGETHER, BATCH, LONGEST = 2048, 2 << 20, 64 << 10
ROOM = TOTAL - 256


class Models:
    """Order-one counts of many streams (coder.ByteModel each). A row for each context that a stream has met holds the bytes seen after it, by value.

    All other bytes of a row have one count, its ``base``; free places have it too, under the byte 256.
    """

    def __init__(self, n: int, gain: float) -> None:
        self.gain, self.row, self.used = gain, np.full((n, 256), -1, np.int64), 0
        self.bytes, self.counts = np.full((max(4 * n, 16), 4), 256, np.int64), np.ones((max(4 * n, 16), 4))
        self.base, self.sums, self.seen = np.ones(len(self.counts)), np.full(len(self.counts), 256.0), np.zeros(len(self.counts), np.int64)

    def rows(self, streams: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where each stream's counts after its last byte lie; made where there are none yet."""
        at = self.row[streams, last]
        new = np.flatnonzero(at < 0)
        if len(new):
            while self.used + len(new) > len(self.counts):
                more = len(self.counts)
                self.bytes = np.concatenate([self.bytes, np.full_like(self.bytes, 256)])
                self.counts = np.concatenate([self.counts, np.ones_like(self.counts)])
                self.base, self.sums, self.seen = (np.concatenate([x, np.full(more, v, x.dtype)]) for x, v in ((self.base, 1), (self.sums, 256), (self.seen, 0)))
            at[new] = self.used + np.arange(len(new))
            self.row[streams[new], last[new]] = at[new]
            self.used += len(new)
        return at

    def tables(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes, low, high, width) of coder.cdf() for the bytes seen in each row, and the width of any other; what rounding leaves to the byte 255 is not in them."""
        k = max(int(self.seen[at].max()), 1)
        seen, sums = self.bytes[at, :k], self.sums[at]
        other = np.floor(self.base[at] / sums * ROOM)
        extra = np.floor(self.counts[at, :k] / sums[:, None] * ROOM)
        more = extra - other[:, None]
        rest = ROOM - 256 * other - more.sum(1)
        best = k - 1 - np.argmax(more[:, ::-1], axis=1)
        here = np.arange(len(at))
        more[here, best] += np.where(more[here, best] > 0, rest, 0)  # else the last of 256 equal bytes has it
        below = np.cumsum(more, axis=1) - more
        low = seen * (other[:, None] + 1) + below
        return seen, low, low + other[:, None] + more + 1, other + 1

    def find(self, tables: tuple[np.ndarray, ...], byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of a byte in each row."""
        seen, low, high, width = tables
        here, before = np.arange(len(byte)), (seen < byte[:, None]).sum(1)
        at = np.minimum(before, seen.shape[1] - 1)
        mine = seen[here, at] == byte
        last = np.maximum(before - 1, 0)
        begin = np.where(before > 0, high[here, last] + (byte - seen[here, last] - 1) * width, byte * width)
        a = np.where(mine, low[here, at], begin)
        z = np.where(mine, high[here, at], begin + width)
        return a.astype(np.int64), np.where(byte == 255, TOTAL, z).astype(np.int64)

    def byte_at(self, tables: tuple[np.ndarray, ...], place: np.ndarray) -> np.ndarray:
        """The byte that holds a place of each row's table."""
        seen, low, high, width = tables
        here = np.arange(len(place))
        before = ((low <= place[:, None]) & (seen < 256)).sum(1)
        last = np.maximum(before - 1, 0)
        begin, first = np.where(before > 0, high[here, last], 0), np.where(before > 0, seen[here, last] + 1, 0)
        inside = (before > 0) & (place < begin)
        return np.where(inside, first - 1, np.minimum(first + (place - begin) // width, 255)).astype(np.int64)

    def observe(self, at: np.ndarray, byte: np.ndarray) -> None:
        k = max(int(self.seen[at].max()), 1)
        where = self.bytes[at, :k] == byte[:, None]
        known = where.any(1)
        self.counts[at[known], where.argmax(1)[known]] += self.gain
        new = at[~known]
        if len(new):
            if int(self.seen[new].max()) == self.counts.shape[1]:
                self.bytes = np.concatenate([self.bytes, np.full_like(self.bytes, 256)], axis=1)
                self.counts = np.concatenate([self.counts, np.repeat(self.base[:, None], self.counts.shape[1], axis=1)], axis=1)
            free = self.seen[new]
            self.bytes[new, free], self.counts[new, free] = byte[~known], self.base[new] + self.gain
            self.seen[new] += 1
            k = int(self.seen[new].max())
            order = np.argsort(self.bytes[new, :k], axis=1, kind="stable")
            self.bytes[new, :k] = np.take_along_axis(self.bytes[new, :k], order, 1)
            self.counts[new, :k] = np.take_along_axis(self.counts[new, :k], order, 1)
        self.sums[at] += self.gain
        large = at[self.sums[at] > 65_536]
        for x in (self.counts, self.base, self.sums):
            x[large] *= 0.5


def _active(sizes: np.ndarray) -> list[int]:
    """How many streams, by falling size, reach beyond each place."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left").tolist()


def compress_all(streams: list[bytes], gain: float = 32.0) -> list[bytes]:
    """coder.compress() of each stream; streams by falling length."""
    sizes = np.array([len(x) for x in streams], np.int64)
    data = np.zeros((len(streams), int(sizes[0]) if len(streams) else 0), np.uint8)
    for row, x in zip(data, streams):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    low = np.zeros(data.shape, np.int32)
    high = np.zeros(data.shape, np.int32)
    models, every = Models(len(streams), gain), np.arange(len(streams))
    for t, many in enumerate(_active(sizes)):
        byte = data[:many, t].astype(np.int64)
        if not t:
            low[:many, t], high[:many, t] = byte * (TOTAL // 256), (byte + 1) * (TOTAL // 256)
            continue
        at = models.rows(every[:many], data[:many, t - 1].astype(np.int64))
        low[:many, t], high[:many, t] = models.find(models.tables(at), byte)
        models.observe(at, byte)
    out = []
    for x, a, z in zip(streams, low, high):
        encoder = Encoder()
        for i, j in zip(a[: len(x)].tolist(), z[: len(x)].tolist()):
            encoder.encode(i, j, TOTAL)
        out.append(HEAD.pack(MAGIC, len(x), len(x), gain) + (encoder.finish() if x else b""))
    return out


def decompress_all(payloads: list[bytes], sizes: list[int], gain: float = 32.0) -> list[bytes]:
    """coder.decompress() of payloads without their heads; streams by falling size."""
    sizes_ = np.array(sizes, np.int64)
    n = len(payloads)
    wide = max(map(len, payloads), default=0) + 8
    code_bytes = np.zeros((n, wide), np.int64)
    for row, x in zip(code_bytes, payloads):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    out = np.zeros((n, int(sizes_[0]) if n else 0), np.uint8)
    at = np.full(n, 4, np.int64)
    width = np.full(n, MASK, np.int64)
    code = code_bytes[:, 0] << 24 | code_bytes[:, 1] << 16 | code_bytes[:, 2] << 8 | code_bytes[:, 3]
    models, every = Models(n, gain), np.arange(n)
    for t, many in enumerate(_active(sizes_)):
        here = every[:many]
        w, c = width[:many], code[:many]
        step = w // TOTAL
        place = np.minimum(c // step, TOTAL - 1)
        if t:
            rows = models.rows(here, out[:many, t - 1].astype(np.int64))
            table = models.tables(rows)
            byte = models.byte_at(table, place)
            low, high = models.find(table, byte)
            models.observe(rows, byte)
        else:
            byte = place // (TOTAL // 256)
            low, high = byte * (TOTAL // 256), (byte + 1) * (TOTAL // 256)
        out[:many, t] = byte
        c = c - low * step
        w = np.where(high < TOTAL, step * (high - low), w - step * low)
        small = np.flatnonzero(w < TOP)
        while len(small):
            c[small] = (c[small] << 8 | code_bytes[small, np.minimum(at[small], wide - 1)]) & MASK
            w[small] <<= 8
            at[small] += 1
            small = small[w[small] < TOP]
        width[:many], code[:many] = w, c
    return [row[:k].tobytes() for row, k in zip(out, sizes)]


def round_trips(streams: list[bytes]) -> list[tuple[int, bytes, bool]]:
    """(number, container, whether decoding gives the stream) of streams in any order; long ones one after the other."""
    out = []
    for batch in batches(((i, x) for i, x in enumerate(streams)), BATCH, TOGETHER):
        if len(batch[0][1]) > LONGEST:
            for i, x in batch:
                coded = compress(x)
                out.append((i, coded, decompress(coded) == x))
            continue
        ids, data = zip(*batch)
        coded = compress_all(list(data))
        heads = [read_container(x) for x in coded]
        back = decompress_all([h[3] for h in heads], [h[0] for h in heads])
        out += [(i, c, d == x) for i, c, d, x in zip(ids, coded, back, data)]
    return out
