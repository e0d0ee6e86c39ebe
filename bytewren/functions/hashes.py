"""Hashes and little conversions that need wrapping 64-bit arithmetic or bytes: vectorised Python over Arrow batches.

Where only identity matters, prefer exact keys or ``xxhash64``: those stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# 64-bit FNV-1a, and the start and factor of the second half of a fingerprint.
OFFSET, PRIME, WRAP = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
#: Multiplier and addend of the linear congruential generator behind seeded weights.
LCG_FACTOR, LCG_ADD = 6364136223846793005, 1


def fnv1a(data: bytes, start: int = OFFSET, factor: int = PRIME) -> int:
    h = start
    for b in data:
        h = (h ^ b) * factor & WRAP
    return h


def fnv1a_many(data: list[bytes], start: int = OFFSET, factor: int = PRIME) -> np.ndarray:
    """The hash of each, all rows at once: one step for each position, over the rows that are that long."""
    size = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    h = np.full(len(data), start, np.uint64)
    longer = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # rows longer than each position
    for pos, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ flat[begin[:n] + pos]) * np.uint64(factor)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_tokens(tokens: list[int]) -> int:
    """Over whole token ids instead of their bytes."""
    h = OFFSET
    for t in tokens:
        h = (h ^ t) * PRIME & WRAP
    return h


def fingerprint(data: bytes, limit: int | None = None) -> str:
    """32 hex digits from two such hashes of the first ``limit`` bytes, the second with start and factor exchanged. Not cryptographic."""
    part = data if limit is None else data[:limit]
    return f"{fnv1a(part):016x}{fnv1a(part, PRIME, OFFSET):016x}"


@F.pandas_udf(StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    return _hex(data, lambda d: [f"{h:016x}" for h in fnv1a_many(d).tolist()])


@F.pandas_udf(StringType())
def fingerprint_hex(data: pd.Series) -> pd.Series:
    return _hex(data, lambda d: [f"{a:016x}{b:016x}" for a, b in zip(fnv1a_many(d).tolist(), fnv1a_many(d, PRIME, OFFSET).tolist())])


def _hex(data: pd.Series, digits) -> pd.Series:
    known = data[data.notna()]
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    out[known.index] = digits([bytes(d) for d in known])
    return out


def lossy_text(data: Column) -> Column:
    """Bytes as text for display; what is no UTF-8 becomes a replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def little_endian(data: str, at: int, size: int) -> Column:
    """An unsigned integer of 1 to 7 bytes from a binary column, at a position from 1."""
    digits = F.concat(*(F.hex(F.substring(F.col(data), at + i, 1)) for i in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def lcg(seed: int, n: int) -> list[float]:
    """n numbers in -1 to 1 from the generator's upper bits."""
    out, state = [], seed
    for _ in range(n):
        state = state * LCG_FACTOR + LCG_ADD & WRAP
        out.append((state >> 33) / (1 << 30) - 1)
    return out
