"""Near-duplicates: SimHash fingerprints by multi-index hashing, and similar sets of shingles.

Two fingerprints within two bits differ in at most one bit of the upper half or
in none of the lower half. So a Hamming ball of radius one around the upper half
and one of radius zero around the lower half find every such pair; each hit is
verified on all 64 bits inside the join, so that false candidates make no rows.

Similar sets of shingles are looked for by fingerprints first: of two within
seven bits one of four segments differs in one bit at most, so that both hold the
same segment with one bit left out. Candidates are verified on whole sets.
Texts with a Jaccard similarity of 0.8 lie ten bits apart on average and up to
twenty, though, where no segments of 64 bits help. What fingerprints miss is found
by prefixes: in any one order of all shingles, two such sets share a shingle among
the first fifth of each. Commonest shingles come last, which only saves work.
Hence no similar pair is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import bound_batches, connected_components, cut, dealt, forest, forget, lookup, parts_for, passing, release, table, text_bytes, unused, utf8
from bytewren.llm.suffixes import HASH_BITS, _concat, _eight, _five, _pack, _runs

SEED, SHINGLE, CHUNK = 42, 3, 1 << 15
#: Words of a shingle and least Jaccard similarity, in tenths, for copies of a text.
WIDE, TENTHS = 5, 8
#: Counters of how common shingles are, and pieces in which they travel. They bear on the time only, not on the result.
CELLS, PIECES = 1 << 22, 64
#: Texts that share a shingle and are paired; of more, chunks of so many are compared in one task, so many shingles at a time.
FEW, CROWD, SLICE = 50, 2048, 4096
#: Shingles in a chunk, so that long texts make small chunks.
HEAVY = 1 << 20
#: Bits that fingerprints of candidates may differ in: twice the segments, less one. Rows of keys in a task.
RADIUS, SEGMENT, KEYED = 7, 16, 1 << 18
#: Rows of a task that compares texts which share a shingle, and bytes of sketches that it looks at together.
GROUPED, SENT = 1 << 16, 1 << 24
#: Shingles of heads that a task sends at once; those of which so many texts hold more lie in any task.
HELD, OFTEN = 1 << 19, 1000
#: Least and most bits of a sketch; more would not change the result.
SKETCH = (64, 1 << 16)


def shingles_of(text: bytes, width: int) -> list[bytes]:
    """All runs of ``width`` words; of fewer words the one run there is."""
    words = text.lower().split()  # bytes: only A-Z fold, only the six ASCII white-space bytes split
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a UTF-8 text: majority bits of its shingles' XXH64; 0 without words."""
    shingles = shingles_of(text, width)
    parts = (shingles[i : i + CHUNK] for i in range(0, len(shingles), CHUNK))
    return _majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), ">u8", len(part)) for part in parts)


def set_fingerprint(x: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles' hashes, each counted once; 0 without any."""
    return _majority(x[i : i + CHUNK].astype(">i8") for i in range(0, len(x), CHUNK))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """Bits that over half of the big-endian hashes have, as one signed number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row, null and repeated ids included; a null text counts as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for all pairs of distinct fingerprints (column fp) that differ in one or two bits, each once."""
    halves = distinct.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.expr("fp & 4294967295L").alias("lo"))
    # Of two halves one bit apart one has the bit clear: setting clear bits reaches each such pair from one side.
    ball = F.expr("concat(array(hi), filter(transform(sequence(0, 31), i -> hi | shiftleft(1L, i)), k -> k <> hi))")
    probe = halves.select(F.col("fp").alias("a"), F.col("hi").alias("from"), F.explode(ball).alias("key"))
    table = halves.select(F.col("fp").alias("b"), F.col("hi").alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    upper = probe.join(table, (probe["key"] == table["key"]) & near & ((probe["from"] != table["key"]) | (F.col("a") < F.col("b"))))
    left = halves.select(F.col("fp").alias("a"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    right = halves.select(F.col("fp").alias("b"), F.col("lo").alias("m"), F.col("hi").alias("g"))
    two = F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) == 2  # up to one bit was found above
    lower = left.join(right, (left["l"] == right["m"]) & (F.col("a") < F.col("b")) & two)
    return upper.select("a", "b").union(lower.select("a", "b"))


def fingerprint_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp, component (smallest id reachable over links, itself included).

    Copies share a fingerprint and are joined through it, never paired. Texts
    without words have fingerprint 0 and link like any other. A null id keeps
    its row but never names a component unless all ids of the component are null.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    total = rows.count()
    parts = parts_for(total)
    groups = cut(rows.coalesce(parts).groupBy("fp").agg(F.min("id").alias("low")).coalesce(parts))
    found = connected_components(links(groups.select("fp")))
    classes = _classes(groups, found, "fp", parts)
    return lookup(rows, classes, "fp", total).select("id", "fp", "component")


def _classes(groups: DataFrame, found: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, component): the smallest id (column low) of each key's component, from keys and (node, component) of those that link."""
    named = groups.join(found, groups[key] == found["node"], "left").select(key, "low", F.coalesce("component", key).alias("root"))
    named = cut(named.coalesce(parts))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    return cut(lookup(named, lowest, "root", named.count()).select(key, "component").coalesce(parts))


def shingle_set(text: bytes, width: int = WIDE) -> np.ndarray:
    """The sorted XXH64 of a text's shingles, each once, as signed 64-bit numbers."""
    shingles = shingles_of(text, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """How common shingles are, by CELLS of their hash: 0 up to a few times the mean, then one more for each doubling.

    Column t holds UTF-8 bytes. Tasks count what they see, up to 255 a cell, and
    pieces of their counters are summed as they come: what a task holds and what
    the driver gets has a fixed size.
    """
    piece = CELLS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[shingle_set(text) & (CELLS - 1)] += 1
        small = np.minimum(seen, 255).astype(np.uint8)
        made = [zstandard.compress(small[i * piece : (i + 1) * piece].tobytes(), 1) for i in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(made, pa.binary())], names=["piece", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(z), np.uint8).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["piece", "z"])

    summed = texts.select("t").mapInArrow(count, "piece int, z binary").repartition(PIECES, "piece").mapInArrow(add, "piece int, z binary")
    total = np.zeros(CELLS, np.int64)
    for r in summed.collect():  # PIECES rows
        total[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(zstandard.decompress(r["z"]), np.int64)
    return np.log2(np.maximum(1.0, total / (2 * total.mean() + 2))).astype(np.uint8)


def _sets(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(row, id, key, n, fp, x, head) of (row, id, t): a digest of the set of shingles, its size, its SimHash, its sketch, and the first of it in the order of levels."""
    sent = texts.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        levels = sent.value
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            heads = [x[np.argsort(levels[x & (CELLS - 1)], kind="stable")][: len(x) + 1 + -TENTHS * len(x) // 10] for x in sets]
            fps = [set_fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array([sketch(x) for x in sets], pa.binary()), _lists(heads)], names=["row", "id", "key", "n", "fp", "x", "head"])

    return texts.select("row", "id", "t").mapInArrow(run, "row long, id long, key binary, n long, fp long, x binary, head array<long>")


def leaders(key: np.ndarray, g: np.ndarray, n: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, na, nb): of the rows with one key, each with the first that is at most RADIUS bits away and of like size, if one is.

    What has found its first row leads no other, so pairs grow as the rows do, not with the square of a group.
    """
    order = np.lexsort((g, key))
    key, g, n, fp = key[order], g[order], n[order], fp[order]
    made = [np.empty((4, 0), np.int64)]
    while len(key):
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        close = (10 * np.minimum(n, n[first]) >= TENTHS * np.maximum(n, n[first])) & ~new
        near = close & (np.bitwise_count((fp ^ fp[first]).view(np.uint64)) <= RADIUS)
        made.append(np.stack([g[first], g, n[first], n])[:, near])
        left = ~(new | near)
        key, g, n, fp = key[left], g[left], n[left], fp[left]
    return tuple(np.unique(np.concatenate(made, axis=1), axis=1))


def fingerprint_candidates(one: DataFrame, total: int) -> DataFrame:
    """(a, b, na, nb) of (g, n, fp): texts of like size whose fingerprints differ in RADIUS bits at most, by multi-index hashing.

    A fingerprint has a key for every bit: the bit's segment without that bit. Two
    within RADIUS bits share a key. Fingerprints are dealt by the half of the
    segment that the bit is not in, and get their keys in the task. Of those with a
    key see ``leaders``. total: about how many rows there are.
    """
    half = SEGMENT // 2
    dealt = F.expr(f"transform(sequence(0, {64 // half - 1}), i -> i * {1 << half} + cast(shiftrightunsigned(fp, {half} * i) & {(1 << half) - 1} as int))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        columns = zip(*([c.to_numpy() for c in batch.columns] for batch in batches))
        lies, g, n, fp = [np.concatenate(c) for c in columns] or [np.empty(0, np.int64)] * 4
        low = ((lies >> half) ^ 1) * half  # the other half of the segment, whose bits are left out one by one
        start = (low // SEGMENT * SEGMENT).astype(np.uint64)
        segment = ((fp.view(np.uint64) >> start) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
        bits = [low + i for i in range(half)]
        keys = [(bit << SEGMENT) | (segment & ~(1 << (bit % SEGMENT))) for bit in bits]
        made = leaders(np.concatenate(keys), *(np.tile(x, half) for x in (g, n, fp)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["a", "b", "na", "nb"])

    rows = one.select(F.explode(dealt).alias("lies"), "g", "n", "fp").select(F.col("lies").cast("long"), "g", "n", "fp")
    return rows.repartition(64 * total // KEYED + 1, "lies").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def shared_heads(one: DataFrame, total: int) -> DataFrame:
    """(h, g, n, a, na) of (g, n, head): for each shingle that two heads hold or more, a row for each of them, with the lowest of them; total: about how many shingles heads hold.

    h is a shingle's leading bits, HASH_BITS besides those of its bucket; equal bits only make candidates. Buckets get shingles packed, without
    the texts' other columns. A shingle that more than OFTEN of a task's texts hold is shared for certain: its bucket gets
    to know it, its texts go to any bucket, and a and na are null.
    """
    bits = (total // KEYED).bit_length()
    inside = np.uint64((1 << HASH_BITS) - 1)
    none = np.empty(0, np.int64)

    def blob(key: np.ndarray, g: np.ndarray, n: np.ndarray, many: np.ndarray, own: tuple[np.ndarray, ...]) -> bytes:
        order = np.argsort(g, kind="stable")  # for the packing's sake
        key, g, n = key[order], g[order], n[order]
        starts = _runs(g)
        return _pack(np.diff(g[starts], prepend=0), n[starts], np.diff(np.append(starts, len(g))).astype(np.int32), _five(key & inside), _five(many & inside), *own)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal turn
            g, n, key = map(np.concatenate, zip(*held))
            order = np.argsort(key, kind="stable")
            g, n, key = g[order], n[order], key[order]
            starts = _runs(key)
            count = np.diff(np.append(starts, len(key)))
            often = np.repeat(count > OFTEN, count)
            many, rest = key[starts[count > OFTEN]], (key[~often], g[~often], n[~often])
            edges = np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(HASH_BITS)
            a, b = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (rest[0], many))
            made = [(i, blob(*(x[a[i] : a[i + 1]] for x in rest), many[b[i] : b[i + 1]], (none,) * 3)) for i in range(1 << bits) if a[i] < a[i + 1] or b[i] < b[i + 1]]
            own = [x[often] for x in (key.view(np.int64), g, n)]
            for start in range(0, len(own[0]), 1 << 14):
                turn += 1
                made.append((turn % (1 << bits), blob(none.view(np.uint64), none, none, none.view(np.uint64), tuple(x[start : start + (1 << 14)] for x in own))))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            head = batch.column(2)
            sizes = np.diff(head.offsets.to_numpy())
            key = head.flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits - HASH_BITS)
            held.append((np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), key))
            size += len(key)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        forget()
        parts = [_concat([x], ()) for x in frame["blob"]]
        g = np.concatenate([np.repeat(np.cumsum(p[0]), p[2]) for p in parts])
        n = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        key, many = (_eight(np.concatenate([p[k] for p in parts])) for k in (3, 4))
        order = np.lexsort((g, key))
        g, n, key = g[order], n[order], key[order]
        starts = _runs(key)
        count = np.diff(np.append(starts, len(key)))
        often = np.isin(key, many)
        found = np.repeat(count > 1, count) | often
        h = (key | (np.uint64(frame["bucket"].iloc[0]) << np.uint64(HASH_BITS))).view(np.int64)
        first = np.repeat(starts, count)
        made = {c: np.concatenate([x[found], *(p[k] for p in parts)]) for c, x, k in (("h", h, 5), ("g", g, 6), ("n", n, 7))}
        open_ = np.concatenate([often[found], np.ones(len(made["h"]) - int(found.sum()), bool)])
        for c, x in (("a", g), ("na", n)):
            made[c] = pd.arrays.IntegerArray(np.concatenate([x[first][found], np.zeros(len(open_) - int(found.sum()), np.int64)]), open_)
        return pd.DataFrame(made)

    sent = one.select("g", "n", "head").mapInArrow(send, "bucket int, blob binary")
    return sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInPandas(match, "h long, g long, n long, a long, na long")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(g, x) of (row, t): all shingles of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t) for t in batch.column(1).to_pylist()])], names=["g", "x"])

    return texts.select("row", "t").mapInArrow(run, "g long, x array<long>")


def sketch(x: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the hashes end in i. Two sets differ in at least as many elements as their sketches in bits.

    There are as many bits as elements, up to the next power of two, within SKETCH.
    A longer sketch folds to a shorter one: its halves are XORed.
    """
    bits = min(max(SKETCH[0], 1 << max(0, len(x) - 1).bit_length()), SKETCH[1])
    return np.packbits(np.bincount(x & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def packed_sketches(x: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Each sketch's width in bytes and its place among those of its width, and the sketches by width."""
    width = np.array([len(y) for y in x], np.int64)
    place = np.empty(len(x), np.int64)
    packed = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        packed[w] = np.frombuffer(b"".join(x[k] for k in at.tolist()), np.uint64).reshape(-1, w // 8)
    return width, place, packed


def near_sketches(sketches: tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows i and j, pair by pair, may be similar by their packed sketches and sizes n: similar sets differ in a ninth of both sizes at most, and sketches in no more."""
    width, place, packed = sketches
    i, j = np.where(width[i] <= width[j], i, j), np.where(width[i] <= width[j], j, i)
    near = np.zeros(len(i), bool)
    for w in packed:
        for v in (w, 2 * w):  # similar sets have sketches of equal or neighbouring lengths
            at = np.flatnonzero((width[i] == w) & (width[j] == v))
            for start in range(0, len(at), max(1, SENT // v)):
                k = at[start : start + max(1, SENT // v)]
                y = packed[v][place[j[k]]]
                y = y if v == w else y[:, : w // 8] ^ y[:, w // 8 :]
                differ = np.bitwise_count(packed[w][place[i[k]]] ^ y).sum(axis=1, dtype=np.int64)
                near[k] = (10 + TENTHS) * differ <= (10 - TENTHS) * (n[i[k]] + n[j[k]])
    return near


def _enough(shared: Column) -> Column:
    """Whether sets of na and nb shingles that share so many have the least similarity: t / (1 + t) of na + nb are needed."""
    return (10 + TENTHS) * shared >= TENTHS * (F.col("na") + F.col("nb"))


def _with_ends(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs with both ends' arrays (g, x) as xa, xb. Ends are met one at a time; one with many pairs is no key of a shuffle."""
    count = pairs.count()
    x, y = (arrays.select(F.col("g").alias(k), F.col("x").alias(f"x{k}")) for k in "ab")
    return lookup(lookup(pairs, x, "a", count), y, "b", count)


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct())


def _similar(pairs: DataFrame, one: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, na, nb; rows of ``texts``) whose sets are similar enough.

    Sketches (of ``one``) are compared first, which lose no similar pair, then whole sets of what is left.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            na, nb, at = batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.arange(batch.num_rows)
            near = near_sketches(packed_sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist()), np.concatenate([na, nb]), at, at + batch.num_rows)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near))

    with passing(pairs) as pairs, passing(one.join(_ends(pairs, "g"), "g", "left_semi").select("g", "x")) as sketches:
        met = _with_ends(pairs, sketches).select("a", "b", "na", "nb", "xa", "xb")
        near = cut(met.mapInArrow(close, "a long, b long, na long, nb long"))
    release(texts.sparkSession)
    with passing(_whole_sets(texts.join(_ends(near, "row"), "row", "left_semi"))) as whole:
        return cut(_with_ends(near, whole).where(_enough(F.size(F.array_intersect("xa", "xb")))).select("a", "b"))


def group_pairs(h: np.ndarray, text: np.ndarray, g: np.ndarray, n: np.ndarray, part: np.ndarray, x: list[bytes]) -> np.ndarray:
    """Rows a, b, na, nb: pairs of texts with one h that are of different components (part) and may be similar by their sizes and sketches (x), each once.

    h and text: a shingle and a text that holds it, by its place in g, n, part and x.
    """
    order = np.lexsort((g[text], h))
    h, text, sketches = h[order], text[order], packed_sketches(x)
    made = [np.empty((4, 0), np.int64)]
    for far in range(1, len(h)):
        at = np.flatnonzero(h[:-far] == h[far:])
        if not len(at):
            break
        i, j = np.divmod(np.unique(text[at] * len(g) + text[at + far]), len(g))  # texts that share a passage meet in all its shingles
        keep = (part[i] != part[j]) & (10 * np.minimum(n[i], n[j]) >= TENTHS * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        near = near_sketches(sketches, n, i, j)
        made.append(np.stack([g[i], g[j], n[i], n[j]])[:, near])
    return np.unique(np.concatenate(made, axis=1), axis=1)


def _few_pairs(held: DataFrame, one: DataFrame) -> DataFrame:
    """(a, b, na, nb) that may be similar, from shingles that FEW texts at most hold: (h, g, n, part).

    Of shingles that the same texts hold, one is enough. All shingles whose first text is the
    same are looked at in one task, which a text's sketch comes to once. What
    can't be similar makes no row, however many texts share a passage.
    """
    same = held.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("g", "n", "part"))).alias("m")).groupBy("m").agg(F.min("h").alias("h"))
    met = same.select("h", F.col("m")[0]["g"].alias("low"), F.explode("m").alias("m")).select("h", "low", "m.*")
    groups = cut(met.groupBy("low", "g", "n", "part").agg(F.collect_list("h").alias("hs")))
    count = groups.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        g, n, part, h, text = ([np.empty(0, np.int64)] for _ in range(5))
        x: list[bytes] = []
        for batch in batches:
            for made, k in ((g, 1), (n, 2), (part, 3)):
                made.append(batch.column(k).to_numpy())
            sizes = np.diff(batch.column(4).offsets.to_numpy())
            h.append(batch.column(4).flatten().to_numpy())
            text.append(np.repeat(np.arange(len(x), len(x) + batch.num_rows), sizes))
            x += batch.column(5).to_pylist()
        made = group_pairs(*(np.concatenate(c) for c in (h, text, g, n, part)), x)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["a", "b", "na", "nb"])

    with passing(one.join(cut(groups.select("g").distinct()), "g", "left_semi").select("g", "x")) as sketches:
        rows = lookup(groups, sketches, "g", count).select("low", "g", "n", "part", "hs", "x")
        return cut(rows.repartition(count // GROUPED + 1, "low").mapInArrow(run, "a long, b long, na long, nb long").distinct())


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many elements the sets below ``split`` share with those from there on; all with all if it is 0."""
    n = len(sets)
    left, right = _sides(n, split)
    flat, row = np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    use = often[column] > 1  # others are shared by none
    _, column = np.unique(column[use], return_inverse=True)
    row = row[use]
    shared = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, [start, start + SLICE])
        has = np.zeros((n, min(SLICE, int(column[-1]) + 1 - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        shared += has[left] @ has[right].T
    return shared


def _sides(n: int, split: int) -> tuple[slice, slice]:
    """Rows below ``split`` and those from there on; all and all if it is 0."""
    return (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))


def crowd_links(ids: np.ndarray, sets: list[np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the similar pairs: rows below ``split`` with those from there on; all with each other if it is 0."""
    left, right = _sides(len(sets), split)
    size = np.array([len(x) for x in sets])
    i, j = np.nonzero((10 + TENTHS) * _shared(sets, split) >= TENTHS * (size[left][:, None] + size[right][None, :]))
    i, j = i + left.start, j + right.start
    keep = i != j
    node, root = forest(ids[i[keep]], ids[j[keep]]) if keep.any() else (np.empty(0, np.int64),) * 2
    return node[node != root], root[node != root]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each sketch of a differs from each of b; a and b: a sketch of equal length in each row."""
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, a.shape[1], max(1, SLICE // 8)):
        x, y = (np.unpackbits(z[:, start : start + max(1, SLICE // 8)], axis=1).astype(np.float32) for z in (a, b))
        both += x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
    return both


def crowd_candidates(frame: pd.DataFrame, split: int) -> np.ndarray:
    """Which rows may be similar to one of another component (column part) on the other side of ``split``, by their sketches (x) and sizes (n).

    Similar sets differ in a ninth of na + nb at most, and sketches in no more. Sketches of similar sets have equal or neighbouring lengths.
    """
    n, part, rows = frame["n"].to_numpy(), frame["part"].to_numpy(), np.arange(len(frame))
    left, right = (rows[side] for side in _sides(len(frame), split))
    width = np.array([len(x) for x in frame["x"]])
    packed = {w: np.frombuffer(b"".join(frame["x"][width == w]), np.uint8).reshape(-1, w) for w in np.unique(width).tolist()}
    place = np.empty(len(frame), np.int64)  # a row's place among those of its width
    for w in packed:
        place[width == w] = np.arange(len(packed[w]))
    folded = {w: x[:, : w // 2] ^ x[:, w // 2 :] for w, x in packed.items()}
    found = np.zeros(len(frame), bool)
    for w in packed:
        for v in (w // 2, w, 2 * w):
            i, j = left[width[left] == w], right[width[right] == v]
            if v not in packed or not len(i) or not len(j):
                continue
            x, y = (folded[k] if k > min(v, w) else packed[k] for k in (w, v))
            least = (TENTHS + 10) * np.maximum(_differing(x[place[i]], y[place[j]]), np.abs(n[i][:, None] - n[j][None, :]))
            near = (least <= (10 - TENTHS) * (n[i][:, None] + n[j][None, :])) & (part[i][:, None] != part[j][None, :])
            found[i[near.any(axis=1)]] = True
            found[j[near.any(axis=0)]] = True
    return np.flatnonzero(found)


def _cells(members: DataFrame, values: DataFrame, make: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """What ``make`` gives, written, for every cell of crowds' members (crowd, g, n, part) with their values (g, ..).

    A crowd that is no chunk by itself is cut into bands of like size, of which only neighbours can be
    similar, and bands into chunks; a component (part) with CROWD members has
    chunks of its own, which are not compared with each other. A cell is two
    chunks, or one with itself. ``make`` gets its rows and how many of them are
    on the first side, 0 for a chunk with itself.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(10 / TENTHS)).cast("int")  # similar sets are one band apart at most
    large = cut(members.groupBy("crowd", "part").agg(F.count("*").alias("k")).where(F.col("k") >= CROWD).select("part", F.col("part").alias("own")).distinct())
    wide = cut(members.groupBy("crowd").agg(F.greatest(F.count("*") / CROWD, F.sum("n") / HEAVY).alias("k")).where("k > 1").select("crowd", F.lit(True).alias("wide")))
    members = members.join(large, "part", "left").join(wide, "crowd", "left")
    members = members.withColumn("block", F.struct(F.when(F.col("wide"), band).otherwise(0).alias("band"), F.coalesce("own", F.lit(-1)).alias("home"))).drop("own", "wide")
    sizes = cut(members.groupBy("crowd", "block").agg(F.ceil(F.greatest(F.count("*") / CROWD, F.sum("n") / HEAVY)).cast("int").alias("chunks")))
    placed = members.join(sizes, ["crowd", "block"]).withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks")).cast("int")).drop("chunks")
    both = sizes.join(sizes.select("crowd", F.col("block").alias("other"), F.col("chunks").alias("others")), "crowd")
    meets = (F.abs(F.col("block.band") - F.col("other.band")) <= 1) & ((F.col("block.home") != F.col("other.home")) | (F.col("block.home") == -1))
    nearby = cut(both.where(meets).groupBy("crowd", "block").agg(F.collect_list(F.struct("other", "others")).alias("near")))
    names = [c for c in values.columns if c != "g"]
    here, there = F.struct("block", "chunk"), F.struct(F.col("near.other").alias("block"), F.col("at").alias("chunk"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        forget()
        same = bool(frame["same"].iloc[0])
        frame = frame.sort_values(["side", "g"], ignore_index=True)
        split = 0 if same else int((frame["side"] == 0).sum())
        return make(frame if same or 0 < split < len(frame) else frame.iloc[:0], split)

    with passing(placed.join(nearby, ["crowd", "block"]).join(values, "g")) as dealt:
        cells = dealt.withColumn("near", F.explode("near")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("near.others") - 1)))
        cells = cells.select("crowd", F.to_json(F.least(here, there)).alias("i"), F.to_json(F.greatest(here, there)).alias("j"), (here > there).cast("int").alias("side"), (here == there).alias("same"), "g", "n", "part", *names)
        return cut(cells.groupBy("crowd", "i", "j").applyInPandas(compare, schema))


def _crowds(crowded: DataFrame, one: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that keep together what is similar among texts that share a shingle which more than FEW hold: (h, g, n, part).

    Those that hold one shingle are a crowd. Sketches, an eighth to a quarter of a byte for a
    shingle, are compared first, cell by cell; whole sets only of those texts
    that can be similar to one of another component. What leaves a task are texts
    and forests, never pairs.
    """

    def candidates(frame: pd.DataFrame, split: int) -> pd.DataFrame:
        return frame.iloc[crowd_candidates(frame, split) if len(frame) else []][["crowd", "g", "n", "part"]].astype("int64")

    def links(frame: pd.DataFrame, split: int) -> pd.DataFrame:
        a, b = crowd_links(frame["g"].to_numpy(), frame["x"].tolist(), split) if len(frame) else ((), ())
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    members = crowded.select(F.col("h").alias("crowd"), "g", "n", "part")
    with passing(one.join(cut(members.select("g").distinct()), "g", "left_semi").select("g", "x")) as sketches:
        near = cut(_cells(members, sketches, candidates, "crowd long, g long, n long, part long").distinct())
    with passing(_whole_sets(texts.join(cut(near.select(F.col("g").alias("row")).distinct()), "row", "left_semi"))) as whole:
        return _cells(near, whole, links, "a long, b long")


def _near(texts: DataFrame) -> DataFrame:
    """(row, id, component) for a written table (row, id, t); see near_duplicates."""
    with passing(_sets(texts, frequency_levels(texts))) as sets:
        rows = table(sets.select("row", "id", "key"))
        total = rows.count()
        groups = cut(rows.groupBy("key").agg(F.min("id").alias("low"), F.min("row").alias("g")))
        one = table(sets.join(groups.select("g"), F.col("row") == F.col("g")).select("g", "n", "fp", "x", "head"))
    release(texts.sparkSession)
    close = 10 * F.least("na", "nb") >= TENTHS * F.greatest("na", "nb")

    # First what fingerprints bring together, and each text against the lowest of those that hold a shingle of its head: a pair for each, not for each two.
    by_bits = cut(fingerprint_candidates(one, total))
    held = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (10 - TENTHS) // 10
    with passing(shared_heads(one, held)) as shared:
        release(texts.sparkSession)
        often = cut(shared.where("a is null").select("h", "g", "n"))
        met = cut(often.groupBy("h").agg(F.min(F.struct("g", "n")).alias("c")).select("h", F.col("c.g").alias("a"), F.col("c.n").alias("na")))
        stars = shared.where("a is not null").unionByName(lookup(often, met, "h", often.count()))
        stars = stars.where("g > a").select("a", F.col("g").alias("b"), "na", F.col("n").alias("nb")).where(close).distinct()
        links = _similar(by_bits.union(stars).distinct(), one, texts)
        release(texts.sparkSession)
        found = cut(connected_components(links))

        # Then what shares a shingle but no component yet.
        parted = table(shared.select("h", "g", "n").join(found.withColumnRenamed("node", "g"), "g", "left").select("h", "g", "n", F.coalesce("component", "g").alias("part")))
    open_ = cut(parted.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("k")).where("p <> q").select("h", "k"))
    opened = cut(parted.join(open_, "h"))
    few, crowded = (opened.where(c).select("h", "g", "n", "part") for c in (F.col("k") <= FEW, F.col("k") > FEW))
    links = links.union(_similar(_few_pairs(few, one), one, texts))
    release(texts.sparkSession)
    links = links.union(_crowds(crowded, one, texts))
    release(texts.sparkSession)
    classes = _classes(groups.select("key", "low", "g"), connected_components(links), "g", parts_for(total))
    named = cut(groups.join(classes, "g").select("key", "component"))
    return lookup(rows, named, "key", total).select("row", "id", "component")


def _numbered(docs: DataFrame, text_col: str, id_: Column) -> DataFrame:
    """(row, id, t), written: a row's number is settled once, however often it is read."""
    bound_batches(docs.sparkSession)
    return dealt(docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), utf8(text_col).alias("t")), "row", text_bytes(docs, text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) per row: smallest id reachable over texts whose shingles of WIDE words have a Jaccard similarity of 0.8 or more.

    Rows with equal sets (those without words, as null and empty texts, among
    them) are joined through the set's digest, never paired. Other texts are first compared
    with what lies within RADIUS bits of their SimHash and with one text for each
    shingle of their heads. Only what is in different
    components after that is paired if few share the shingle, and compared chunk by
    chunk if many do; sets are always compared whole.
    A very long text costs its own length. A null id keeps its row but never
    names a component unless all ids of the component are null; repeated ids
    keep their rows; an empty table gives no rows; further columns are ignored.
    """
    return _near(_numbered(docs, text_col, F.col(id_col).cast("long"))).select("id", "component")


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without near-duplicates: of each component the first row stays.

    Needs no unique ids: rows are numbered. Null and empty texts are equal to
    each other, so one of them stays. An empty table gives no rows; columns of any
    name pass through.
    """
    bound_batches(docs.sparkSession)
    row = unused(docs, "row")
    whole = dealt(docs.withColumn(row, F.monotonically_increasing_id()), row, text_bytes(docs, text_col))
    found = _near(whole.select(F.col(row).alias("row"), F.col(row).alias("id"), utf8(text_col).alias("t")))
    gone = cut(found.where("id <> component").select(F.col("row").alias(row)))
    return whole.join(gone, row, "left_anti").select(*docs.columns)
