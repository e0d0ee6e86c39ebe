"""Removal of byte strings that an earlier document holds too, by a range-partitioned sparse suffix array.

A string of MINIMUM bytes contains an anchor: the K-gram with the least hash
among those that begin in it. Equal strings have the same anchor at the same
place, so it is enough to sort the suffixes that begin at anchors, each with the
few bytes around it. Three passes over the texts:

1. K-gram hashes, spread over buckets, tell which anchors occur in two documents.
2. Those anchors' suffixes are range-partitioned by their leading bytes at
   sampled splitters. A bucket sorts its suffixes by multikey quicksort, a word
   of eight bytes at a time. Splitters fall between different K-grams, so a run
   of equal K-grams lies within one bucket and no string is compared across a
   boundary. In a run every window around the anchors is compared with the
   lowest document that has it.
3. The bytes of the windows found are cut out of each text.

Whole copies are settled beforehand by their digest. What many documents of one
task share is settled there and sent on once, so that a frequent passage doesn't
gather in one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import bound_batches, cut, dealt, least_hashes, lookup, parts_of, utf8

MINIMUM, K = 50, 24
SPAN = MINIMUM - K  # K-grams besides the first in a window; context bytes on either side of an anchor
#: Text bytes in a bucket, in a flush of a task, and in one numpy pass; groups of rows sampled for splitters.
BUCKET, FLUSH, CHUNK, SAMPLED = 12 << 20, 24 << 20, 1 << 18, 1000
#: Neighbouring rows travel as one: this many bits of the row id number a row in its group.
GROUP = 6
#: Bytes of joined texts whose windows are looked at together.
PIECE = 8 << 20
#: Bits of a hash below the bucket's that are compared; equal bits only make candidates.
HASH_BITS = 40


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number."""
    x = b.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n neighbours, in log n steps."""
    size = 1
    while 2 * size <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, text number, position in the joined bytes, K-gram hash) of all anchors of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < MINIMUM:
        return joined, *(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64)
    ends = np.cumsum(sizes)
    found = []
    for start in range(0, len(joined) - MINIMUM + 1, PIECE):  # windows that begin in the piece
        found.append(start + _positions(joined[start : start + PIECE + MINIMUM - 1], ends - start))
    at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return joined, np.searchsorted(ends, at, "right"), at, np.concatenate([_hashes(joined[i : i + PIECE + K - 1])[at[(at >= i) & (at < i + PIECE)] - i] for i in range(0, len(joined) - K + 1, PIECE)])


def _hashes(joined: np.ndarray) -> np.ndarray:
    """A hash, never 0, of the K bytes from every position on."""
    w = _words(joined)
    m = len(joined) - K + 1
    return _mix(w[:m] * np.uint64(0x9E3779B97F4A7C15) + w[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F) + w[16 : 16 + m] * np.uint64(0x165667B19E3779F9)) | np.uint64(1)


def _positions(joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a window of MINIMUM bytes, all of one text, has its least K-gram; ``ends`` are the texts' ends."""
    h = _hashes(joined)
    low = _slide(h, SPAN + 1, np.minimum)  # of the window that begins here
    for e in ends[(ends > 0) & (ends < len(joined))].tolist():  # windows across a border hold no string of a text
        low[max(0, e - MINIMUM + 1) : e] = 0
    low = np.concatenate([np.zeros(SPAN, np.uint64), low, np.zeros(SPAN, np.uint64)])
    return np.flatnonzero(_slide(low, SPAN + 1, np.maximum)[: len(h)] == h)


def _chunks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., text) in runs of about CHUNK bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _rows(group: dict, every: bool = False) -> list[tuple[int, int, bytes]]:
    """(rid, doc, text) of a group's rows, or of those that can have repeats and are no copies."""
    text, at, gone, out = zstandard.decompress(group["z"]), 0, set(group.get("gone") or ()), []
    for rid, doc, size in zip(group["rids"], group["docs"], group["sizes"]):
        if every or (doc is not None and size >= MINIMUM and rid not in gone):
            out.append((rid, doc, text[at : at + size]))
        at += size
    return out


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows of groups with about FLUSH text bytes, and the blobs that came with those groups."""
    rows, blobs, size = [], [], 0
    for batch in batches:
        for group in batch.to_pylist():
            more = _rows(group)
            rows += more
            blobs += group.get("blobs") or ()
            size += sum(len(r[2]) for r in more)
            if size >= FLUSH:
                yield rows, blobs
                rows, blobs, size = [], [], 0
    if rows:
        yield rows, blobs


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])


def _by_group(rows: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    """A frame (g, blob) with one blob for each group of rows: row ids and the values at them."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], [v[order] for v in values]
    starts = _runs(rows >> GROUP)
    return pd.DataFrame({"g": rows[starts] >> GROUP, "blob": [_pack(rows[a:b], *(v[a:b] for v in values)) for a, b in zip(starts, [*starts[1:], len(rows)])]})


def _concat(blobs: list[bytes], kinds: tuple[type, ...]) -> list[np.ndarray]:
    parts = [_unpack(x) for x in blobs]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, k) for k in kinds]


def _keys(h: np.ndarray) -> np.ndarray:
    """The least hashes of windows lie close together; this spreads them evenly."""
    return h * np.uint64(0xD6E8FEB86659FD93)


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8])


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : HASH_BITS // 8] = x
    return out.view("<u8").ravel()


def shared_hashes(packed: DataFrame, bits: int, parts: int) -> DataFrame:
    """(g, blobs): keys of anchors that occur in two rows, by row; sent to 2 ** bits buckets by their leading bits."""
    down = np.uint64(max(0, 64 - bits - HASH_BITS))
    inside = np.uint64((1 << HASH_BITS) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _flushes(batches):
            rids, keys = [], []
            for part in _chunks(rows):
                _, text, _, h = anchors([r[-1] for r in part])
                rids.append(np.array([r[0] for r in part], np.int64)[text])
                keys.append(_keys(h) >> down)
            rid, key = np.concatenate(rids), np.concatenate(keys)
            order = np.argsort(key, kind="stable")  # rows come in the order of their ids
            rid, key = rid[order], key[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])])[: len(key)]
            rid, key = rid[new], key[new]
            starts = _runs(key)
            count = np.diff(np.append(starts, len(key)))
            here = np.repeat(count > 1, count)  # shared within this flush: settled here, told to the others
            many = key[starts[count > 1]]
            high = np.uint64(64 - bits) - down
            edges = np.arange(1, 1 << bits).astype(np.uint64) << high
            sides = []
            for kept in (key[~here], many, key[here]):
                at = np.concatenate([[0], np.searchsorted(kept, edges), [len(kept)]])
                sides.append(list(zip(at, at[1:])))
            one_rid, own_rid, one, own = rid[~here], rid[here], key[~here], key[here]
            out = []
            for b, ((a1, b1), (a2, b2), (a3, b3)) in enumerate(zip(*sides)):
                if b1 > a1 or b3 > a3:
                    k = np.argsort(one_rid[a1:b1], kind="stable")  # for the packing's sake
                    j = np.argsort(own_rid[a3:b3], kind="stable")
                    out.append((b, _pack(one_rid[a1:b1][k], _five(one[a1:b1][k] & inside), _five(many[a2:b2] & inside), own_rid[a3:b3][j], _five(own[a3:b3][j] & inside))))
            yield _blobs(out)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        rid, key, many, own_rid, own = _concat(list(frame["blob"]), ())
        key, many, own = _eight(key), _eight(many), _eight(own)
        order = np.argsort(key, kind="stable")
        rid, key = rid[order], key[order]
        starts = _runs(key)
        count = np.diff(np.append(starts, len(key)))
        found = np.repeat(count > 1, count) | np.isin(key, np.unique(many))
        bucket = np.uint64(frame["bucket"].iloc[0]) << np.uint64(HASH_BITS)
        return _by_group(np.concatenate([rid[found], own_rid]), np.concatenate([key[found], own]) | bucket)

    return _answers(packed.mapInArrow(send, "bucket int, blob binary"), 1 << bits, match, parts)


def _answers(sent: DataFrame, buckets: int, match, parts: int) -> DataFrame:
    """Each bucket's answers by group of rows. Tasks grow in number with the buckets, and the answers lie as the texts do."""
    matched = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(match, "g long, blob binary")
    return matched.repartition(parts, "g").groupBy("g").agg(F.collect_list("blob").alias("blobs"))


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words by multikey quicksort: sort by one word, then each run of ties by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])[: len(order)]
    for j in range(1, words.shape[1]):
        run = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)[: len(tied)]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rows = order[at]
        k = np.lexsort((words[rows, j], run[at]))
        order[at] = rows[k]
        same = np.concatenate([[False], words[order[1:], j] == words[order[:-1], j]])[: len(order)]
        tied &= same
    return order


def _as_words(text: np.ndarray) -> np.ndarray:
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    return padded.view(">u8").astype(np.uint64)


def repeated_windows(doc: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Bit o of an anchor's mask: the MINIMUM bytes that begin o before it also stand at an anchor of a lower document.

    left: SPAN bytes before, right: MINIMUM bytes from the anchor on, both zero where the text ends; n_*: bytes that are text.
    """
    n = len(doc)
    mask = np.zeros(n, np.uint32)
    if n < 2:
        return mask
    words = _as_words(right)
    order = multikey_order(words)
    gram = K // 8
    starts = _runs(words[order][:, :gram].view(f"V{8 * gram}").ravel()) if n else np.empty(0, np.int64)
    run = np.empty(n, np.int64)
    run[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    # Hashes of the first j bytes after the K-gram and of the last j before it.
    after = np.empty((SPAN + 1, n), np.uint64)
    before = np.empty((SPAN + 1, n), np.uint64)
    after[0], before[0] = _mix(run.astype(np.uint64) + np.uint64(1)), 7
    for j in range(SPAN):
        after[j + 1] = _mix(after[j] * np.uint64(0x9E3779B97F4A7C15) + right[:, K + j] + np.uint64(1))
        before[j + 1] = _mix(before[j] * np.uint64(0xC2B2AE3D27D4EB4F) + left[:, SPAN - 1 - j] + np.uint64(1))
    both = np.concatenate([left, right], axis=1)
    for o in range(SPAN + 1):
        at = np.flatnonzero((n_left >= o) & (n_right >= MINIMUM - o))
        if len(at) < 2:
            continue
        key = after[SPAN - o, at] + _mix(before[o, at])
        k = np.argsort(key, kind="stable")
        at, key = at[k], key[k]
        starts = _runs(key)
        count = np.diff(np.append(starts, len(key)))
        if count.max() < 2:
            continue
        many = np.repeat(count > 1, count)
        at, starts = at[many], _runs(key[many])
        count = np.diff(np.append(starts, len(at)))
        lowest = np.minimum.reduceat(doc[at], starts)
        first = np.full(len(starts), n)  # an anchor of the lowest document in each run
        owner = np.repeat(np.arange(len(starts)), count)
        is_low = np.flatnonzero(doc[at] == lowest[owner])
        np.minimum.at(first, owner[is_low], at[is_low])
        later = doc[at] > lowest[owner]
        at, model = at[later], first[owner[later]]
        if len(at):
            equal = (both[at, SPAN - o : SPAN - o + MINIMUM] == both[model, SPAN - o : SPAN - o + MINIMUM]).all(axis=1)
            mask[at[equal]] |= np.uint32(1 << o)
    return mask


def covered(packed: DataFrame, hashes: DataFrame, splitters: np.ndarray, bits: int, parts: int) -> DataFrame:
    """(g, blobs) of row ids, positions and masks for anchors with windows to remove, from the keys that rows share."""
    buckets = len(splitters) + 1
    down = np.uint64(max(0, 64 - bits - HASH_BITS))
    column, offsets = np.arange(SPAN + MINIMUM), np.arange(SPAN + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blobs in _flushes(batches):
            # A row's keys by one hash of both; an accidental hit only makes a candidate.
            want = np.unique(_mix(_with_row(*_concat(blobs, (np.int64, np.uint64)))))
            made = []
            for part in _chunks(rows):
                joined, text, at, h = anchors([r[-1] for r in part])
                doc, rid = np.array([r[1] for r in part], np.int64), np.array([r[0] for r in part], np.int64)
                mine = _mix(_with_row(rid[text], _keys(h) >> down))
                near = np.minimum(np.searchsorted(want, mine), max(0, len(want) - 1))
                keep = want[near] == mine if len(want) else np.zeros(len(mine), bool)
                text, at = text[keep], at[keep]
                begin = np.concatenate([[0], np.cumsum([len(r[-1]) for r in part])])
                padded = np.concatenate([np.zeros(SPAN, np.uint8), joined, np.zeros(MINIMUM, np.uint8)])
                both = np.lib.stride_tricks.sliding_window_view(padded, SPAN + MINIMUM)[at]
                n_left = np.minimum(at - begin[text], SPAN)
                n_right = np.minimum(begin[text + 1] - at, MINIMUM)
                edge = np.flatnonzero((n_left < SPAN) | (n_right < MINIMUM))
                both[edge] = np.where((column >= SPAN - n_left[edge, None]) & (column < SPAN + n_right[edge, None]), both[edge], 0)
                made.append((rid[text], doc[text], at - begin[text], n_left.astype(np.uint8), n_right.astype(np.uint8), both))
            rid, doc, pos, n_left, n_right, both = (np.concatenate(x) for x in zip(*made))
            # Of equal surroundings only those of the lowest document go on: what is around the others is repeated for certain.
            words = np.concatenate([_as_words(both), (n_left.astype(np.uint64) * 64 + n_right)[:, None]], axis=1)
            order = multikey_order(words)
            starts = _runs(np.ascontiguousarray(words[order]).view(f"V{8 * words.shape[1]}").ravel())
            on = np.ones(len(doc), bool)
            if len(doc):
                on[order] = doc[order] == np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(doc))))
            to = np.searchsorted(splitters, np.ascontiguousarray(both[:, SPAN : SPAN + K]).view(f"S{K}").ravel(), "right") if len(doc) else np.empty(0, np.int64)
            out = []
            order = np.argsort(to, kind="stable")
            limits = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in range(buckets):
                k = order[limits[b] : limits[b + 1]]
                if len(k):
                    go, stay = k[on[k]], k[~on[k]]
                    full = (((n_left[stay, None] >= offsets) & (n_right[stay, None] >= MINIMUM - offsets)) << offsets).sum(axis=1).astype(np.uint32)
                    out.append((b, _pack(rid[go], doc[go], pos[go], n_left[go], n_right[go], both[go], rid[stay], pos[stay], full)))
            yield _blobs(out)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        rid, doc, pos, n_left, n_right, both, own_rid, own_pos, own_mask = _concat(list(frame["blob"]), ())
        mask = repeated_windows(doc, both[:, :SPAN], both[:, SPAN:], n_left, n_right)
        found = mask > 0
        return _by_group(np.concatenate([rid[found], own_rid]), np.concatenate([pos[found], own_pos]), np.concatenate([mask[found], own_mask]))

    return _answers(packed.join(hashes, "g").mapInArrow(send, "bucket int, blob binary"), buckets, match, parts)


def _with_row(rid: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key ^ (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def keep_mask(size: int, pos: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes stay, given anchors' positions and masks of windows to remove."""
    start = np.concatenate([pos[(mask >> np.uint32(o)) & np.uint32(1) > 0] - o for o in range(SPAN + 1)])
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + MINIMUM, minlength=size + 1)
    return np.cumsum(edge)[:size] == 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: binary).

    Null texts are empty. A row with a null id is never smaller than another and
    keeps its text. Rows with equal ids don't remove each other's bytes. An empty
    table gives no rows; further columns are ignored. A very long text is looked
    at in pieces but lies whole in one task.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *(pa.list_(pa.int64()),) * 3, pa.list_(pa.binary()), pa.binary())
        group: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rids, ids, texts = zip(*group)
            row = (rids[0] >> GROUP, rids, ids, [len(t) for t in texts], [hashlib.sha256(t).digest() for t in texts], zstandard.compress(b"".join(texts), 3))
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["g", "rids", "docs", "sizes", "shas", "z"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] >> GROUP != row[0] >> GROUP:
                    yield flush()
                group.append(row)
        if group:
            yield flush()

    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("t"))
    # Rows are numbered here and nowhere else; all that follows reads what is written.
    # They stay dealt by group, as a bucketed table: later joins move only their other side.
    total, count = docs.agg(F.coalesce(F.sum(F.octet_length(utf8(text_col)).cast("long")), F.lit(0)), F.count("*")).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET))
    bits = (buckets - 1).bit_length()
    parts = parts_of(spark, total)
    grouped = source.mapInArrow(shrink, "g long, rids array<long>, docs array<long>, sizes array<long>, shas array<binary>, z binary")
    numbered = dealt(grouped, "g", total)
    rows = numbered.select(F.explode(F.arrays_zip(F.col("rids").alias("rid"), F.col("docs").alias("doc"), F.col("sizes").alias("size"), F.col("shas").alias("sha"))).alias("x")).select("x.*")
    lowest = cut(rows.where("doc is not null").groupBy("sha").agg(F.min("doc").alias("lowest")))
    flagged = lookup(rows, lowest, "sha", count, "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("lowest"), F.lit(False)))
    flagged = cut(flagged)
    copied = flagged.where(f"copy and size >= {MINIMUM}").groupBy(F.shiftright("rid", GROUP).alias("g")).agg(F.collect_list("rid").alias("gone"))
    packed = numbered.drop("shas").join(cut(copied.repartition(parts, "g")), "g", "left")
    hashes = shared_hashes(packed, bits, parts)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for group in batch.to_pylist():
                joined, _, at, _ = anchors([r[-1] for r in _rows(group)])
                grams += [joined[a : a + K].tobytes() for a in at[:: max(1, len(at) // 200)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary())], names=["gram"])

    sample = packed.join(F.broadcast(least_hashes(packed.select("g"), SAMPLED, count >> GROUP, "g")), "g", "left_semi").mapInArrow(leading, "gram binary").toPandas()
    grams = np.sort(np.array([bytes(g) for g in sample["gram"]], f"S{K}"))
    splitters = np.unique(grams[(np.arange(1, buckets) * len(grams)) // buckets]) if len(grams) else grams
    found = covered(packed, hashes, splitters, bits, parts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for group in batch.to_pylist():
                rids, pos, mask = _concat(group["blobs"], ())
                order = np.argsort(rids, kind="stable")
                rids, pos, mask = rids[order], pos[order], mask[order]
                texts = {r[0]: r[2] for r in _rows(group)}
                starts = _runs(rids)
                for a, b in zip(starts, [*starts[1:], len(rids)]):
                    text = np.frombuffer(texts[int(rids[a])], np.uint8)
                    stays = keep_mask(len(text), pos[a:b], mask[a:b])
                    kept = text[stays].tobytes()
                    spans = int((~stays[:1]).sum() + np.count_nonzero(stays[:-1] & ~stays[1:]))
                    made.append((int(rids[a]), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * 5, kinds)], names=["rid", "removed", "spans", "kept_sha", "kept"])

    cleaned = packed.join(found, "g").mapInArrow(finish, "rid long, removed long, spans long, kept_sha string, kept binary")
    whole = F.col("copy") & (F.col("size") >= MINIMUM)
    out = flagged.join(cleaned, "rid", "left").select(
        "rid",
        F.col("doc").alias("id"),
        F.col("size").alias("n_bytes"),
        F.when(whole, F.col("size")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )
    if not with_text:
        return out.drop("rid", "kept")

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(r[0], r[2]) for group in batch.to_pylist() for r in _rows(group, every=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in made], pa.int64()), pa.array([t for _, t in made], pa.binary())], names=["rid", "t"])

    texts = numbered.mapInArrow(whole_texts, "rid long, t binary")
    return out.join(texts, "rid", "left").withColumn("kept", F.coalesce("kept", "t")).drop("rid", "t")
