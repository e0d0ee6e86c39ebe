"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the order of its NEAREST nearest pivots. An inverted
list of a pivot holds the vectors (of one label) that name it; vectors which
share enough pivots are candidates, and candidates are verified by their cosine
in double precision. Every vector is indexed; only the pivots come from a
sample, and their number grows with the root of the vectors'. Long lists are cut into chunks and compared chunk by chunk, so that no
task holds more than two chunks, and what leaves a task is a count for each
vector and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import bound_batches, connected_components, cut, forest, least_hashes, lookup

#: Least cosine of a link, pivots named by a vector, pivots that a candidate must share.
THRESHOLD, NEAREST, SHARED = 0.98, 10, 2
#: Pivots: twice the root of the number of vectors, within these bounds. They are the sample that the index is fitted on.
FEWEST, MOST = 64, 1 << 16
#: Cells of a matrix of cosines with the pivots.
CELLS = 1 << 22
#: Vectors of a list that a task takes at once, and rows of it in one matrix product.
CHUNK, SLICE = 2048, 256


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: str):
    """Whether a vector can link: not null, without null or non-finite components, not all zero."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def block_links(x: np.ndarray, named: np.ndarray, pivot: int, ids: np.ndarray, copies: np.ndarray, split: int, threshold: float) -> pd.DataFrame:
    """(g, add, root): linked vectors' weights summed for each vector, and its component's smallest id, in one list.

    Rows below ``split`` are compared with the rows from there on; split 0 compares
    all with each other. Of pairs in several lists only the one of their least
    shared pivot counts.
    """
    n = len(ids)
    pivots, at = np.unique(named, return_inverse=True)
    has = np.zeros((n, len(pivots)), np.float32)
    has[np.arange(n)[:, None], at.reshape(named.shape)] = 1
    lower = has * (pivots < pivot)
    add = np.zeros(n, np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    need = min(SHARED, named.shape[1])
    for i in range(0, split or n, SLICE):
        j = min(i + SLICE, split or n)
        others = split or i
        candidates = (has[i:j] @ has[others:].T >= need) & (lower[i:j] @ lower[others:].T == 0)
        if not split:
            candidates &= np.arange(i, j)[:, None] < np.arange(others, n)
        if candidates.any():
            linked = candidates & (x[i:j] @ x[others:].T >= threshold)
            add[i:j] += linked @ copies[others:]
            add[others:] += copies[i:j] @ linked
            a, b = np.nonzero(linked)
            if len(a):  # a spanning forest of the slice is enough
                node, root = forest(ids[a + i], ids[b + others])
                ends.append((node[node != root], root[node != root]))
    node, root = forest(*(np.concatenate(e) for e in zip(*ends))) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))
    found = pd.DataFrame({"g": ids, "add": add})[add > 0]
    return found.merge(pd.DataFrame({"g": node, "root": root}), on="g", how="left").fillna({"root": -1}).astype("int64")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component (smallest id reachable, itself included).

    Only rows with equal, non-null labels and vectors of equal length are compared.
    Rows whose vector is null, zero or not finite link with nothing. Equal vectors
    are indexed once and link with each other. A null id never names a component
    unless all its ids are null; repeated ids keep their rows. An empty table gives
    no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"), (usable(vector_col) & F.col(label_col).isNotNull()).alias("ok"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    good = rows.where("ok")
    groups = good.groupBy("label", "v").agg(F.min("rid").alias("g"), F.min("id").alias("low"), F.count("*").alias("copies"))
    groups = cut(groups.withColumn("dim", F.size("v")))
    total = groups.count()
    pivot_count = int(min(MOST, max(FEWEST, 2 * total**0.5)))
    sample = least_hashes(groups, pivot_count, total, "g").select("v").collect()  # at most MOST vectors
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    pivots = spark.sparkContext.broadcast({d: unit(v) for d, v in by_dim.items()})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = batch.column(0).to_pylist()
            named: list[list[int]] = [[0]] * len(vs)  # a length without pivots has one list
            dims = np.array([len(v) for v in vs])
            for d in np.unique(dims):
                p, at = pivots.value.get(int(d)), np.flatnonzero(dims == d)
                for part in np.array_split(at, -(-len(at) * len(p) // CELLS)) if p is not None else ():
                    k = min(NEAREST, len(p))
                    near = unit([vs[i] for i in part]) @ p.T
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)
                    for i, row in zip(part, best.tolist()):
                        named[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(named, pa.list_(pa.int32()))], names=["g", "named"])

    named = groups.select("v", "g").mapInArrow(name, "g long, named array<int>")
    indexed = cut(groups.select("label", "dim", "g", "copies", "v").join(named, "g"))
    lists = indexed.select("*", F.explode("named").alias("pivot"))
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cells = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks")).cast("int"))
    # Every row meets its own chunk and all others of its list: pairs (i, j) with i <= j.
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("label", "dim", "pivot", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "g", "copies", "named", "v")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        two = frame["i"].iloc[0] != frame["j"].iloc[0]
        frame = frame.sort_values(["chunk", "g"])
        split = int((frame["chunk"] == frame["i"].iloc[0]).sum()) if two else 0
        if len(frame) < 2 or split == len(frame):
            return pd.DataFrame({"g": [], "add": [], "root": []}).astype("int64")
        return block_links(unit(frame["v"].tolist()), np.array(frame["named"].tolist(), np.int64), int(frame["pivot"].iloc[0]), frame["g"].to_numpy(), frame["copies"].to_numpy(), split, threshold)

    found = cut(cells.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(compare, "g long, add long, root long"))
    links = found.groupBy("g").agg(F.sum("add").alias("links"))
    parts = connected_components(found.where("root >= 0 and root <> g").select(F.col("g").alias("a"), F.col("root").alias("b")))
    named = groups.join(links, "g", "left").join(parts, groups["g"] == parts["node"], "left").select("label", "v", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "g").alias("root"))
    named = cut(named)
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    facts = cut(lookup(named, lowest, "root", total).select(F.struct("label", "v").alias("key"), "n_links", "component"))
    single = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    count = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return lookup(good.select("id", F.struct("label", "v").alias("key")), facts, "key", count).select("id", "n_links", "component").union(single)
