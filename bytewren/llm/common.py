"""Lineage cuts, connected components and Arrow helpers shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay within these bounds, whatever the text length.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory when texts are long, and let workers find this package."""
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset: a temporary folder if driver and executors are
    one process, else a folder in the warehouse, which a cluster shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        local = spark.sparkContext.master.startswith("local")
        shared = tempfile.mkdtemp(prefix="bytewren-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bytewren_checkpoint"
        spark.sparkContext.setCheckpointDir(shared)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, for large data: a compressed Parquet table in the shared checkpoint folder, removed when Python exits."""
    return _table(df)[0]


def _table(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/bytewren-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of text in a part of a dealt table, and most parts.
PART, PARTS = 48 << 20, 50_000


def dealt(df: DataFrame, key: str, total: int) -> DataFrame:
    """As ``table``, dealt into parts by ``key`` as a bucketed table: a join by that key moves only its other side.

    total: bytes of text that ``df`` comes from. The table's name goes with its folder when Python exits.
    """
    spark = df.sparkSession
    parts = parts_of(spark, total)
    name = f"bytewren_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    atexit.register(_remove, spark, path)
    atexit.register(_unname, spark, name)
    release(spark)
    return spark.table(name)


def parts_of(spark: SparkSession, total: int) -> int:
    """Parts of a table dealt by a key, for so many bytes of text."""
    return min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART)))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(utf8(text_col)).cast("long")), F.lit(0))).first()[0]


def _unname(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")


@contextlib.contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """As ``table``, for what is read inside the block only: the folder is removed at its end.

    What the block leaves must be written before it ends, by ``cut`` or ``table``.
    """
    made, path = _table(df)
    try:
        yield made
    finally:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; the folder's owner cleans up then
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the files of shuffles that nothing refers to any more; it only notices when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: What a worker that is used again keeps for its operator from task to task: large tables that can be made again.
KEPT: dict = {}


def forget() -> None:
    """Give back the memory of what other operators' tasks have left in this worker."""
    if KEPT:
        KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a small table in one partition: fewer files for checkpoints and shuffles where there is little to do.
ROWS_IN_PART = 20_000


def parts_for(rows: int) -> int:
    """Partitions for a table of so many short rows; coalescing to more than there are changes nothing."""
    return rows // ROWS_IN_PART + 1


#: A key is frequent if it has more than this many rows and more than this share (one in) of all; so at most SHARE keys are.
FREQUENT, SHARE = 100, 1024


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` for a ``right`` with one row for each key, when few keys may hold most of left's rows.

    ``rows``: about how many left has. The rows of frequent keys stay where they
    are and meet those keys' rows of ``right``, which are broadcast: SHARE of
    them at most. Only the others are shuffled by key. Both inputs are read
    twice or more, so they should be cut off from their lineage. how: inner or left.
    """
    if rows <= FREQUENT:
        return left.join(right, key, how)
    often = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(FREQUENT, rows // SHARE)).select(key)
    often = cut(often.coalesce(1))
    if often.isEmpty():
        return left.join(right, key, how)
    often = F.broadcast(often)
    here = left.join(often, key, "left_semi").join(F.broadcast(right.join(often, key, "left_semi")), key, how)
    return here.union(left.join(often, key, "left_anti").join(right, key, how))


def least_hashes(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """The ``n`` rows with the least hash of their keys, of about ``total``.

    A threshold on the hash leaves about 2 n rows before they are sorted, so that
    what tasks hand on doesn't grow with their number.
    """
    share = min(1.0, 2.0 * n / max(total, 1))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)), *keys).limit(n)


#: Distinct words that a task holds before it hands on their counts.
HELD = 250_000


def word_counts(texts: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(word binary, c) over the column t of UTF-8 bytes; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    return texts.select("t").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` commonest words of (word, c) with their counts, the commonest first; of equal counts at the end the least hashes.

    A histogram of the counts' logarithms tells which count to go down to, so that nothing is sorted; tasks hand on about as many words as are wanted.
    """
    level = F.floor(F.log2("c") * 64)  # at most 64 levels for a doubling
    left, least, rows = most, None, []
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r["n"] > left:
            border = counts.where(level == r["level"])
            for c in sorted(border.groupBy("c").count().collect(), reverse=True):  # a level holds few different counts
                same = border.where(F.col("c") == c["c"])
                rows += (same if c["count"] <= left else least_hashes(same, left, c["count"], "word")).collect()
                left -= c["count"]
                if left <= 0:
                    break
            break
        left, least = left - r["n"], r["level"]
    if least is not None:
        rows += counts.where(level >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], tuple]], schema: str) -> DataFrame:
    """Row-wise ``mapInArrow``: ``make()`` runs once per task and returns the function for a row's values."""
    bound_batches(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = [f(row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*rows)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges, by union-find; linear in the edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = len(a)
    for x, y in zip(index[:n].tolist(), index[n:].tolist()):
        x, y = find(x), find(y)
        if x != y:  # the smaller index is the smaller node
            root[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long, not null); component is its smallest node.

    Each partition is first contracted to a spanning forest; then rounds of
    large-star and small-star run until nothing changes, each round written to
    the checkpoint folder and the one before it removed. An edge runs from its
    larger to its smaller end. A node with many edges is no key of a shuffle
    (see ``lookup``). No node list ever reaches the driver: only a row count and
    a checksum do. An empty input gives an empty result; loops and repeated
    edges change nothing.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((2, 0), np.int64)
        for batch in batches:
            kept = np.concatenate([kept, [batch.column(0).to_numpy(), batch.column(1).to_numpy()]], axis=1)
            node, low = forest(kept[0], kept[1])
            kept = np.stack([node, low])[:, node != low]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], names=["u", "v"])

    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, path = _table(pairs.mapInArrow(contract, "u long, v long").distinct())
    seen: tuple | None = None
    while (state := stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen and state[0]:
        seen = state
        parts = parts_for(state[0])
        now = stars.coalesce(parts)
        low = now.groupBy("u").agg(F.min("v").alias("m"))  # the least neighbour, if it is smaller than the node
        large = lookup(now, low.withColumnRenamed("u", "v"), "v", state[0], "left").select("u", F.coalesce("m", "v").alias("v"))
        large, between = _table(large.coalesce(parts).distinct().coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, "u", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        stars, path = _table(small.union(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
        for gone in (old, between):
            _remove(spark, gone)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
