"""Token counts per document from flat token files that hold separators but no index.

A flat file is a run of little-endian 16-bit ids in which an end-of-document id
follows every document. It is cut into blocks of equal size at any place. Each
block is searched for separators at once; a prefix scan over the blocks of a
file then gives the length that a document brings into a block and the number of
documents before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytewren.llm.bpe import codec
from bytewren.llm.common import bound_batches, table, utf8

#: Ids in a block, and documents in a file at most; the end-of-document id.
BLOCK, FILE_DOCS, EOD = 1 << 18, 20_000, 50256

STREAM = "file long, block long, ids binary, first long, docs array<long>"


def write_stream(docs: DataFrame, path: str, pattern: str, eod: int = EOD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts into flat files: rows (file, block, ids) of ``block`` ids, and rows (file, first, docs) that name
    the documents by their ordinal in the file. Null texts are empty documents. Nothing tells where a document begins."""
    bound_batches(docs.sparkSession)
    if eod > 0xFFFF:
        raise ValueError("ids have 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(path, pattern)
        if max(encoder.transducer.bytes_of) > 0xFFFF:
            raise ValueError("ids have 16 bits")
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("first", pa.int64()), ("docs", pa.list_(pa.int64()))])
        end, file, part, number, ordinal, rest = np.array([eod], "<u2").tobytes(), None, 0, 0, 0, bytearray()

        def rows(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*values), schema)], schema=schema)

        for batch in batches:
            if file is None:  # a task's first row id tells its partition
                file = batch.column(0)[0].as_py() >> 33
            done = []
            name = (file << 24) + part
            for text in batch.column(2).to_pylist():
                decimal = encoder.decimal(text.decode("utf-8", "replace"))
                rest += np.array(decimal.split(), "<u2").tobytes() if decimal else b""
                rest += end
                while len(rest) >= 2 * block:
                    done.append((name, number, bytes(rest[: 2 * block]), None, None))
                    del rest[: 2 * block]
                    number += 1
            yield rows([*done, (name, None, None, ordinal, batch.column(1).to_pylist())])
            ordinal += batch.num_rows
            if ordinal >= FILE_DOCS:
                yield rows([(name, number, bytes(rest), None, None)])
                part, number, ordinal, rest = part + 1, 0, 0, bytearray()
        if rest:
            yield rows([((file << 24) + part, number, bytes(rest), None, None)])

    return docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(run, STREAM)


def scan_blocks(stream: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, block, n, ends, last): ids in the block, lengths up to each separator since the one before (or the block's start),
    and ids after the last separator (null if there is none)."""
    bound_batches(stream.sparkSession)
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                at = np.flatnonzero(ids == eod)
                made.append((len(ids), np.diff(at, prepend=-1) - 1, len(ids) - 1 - int(at[-1]) if len(at) else None))
            n, ends, last = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(last, pa.int64())], schema=schema)

    return stream.select("file", "block", "ids").where("ids is not null").mapInArrow(run, "file long, block long, n long, ends array<long>, last long")


def lengths(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document that a separator ends, by a prefix scan over each file's blocks.

    A file has a bounded number of documents, so that no partition of the scan grows with the data.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("n").over(before), F.lit(0))
    known = blocks.withColumn("start", total)
    # Where the latest separator before the block lies, as the number of ids up to and with it.
    known = known.withColumn("since", F.coalesce(F.max(F.when(F.col("last").isNotNull(), F.col("start") + F.col("n") - F.col("last"))).over(before), F.lit(0)))
    known = known.withColumn("done", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)))
    each = known.select("file", "done", (F.col("start") - F.col("since")).alias("carry"), F.posexplode("ends").alias("i", "length"))
    return each.select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, pattern: str, eod: int = EOD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) per row: texts go to flat files in the checkpoint folder, which are scanned for separators.

    Null and empty texts have no tokens; null and repeated ids keep their rows; an
    empty table gives none. A very long text runs over as many blocks as it
    takes. Ids have 16 bits: a vocabulary with larger ones raises ValueError.
    """
    stream = table(write_stream(docs, path, pattern, eod, block, id_col, text_col))
    names = stream.where("docs is not null").select("file", "first", F.posexplode("docs").alias("i", "id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "id")
    return names.join(lengths(scan_blocks(stream, eod)), ["file", "ordinal"]).select("id", "n_tokens")
