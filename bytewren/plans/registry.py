"""Queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Every byte of every document: stream_id, pos, b.
BYTES = """b AS (
  SELECT stream_id, CAST(pos AS BIGINT) AS pos, CAST('0x' || h AS INTEGER) AS b FROM (
    SELECT doc_id AS stream_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs FROM documents)))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; Python workers are told where this package lies if the environment doesn't say so."""
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
