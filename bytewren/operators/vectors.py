"""Statistics over tables of vectors: norms, centroids, dispersion, products, embedding surgery.

Centroids and query vectors are single rows, so broadcasting them is bounded by
the width of a vector whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewren.functions import vectors as v

#: Rows with ids below stand for single bytes (fixed value).
BYTE_ROWS = 256


def centroids(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(*keys, centroid): elementwise mean. Rows become (dimension, value), are pre-aggregated in each task, and 1 row per dimension is gathered."""
    each = df.select(*keys, F.posexplode(v.doubles(vector)).alias("i", "x"))
    means = each.groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(*keys, median): the element at n div 2 of the sorted values, which must not be negative or null.

    Counts by the value's logarithm tell in which fine bucket it lies; only that
    bucket's values are counted one by one. Nothing gathers a key's values.
    """
    bucket = F.floor(F.log2(F.col(value) + F.lit(2.0**-60)) * 4096)
    rows = df.select(*keys, F.col(value).alias("_v"), bucket.alias("_b"))
    by = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    summed = by.withColumn("_c", F.sum("_n").over(upto)).withColumn("_t", F.sum("_n").over(Window.partitionBy(*keys)))
    rank = F.floor(F.col("_t") / 2)
    border = summed.where((F.col("_c") > rank) & (F.col("_c") - F.col("_n") <= rank)).select(*keys, "_b", (rank - (F.col("_c") - F.col("_n"))).alias("_r"))
    values = rows.join(border, [*keys, "_b"]).groupBy(*keys, "_r", "_v").agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = values.withColumn("_c", F.sum("_m").over(upto)).where((F.col("_c") > F.col("_r")) & (F.col("_c") - F.col("_m") <= F.col("_r")))
    return at.select(*keys, F.col("_v").alias("median"))


def norm_stats(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(*keys, n, mean_norm, median_norm, min_norm, max_norm); the median is the upper one."""
    norms = df.select(*keys, v.norm(v.doubles(vector)).alias("n"))
    summed = norms.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg("n").alias("mean_norm"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"))
    middle = upper_median(norms, "n", *keys)
    both = summed.join(middle, [*keys]) if keys else with_row(summed, middle)
    return both.select(*keys, F.col("rows").alias("n"), "mean_norm", F.col("median").alias("median_norm"), "min_norm", "max_norm")


def dispersion(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(*keys, dispersion): mean squared distance to the centroid, in a second pass, so that far-off centroids cancel nothing."""
    middle = centroids(df, vector, *keys)
    rows = df.select(*keys, v.doubles(vector).alias("_x"))
    both = rows.join(middle, [*keys]) if keys else with_row(rows, middle)
    away = v.let(v.sub(F.col("_x"), F.col("centroid")), lambda d: v.dot(d, d))
    return both.groupBy(*keys).agg(F.avg(away).alias("dispersion"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row of ``df`` beside the only row of ``one``."""
    return df.join(F.broadcast(one.limit(1)))


def surgery(df: DataFrame, id_col: str, vector: str, method: str, share: float = 0.3, scale: float = 1.5) -> DataFrame:
    """(id, vector) with the rows below BYTE_ROWS changed; the others as they are.

    norm: to the upper median norm of the other rows. center: ``share`` of the way
    to the mean of all rows. spread: ``scale`` times as far from the byte rows' mean.
    analyze: unchanged.
    """
    x = v.doubles(vector)
    rows = df.select(F.col(id_col).alias("id"), x.alias("x"))
    low = F.col("id") < BYTE_ROWS
    if method == "norm":
        both = with_row(rows, norm_stats(rows.where(~low), "x").select("median_norm"))
        new = v.let(v.norm(F.col("x")), lambda n: F.transform("x", lambda y: F.when(n > 1e-8, y * (F.col("median_norm") / n)).otherwise(y)))
    elif method == "center":
        both = with_row(rows, centroids(rows, "x"))
        new = v.blend(F.col("x"), F.col("centroid"), share)
    elif method == "spread":
        both = with_row(rows, centroids(rows.where(low), "x"))
        new = F.zip_with("x", "centroid", lambda y, c: c + scale * (y - c))
    else:
        return rows.withColumnRenamed("x", "vector")
    return both.select("id", F.when(low, new).otherwise(F.col("x")).alias("vector"))


def matvec(df: DataFrame, id_col: str, vector: str, one: DataFrame) -> DataFrame:
    """(id, y): product of the table as a matrix, a row each, with the one vector of ``one`` (column w)."""
    return with_row(df, one).select(F.col(id_col).alias("id"), v.dot(v.doubles(vector), F.col("w")).alias("y"))


def gram(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, y): the table's transpose times the table; a product for each batch of rows, then a sum of width x width cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n)), pa.array(total.ravel())], names=["i", "j", "y"])

    parts = df.select(v.doubles(vector).alias("x")).where("x is not null").mapInArrow(run, "i int, j int, y double")
    return parts.groupBy("i", "j").agg(F.sum("y").alias("y"))


def best_level(quality_: DataFrame, width: int) -> DataFrame:
    """(best): of the levels that pass, the one with the highest root of its saving in memory; f32 if none does. Times are not measured."""
    ratio = lambda level: (4 * width / storage_bytes(F.lit(1), width, level)) ** 0.5
    score = F.when(F.col("level") == "q8", ratio("q8")).otherwise(ratio("q4"))
    return quality_.agg(F.coalesce(F.max_by(F.when(F.col("passes"), F.col("level")), F.when(F.col("passes"), score)), F.lit("f32")).alias("best"))


def test_vector(df: DataFrame, id_col: str, vector: str, width: int) -> DataFrame:
    """(w): element c of row c, scaled to a largest magnitude of 1; ids count rows from 0."""
    picked = df.where(F.col(id_col) < width).select(F.col(id_col).cast("int").alias("c"), F.get(v.doubles(vector), F.col(id_col).cast("int")).alias("x"))
    row = picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("w"))
    return row.select(v.let(F.greatest(F.array_max(F.transform("w", F.abs)), F.lit(1e-8)), lambda most: F.transform("w", lambda x: x / most)).alias("w"))


def quantized_products(df: DataFrame, id_col: str, vector: str, one: DataFrame) -> DataFrame:
    """(id, exact, q8, q4) products of each row with w under each form of storage."""
    both = with_row(df.select(F.col(id_col).alias("id"), v.doubles(vector).alias("x")), one)
    x, w = F.col("x"), F.col("w")
    s8, s4, sw = v.scale_of(x, v.Q8_STEPS), v.scale_of(x, v.Q4_STEPS), v.scale_of(w, v.Q8_STEPS)
    return both.select("id", v.dot(x, w).alias("exact"), v.q_dot(v.q8(x), s8, v.q8(w), sw).alias("q8"), v.q_dot(v.q4(x), s4, v.q8(w), sw).alias("q4"))


def quality(products: DataFrame) -> DataFrame:
    """(level, max_abs, mean_rel, passes): errors against the exact products, and whether both are small enough."""
    each = products.select(F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.abs(F.col("exact") - F.col(n)).alias("e"), F.greatest(F.abs("exact"), F.lit(1e-8)).alias("d")) for n in ("q8", "q4")))).alias("x")).select("x.*")
    errors = each.groupBy("level").agg(F.max("e").alias("max_abs"), F.avg(F.col("e") / F.col("d")).alias("mean_rel"))
    return errors.withColumn("passes", (F.col("max_abs") < 0.5) & (F.col("mean_rel") < 0.05))


def storage_bytes(rows: Column, width: int, level: str) -> Column:
    if level == "q8":
        return rows * (width + 4)
    return rows * (width // 2 + 4 * -(-width // v.Q4_GROUP)) if level == "q4" else rows * width * 4
