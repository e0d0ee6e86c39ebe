"""Bits-per-byte telemetry: count windows, composites over runs, gates and classifications.

A window is a run of so many records of a stream. Its number follows from the
record's position, so that windows are a plain aggregation, and the cumulative
value is a running sum over windows, not over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval(total: Column) -> Column:
    """Records in a window: a hundredth of the stream, 100 to 100,000."""
    return F.greatest(F.lit(100), F.least(F.lit(100_000), F.floor(total / 100)))


def numbered(df: DataFrame, key: str, ts: str, *order: str, width: str = "hour") -> DataFrame:
    """``df`` with pos, a record's number within its key by time and ``order``, from 0.

    Rows are sorted within an hour (or another unit of date_trunc) of their key; counts of the hours before
    give where it begins. So no task sorts all of a key.
    """
    timed = df.withColumn("_t", F.date_trunc(width, F.col(ts).cast("timestamp")))
    counts = timed.groupBy(key, "_t").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_t", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy(key, "_t").orderBy(ts, *order)) - 1
    return timed.withColumn("_i", inside).join(starts, [key, "_t"]).withColumn("pos", F.col("_s") + F.col("_i")).select(*df.columns, "pos")


def cumulative(df: DataFrame, order: str, ranges: int = 200, **sums: str) -> DataFrame:
    """``df`` with running sums of columns (column=name) by the numeric ``order``, rows inclusive.

    Ranges of ``order`` with about as many rows each are sorted each by itself; a row for each range gives where its sums begin. ``df`` is read three times.
    """
    bounds = sorted(set(df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))), F.lit(-1)) if bounds else F.lit(0)
    dealt = df.withColumn("_r", F.when(F.col(order).isNull(), -1).otherwise(part))
    before = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_r").agg(*(F.sum(c).alias(c) for c in sums))
    starts = whole.select("_r", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{c}") for c in sums))
    inside = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.select("*", *(F.sum(c).over(inside).alias(f"_i_{c}") for c in sums)).join(F.broadcast(starts), "_r")  # a row for each range
    return running.select(*df.columns, *((F.col(f"_s_{c}") + F.col(f"_i_{c}")).alias(name) for c, name in sums.items()))


def windows(df: DataFrame, key: str, pos: str, cost: str, size: int) -> DataFrame:
    """(key, window, n, bits, bpb_w, bytes, bpb): cost of each window and up to its end; the last window may be short."""
    each = df.groupBy(key, F.floor(F.col(pos) / size).alias("window")).agg(F.count("*").alias("n"), F.sum(cost).alias("bits"))
    so_far = Window.partitionBy(key).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(key, "window", "n", "bits", (F.col("bits") / F.col("n")).alias("bpb_w"), F.sum("n").over(so_far).alias("bytes"), (F.sum("bits").over(so_far) / F.sum("n").over(so_far)).alias("bpb"))


def throughput(bytes_: Column, seconds: Column) -> Column:
    return bytes_ / F.greatest(seconds, F.lit(0.001))


def bytes_per_token(bytes_: Column, tokens: Column) -> Column:
    return bytes_ / F.greatest(tokens, F.lit(1))


def bit_profile(df: DataFrame, key: str, costs: str) -> DataFrame:
    """(key, bit, mean_cost, share): mean cost of each bit of a byte and its share of all bits' cost; costs is an array."""
    each = df.select(key, F.posexplode(costs).alias("bit", "c")).groupBy(key, "bit").agg(F.avg("c").alias("mean_cost"), F.sum("c").alias("s"))
    total = Window.partitionBy(key)
    return each.select(key, "bit", "mean_cost", (F.col("s") / F.sum("s").over(total)).alias("share"))


def match_stats(df: DataFrame, key: str, length: str) -> DataFrame:
    """(key, hits, mean_len): records with a match, and their mean length; 0 without any."""
    hit = F.col(length) > 0
    return df.groupBy(key).agg(F.count_if(hit).alias("hits"), F.coalesce(F.avg(F.when(hit, F.col(length))), F.lit(0.0)).alias("mean_len"))


def composite(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(*keys, n, mean, stddev_pop, worst, best, spread): the population's deviation, as the name says."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev_pop"), F.max(x).alias("worst"), F.min(x).alias("best"), (F.max(x) - F.min(x)).alias("spread"))


def accepts(now: DataFrame, before: DataFrame, slack: float = 0.05) -> DataFrame:
    """Whether a run is no worse than the one before: mean and deviation not above, worst at most ``slack`` above. Both are single rows."""
    a, b = now.alias("a"), before.alias("b")
    ok = (F.col("a.mean") <= F.col("b.mean")) & (F.col("a.stddev_pop") <= F.col("b.stddev_pop")) & (F.col("a.worst") <= F.col("b.worst") + slack)
    return a.join(F.broadcast(b)).select(ok.alias("accepted"))


def domain(bpb: Column, bytes_per_token_: Column) -> Column:
    """Cluster A to D of a stream; the order of the branches matters."""
    return F.when(bpb < 1.0, "A").when((bpb < 1.6) & (bytes_per_token_ > 2.0), "B").when(bpb < 2.6, "C").otherwise("D")


def learning_rate(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last, rate): relative fall from a stream's first window to its last."""
    ends = df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return ends.withColumn("rate", F.when(F.col("first") != 0, (F.col("first") - F.col("last")) / F.col("first")).otherwise(F.lit(0.0)))


def convergence(windowed: Column, cumulative: Column, flat: float = 0.02, strong: float = 0.10) -> Column:
    """flat within 2 % of the cumulative value, converging below, diverging above, anti-learning over 10 % above. Our own thresholds."""
    ratio = windowed / cumulative
    return F.when(ratio > 1 + strong, "anti-learning").when(ratio > 1 + flat, "diverging").when(ratio < 1 - flat, "converging").otherwise("flat")


def contribution(df: DataFrame, key: str, mode: str, value: str, base: str, other: str) -> DataFrame:
    """(key, base, other, delta, percent): what one mode gains over the other; one pass, no self-join."""
    pick = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    both = df.groupBy(key).agg(pick(base).alias("base"), pick(other).alias("other"))
    return both.withColumn("delta", F.col("base") - F.col("other")).withColumn("percent", F.col("delta") / F.col("base") * 100)


def efficiency(bpb: Column, seconds: Column, base_bpb: Column, base_seconds: Column) -> Column:
    """Compression ratio against a base, weighed by the logarithms of the times."""
    return (8 / bpb) / (8 / base_bpb) * F.log(base_seconds) / F.log(seconds)


def clock_label(ts: Column, zone: str = "Europe/Madrid") -> Column:
    """Time of day in a zone, with its offset to UTC in hours: from the time-zone database, not from the month."""
    local = F.from_utc_timestamp(ts, zone)
    hours = ((F.unix_timestamp(local) - F.unix_timestamp(ts)) / 3600).cast("int")
    return F.format_string("%s UTC+%d", F.date_format(local, "HH:mm:ss"), hours)


def range_shares(bit_means: DataFrame, key: str) -> DataFrame:
    """(key, low, middle, high): shares of bits 0 to 2, 3 to 5 and 6 and 7 in all bits' mean cost, from bit_profile()."""
    of = lambda a, b: F.sum(F.when(F.col("bit").between(a, b), F.col("mean_cost")).otherwise(0.0)) / F.sum("mean_cost")
    return bit_means.groupBy(key).agg(of(0, 2).alias("low"), of(3, 5).alias("middle"), of(6, 7).alias("high"))


def bit_variation(df: DataFrame, key: str, costs: str) -> DataFrame:
    """(key, bit, mean_cost, cv): coefficient of variation (population) of each bit's cost over rows; costs is an array."""
    each = df.select(key, F.posexplode(costs).alias("bit", "c")).groupBy(key, "bit")
    return each.agg(F.avg("c").alias("mean_cost"), (F.stddev_pop("c") / F.avg("c")).alias("cv"))


def effectiveness(hits: Column, mean_len: Column) -> Column:
    """Hits times their mean length, in thousands of bytes."""
    return hits * mean_len / 1000


def record_json(**columns: tuple[Column, int | None]) -> Column:
    """A telemetry record as JSON, numbers rounded to the digits given; strings are escaped."""
    return F.to_json(F.struct(*((c if digits is None else F.round(c, digits)).alias(n) for n, (c, digits) in columns.items())))


def skip_stats(df: DataFrame, key: str, skipped: str, n_bytes: str) -> DataFrame:
    """(key, tokens, skipped, skipped_bytes, share): the share is of all tokens but the first."""
    s = F.col(skipped)
    out = df.groupBy(key).agg(F.count("*").alias("tokens"), F.count_if(s).alias("skipped"), F.sum(F.when(s, F.col(n_bytes)).otherwise(0)).alias("skipped_bytes"))
    return out.withColumn("share", F.col("skipped") / F.greatest(F.col("tokens") - 1, F.lit(1)))
