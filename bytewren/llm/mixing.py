"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

A source's target is met by whole copies of the source plus a part whose
documents have a hash below a threshold. The threshold comes from sums of words
by source and leading hash bits; only the bucket in which the budget runs out is
refined by further bits. What the first threshold leaves over is given to
documents that still fit, in the same way (nested budgets). Nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import cut

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Hash bits in all, bits looked at in one pass, and budgets nested in each other.
BITS, STEP, ROUNDS = 60, 12, 3

WORD = r"[^\x20\x09-\x0D]+"


def words(column: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(column: str) -> Column:
    """A repeatable 60-bit hash of an id, the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> dict[str | None, float]:
    """Words that each source should give: shares of the total by weight, at most MOST times its size, the excess dealt again."""
    order = sorted((x for x in sizes if x[0] is not None), key=lambda x: x[0]) + [x for x in sizes if x[0] is None]
    weighed = [(name, size, weights[i % len(weights)]) for i, (name, size) in enumerate(order)]
    total = share * sum(size for _, size, _ in weighed)
    capped, rest, level = 0, sum(w for _, _, w in weighed), 0.0
    for _, size, w in sorted(weighed, key=lambda x: MOST * x[1] / x[2]):
        level = (total - capped) / rest
        if level <= MOST * size / w:
            break
        capped, rest = capped + MOST * size, rest - w
    return {name: min(float(MOST * size), level * w) for name, size, w in weighed}


def by_source(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row per source; broadcast while their number is small, else left to the optimizer."""
    made = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= 50_000 else made


def thresholds(rows: DataFrame, budgets: dict[str | None, int]) -> dict[str | None, tuple[int, int]]:
    """By source (limit, words): the words of rows with h < limit sum up to at most the budget, and the next hash would exceed it.

    ``rows`` has src, size, h. Each pass sums words by source and bucket inside the
    boundary bucket of the pass before, and brings one row per source to the driver.
    """
    found = {}
    open_ = {s: (0, 0) for s, b in budgets.items()}  # source -> hash prefix, words below it
    for depth in range(STEP, BITS + 1, STEP):
        if not open_:
            break
        width = BITS - depth
        now = by_source(rows, [(s, p, budgets[s] - below) for s, (p, below) in open_.items()], "s string, prefix long, room long")
        part = rows.join(now, rows["src"].eqNullSafe(now["s"]) & (F.shiftright("h", width + STEP) == now["prefix"]))
        sums = part.groupBy("src", F.shiftright("h", width).alias("bucket")).agg(F.sum("size").alias("n"), F.first("room").alias("room"))
        start = F.struct(F.lit(False).alias("over"), F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("at"))

        def step(acc: Column, x: Column) -> Column:
            beyond = F.struct(F.lit(True).alias("over"), acc["sum"].alias("sum"), x["bucket"].alias("at"))
            within = F.struct(F.lit(False).alias("over"), (acc["sum"] + x["n"]).alias("sum"), acc["at"].alias("at"))
            return F.when(acc["over"], acc).when(acc["sum"] + x["n"] > F.col("room"), beyond).otherwise(within)

        by = F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("by")  # at most 2^STEP buckets of a source
        ends = sums.groupBy("src").agg(by, F.first("room").alias("room")).select("src", F.aggregate("by", start, step).alias("w"))
        got = {r["src"]: r["w"] for r in ends.collect()}
        nxt = {}
        for s, (prefix, below) in open_.items():
            w = got.get(s)
            if w is None or not w["over"]:  # all of it fits
                found[s] = ((prefix + 1) << (width + STEP), below + (w["sum"] if w else 0))
            elif width == 0:
                found[s] = (w["at"], below + w["sum"])
            else:
                nxt[s] = (w["at"], below + w["sum"])
        open_ = nxt
    return found


def plan(sized: DataFrame) -> DataFrame:
    """One row per source: s, source_size, target, whole (copies of every document), limits (of the hash, by largest size).

    ``sized`` has src, size, h and should be cut off from its lineage. One row
    per source reaches the driver: weights are set source by source, so their
    number is that of a configuration, not of the data.
    """
    totals = {r["src"]: r["n"] for r in sized.groupBy("src").agg(F.sum("size").alias("n")).collect()}
    goal = targets(list(totals.items()))
    whole = {s: int(goal[s] // n) if n else 0 for s, n in totals.items()}
    left = {s: int(goal[s] - whole[s] * n) for s, n in totals.items()}
    limits: dict[str | None, list[tuple[int, int]]] = {s: [] for s in totals}
    rest = sized.where("size > 0").select("src", "size", "h")
    for _ in range(ROUNDS):
        budgets = {s: n for s, n in left.items() if n > 0}
        if not budgets:
            break
        room = by_source(sized, list(budgets.items()), "s string, room long")
        fits = rest.join(room, rest["src"].eqNullSafe(room["s"]) & (rest["size"] <= room["room"])).select("src", "size", "h")
        limit = thresholds(fits, budgets)
        for s, (h, n) in limit.items():
            limits[s].append((budgets[s], h))
            left[s] -= n
        used = by_source(sized, [(s, budgets[s], h) for s, (h, _) in limit.items()], "s string, room long, lim long")
        rest = rest.join(used, rest["src"].eqNullSafe(used["s"]), "left").where("room is null or not (size <= room and h < lim)").select("src", "size", "h")
    rows = [(s, totals[s], float(goal[s]), whole[s], limits[s]) for s in totals]
    return by_source(sized, rows, "s string, source_size long, target double, whole long, limits array<struct<room:long,lim:long>>")


def copies(planned: DataFrame, size: Column, h: Column) -> Column:
    """How often the mix takes a document of that size and hash."""
    extra = F.exists(planned["limits"], lambda x: (size <= x["room"]) & (h < x["lim"]))
    return planned["whole"] + extra.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, src, size, source_size, target, taken (0, 1 or 2 times its size).

    Null texts have no words and null sources form one source of their own, last
    in order. Rows with equal ids are taken together. Sizes and hashes are
    written once to the checkpoint folder; the passes read those four columns.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), words(text_col).alias("size"), hash60(id_col).alias("h")))
    planned = plan(sized)
    taken = (F.col("size") * copies(planned, F.col("size"), F.col("h"))).alias("taken")
    return sized.join(planned, sized["src"].eqNullSafe(planned["s"])).select("id", "src", "size", "source_size", "target", taken)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each row as often as it is taken. The text is not moved.

    Null texts and sources, and repeated ids, as in mix(). An empty table gives no
    rows; columns of any name pass through.
    """
    planned = plan(cut(docs.select(F.col(source_col).alias("src"), words(text_col).alias("size"), hash60(id_col).alias("h"))))
    # Columns by number, so that none of docs' own names clashes with the plan's.
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    plain = docs.toDF(*names)
    joined = plain.join(planned, plain[at[source_col]].eqNullSafe(planned["s"]))
    times = copies(planned, words(at[text_col]), hash60(at[id_col]))
    each = joined.select(*names, F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("x"))
    return each.select(*names).toDF(*docs.columns)
