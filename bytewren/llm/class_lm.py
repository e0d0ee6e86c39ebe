"""Language-model scoring with Brown's class-based bigrams.

Words are put into classes by exchange: a unit moves to the class in which the
mutual information of neighbouring classes is largest. Then
P(word | word before) = P(class | class before) * P(word | class), both smoothed.
Units are all words above a count, the end of a text, and for words too rare to
have neighbours worth counting one unit for each hash of their last two bytes.

The exchange runs in two steps. The FIRST commonest words and the other units
are exchanged one by one on the driver, where their table of neighbours has a
fixed size. Then all other words are exchanged in rounds on the executors: each
goes to the class best for it, given the classes of the round before.

A rare word's share of its unit is its own count less DISCOUNT. What that leaves
goes to words never seen, which are spelt backwards from their last two bytes by
a byte bigram model of all words met. So the probabilities of all texts sum to
at most one, whatever their words.

Counts cover the whole training corpus. The number of words that are units grows
with the root of the number of distinct words, and so do what is broadcast and
what the driver gets; neighbours and the counts of all other words stay in tables.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import HELD, bound_batches, commonest, table, utf8, word_counts

#: Words exchanged on the driver, words in all by the root of the distinct ones, and how often such a word occurs at least.
FIRST, BY_ROOT, OFTEN = 1000, 8, 10
#: Suffix units, sweeps of the exchange on the driver at most, and rounds of the exchange on the executors.
SUFFIXES, SWEEPS, ROUNDS = 128, 12, 3
#: Words whose counts are broadcast, if more than there are word units.
HEAD = 32_768
#: Prior weight of a class's share in its transitions; taken off each count of a rare word for the unseen ones; prior weight in spelling.
PRIOR, DISCOUNT, SPELL = 20.0, 0.6, 10.0
#: Distinct pairs that a task holds before it hands them on, and cells of a task's table in a round.
PAIRS, CELLS = 1 << 20, 1 << 22
END_BYTE = 256


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


def classes_for(words: int) -> int:
    """Classes for so many word units."""
    return max(16, round(3 * words ** (1 / 3)))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(joint: np.ndarray, r: np.ndarray, l: np.ndarray, own: float) -> np.ndarray:
    """How much the mutual information grows if a unit is put into each class.

    joint: counts of neighbouring classes without the unit; r, l: what follows it and
    what it follows, by class and without itself; own: how often it follows itself.
    """
    rows, cols = joint.sum(1) + l, joint.sum(0) + r
    gain = (_f(joint + r) - _f(joint)).sum(1) + (_f(joint.T + l) - _f(joint.T)).sum(1)
    d = joint.diagonal()
    gain += _f(d + r + l + own) + _f(d) - _f(d + r) - _f(d + l)
    return gain - (_f(rows + r.sum() + own) - _f(rows) + _f(cols + l.sum() + own) - _f(cols))


def without(joint: np.ndarray, a: int, r: np.ndarray, l: np.ndarray, own: float) -> np.ndarray:
    """``joint`` when a unit has left class ``a``."""
    joint = joint.copy()
    joint[a] -= r
    joint[:, a] -= l
    joint[a, a] -= own
    return np.maximum(joint, 0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, from counts of neighbours (unit, next unit). Deterministic; ties go to the lowest class."""
    units = len(bigrams)
    classes = min(classes, units)
    b = bigrams.astype(np.float64)
    of = np.empty(units, np.int64)
    of[np.argsort(-(b.sum(0) + b.sum(1)), kind="stable")] = np.arange(units) % classes
    one = np.eye(classes)[of]
    after, before = b @ one, b.T @ one  # of a unit, by class of its neighbour
    joint = one.T @ after
    loops = b.diagonal()
    for _ in range(sweeps):
        moved = 0
        for u in range(units):
            a, own = of[u], loops[u]
            r, l = after[u].copy(), before[u].copy()
            r[a] -= own
            l[a] -= own
            if not (r.any() or l.any()):
                continue
            joint = without(joint, a, r, l, own)
            gain = gains(joint, r, l, own)  # neighbours' pairs with the unit count for their classes wherever it goes
            to = int(np.argmax(gain))
            if to != a and gain[to] <= gain[a] + 1e-9:
                to = a
            joint[to] += r
            joint[:, to] += l
            joint[to, to] += own
            if to != a:
                of[u] = to
                after[:, a] -= b[:, u]
                after[:, to] += b[:, u]
                before[:, a] -= b[u]
                before[:, to] += b[u]
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    """What is broadcast. Logarithms are to base 10; a rare word's own share of its unit is joined later."""

    number: dict[bytes, int]  # the commonest words
    unit: np.ndarray  # of each of them
    inside: np.ndarray  # log P(word | unit) of each
    base: np.ndarray  # log(c + 1) of each
    step: np.ndarray  # log P(class | class before)
    cls: np.ndarray  # of each unit
    emit: np.ndarray  # log P(unit | class)
    end: int  # the unit of a text's end; word units come before it, suffix units after it
    end_base: float
    unseen: np.ndarray  # log P(any word never seen | suffix unit)
    endings: dict[bytes, float]  # log P(last two bytes | suffix unit, never seen), of those met
    rare_ending: np.ndarray  # the same for any others, by suffix unit
    spell: np.ndarray  # log P(byte or END_BYTE | byte after it)
    tokens: int
    distinct: int

    def spelt(self, words: list[bytes]) -> np.ndarray:
        """log P(word | its suffix unit, never seen) of each word."""
        if not words:
            return np.empty(0)
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        before = np.concatenate([[END_BYTE], flat[:-1]]).astype(np.int64)
        before[start] = END_BYTE
        cost = self.spell[flat, before]  # of what stands before each byte
        total = np.concatenate([[0.0], np.cumsum(cost)])
        # The last two bytes come at once; a word of one byte has nothing before it.
        spelt = np.where(sizes > 1, total[start + sizes - 1] - total[start], 0.0)
        endings = self.endings
        return spelt + [endings[w[-2:]] if w[-2:] in endings else self.rare_ending[suffix(w)] for w in words]


def is_held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether the CRC-32 of the id's decimal text leaves ``fold``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def unit_pairs(texts: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """(code, n): how often a unit follows a unit, code = unit * units + next; whole texts, which begin after an end and finish with one."""
    end, units = len(own), len(own) + 1 + SUFFIXES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            code, n = _merge(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            line = [end]
            for text in batch.column(0).to_pylist():
                for w in split(text):
                    u = own.get(w)
                    if u is None:
                        u = ends.get(w[-2:])
                        if u is None:
                            u = ends[w[-2:]] = end + 1 + suffix(w)
                    line.append(u)
                line.append(end)
            code = np.array(line, np.int64)
            held.append(np.unique(code[:-1] * units + code[1:], return_counts=True))
            if sum(len(k) for k, _ in held) > PAIRS:
                yield flush()
        if held:
            yield flush()

    return table(texts.select("t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))


def group_pairs(pairs: DataFrame, of: np.ndarray) -> np.ndarray:
    """Counts of (group, next group) for the units' groups ``of``; a square of the number of groups reaches the driver."""
    units, k = len(of), int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k)
        for batch in batches:
            code = batch.column(0).to_numpy()
            counts += np.bincount(of[code // units] * k + of[code % units], batch.column(1).to_numpy(), k * k)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at].astype(np.int64))], names=["at", "n"])

    rows = pairs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(k, k)


def exchange_round(pairs: DataFrame, of: np.ndarray, joint: np.ndarray, first: int, words: int) -> np.ndarray:
    """Classes after a round in which every unit from ``first`` to ``words`` goes to its best class, the others' being as they were."""
    units, k = len(of), len(joint)
    width = 2 * k + 1
    spark = pairs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-words * width // CELLS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what follows and precedes each word, by class; a word after itself apart. Dealt by word modulo parts."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, n = _merge(held)
            held.clear()
            part = key // width % parts
            order = np.argsort(part, kind="stable")
            key, n, part = key[order], n[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            rows = [(int(part[a]), key[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["p", "k", "n"])

        for batch in batches:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            u, v = code // units, code % units
            same = u == v
            for w, column in ((u, np.where(same, 2 * k, of[v])), (v, np.where(same, -1, k + of[u]))):
                use = (w >= first) & (w < words) & (column >= 0)
                held.append((w[use] * width + column[use], n[use]))
            if sum(len(x) for x, _ in held) > PAIRS:
                yield flush()
        if held:
            yield flush()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        part = 0
        done: list[tuple[int, int]] = []

        def finish() -> None:
            for i in np.flatnonzero(sums.any(axis=1)).tolist():
                w = i * parts + part
                a, r, l, own = int(of[w]), sums[i, :k], sums[i, k : 2 * k], sums[i, 2 * k]
                gain = gains(without(joint, a, r, l, own), r, l, own)
                to = int(np.argmax(gain))
                done.append((w, to if gain[to] > gain[a] + 1e-9 else a))

        for batch in batches:
            for p, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                if sums is None or p != part:
                    if sums is not None:
                        finish()
                    sums, part = np.zeros((-(-words // parts), width)), p
                key = np.frombuffer(keys, np.int64)
                np.add.at(sums, (key // width // parts, key % width), np.frombuffer(n, np.int64))
        if sums is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in done], pa.int64()), pa.array([c for _, c in done], pa.int64())], names=["w", "c"])

    joint = joint.astype(np.float64)
    dealt = pairs.mapInArrow(project, "p int, k binary, n binary").repartition(parts, "p").sortWithinPartitions("p")
    rows = dealt.mapInArrow(best, "w long, c long").toPandas()  # a row for each word unit
    out = of.copy()
    out[rows["w"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
    return out


def cluster(pairs: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of neighbouring classes)."""
    words = len(own)
    first = min(FIRST, words)
    # On the driver all later words stand for their suffix.
    small = np.concatenate([np.arange(first), [first + 1 + suffix(w) for w in own[first:]], first + np.arange(1 + SUFFIXES)]).astype(np.int64)
    k = min(classes_for(words), first + 1 + SUFFIXES)
    known = exchange(group_pairs(pairs, small), k)
    of = known[small]
    joint = _joint(pairs, of, k)
    for _ in range(ROUNDS if words > first else 0):
        of = exchange_round(pairs, of, joint, first, words)
        joint = _joint(pairs, of, k)
    return of, joint


def _joint(pairs: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    found = group_pairs(pairs, of)
    out = np.zeros((k, k), np.int64)
    out[: len(found), : len(found)] = found
    return out


def unit_counts(pairs: DataFrame, units: int) -> np.ndarray:
    """How often each unit follows another."""
    rows = pairs.groupBy((F.col("code") % units).alias("v")).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(units)
    out[rows["v"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


@lru_cache(1)
def endings_in_units() -> np.ndarray:
    """How many strings of one or two bytes each suffix unit has."""
    found = [suffix(bytes((a, b))) for a in range(256) for b in range(256)] + [suffix(bytes((a,))) for a in range(256)]
    return np.bincount(found, minlength=SUFFIXES)


def spelling(counts: DataFrame) -> np.ndarray:
    """log P(byte before, or END_BYTE at the word's start | byte), from every word of (word, c) once."""
    size = END_BYTE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size * size, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
            before = np.concatenate([[END_BYTE], flat])[: len(flat)]
            before[np.cumsum([0, *map(len, words)])[:-1]] = END_BYTE
            seen += np.bincount(flat * size + before, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    rows = counts.select("word").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(size * size)
    seen[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    seen = seen.reshape(size, size)
    share = (seen.sum(0) + 1) / (seen.sum() + size)
    return np.log10((seen + SPELL * share) / (seen.sum(1, keepdims=True) + SPELL))


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and a table (word, c, inside, base) of the words that are not broadcast, in the checkpoint folder."""
    counts = table(word_counts(texts, split))
    n_texts = texts.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    tokens, distinct = total["n"] + n_texts, total["v"] + (n_texts > 0)
    most = max(FIRST, BY_ROOT * math.isqrt(total["v"]))
    head = commonest(counts, max(HEAD, most))
    own = [w for w, c in head[:most] if c >= OFTEN]
    number = {w: i for i, (w, _) in enumerate(head)}
    end, units = len(own), len(own) + 1 + SUFFIXES
    unit = np.array([i if i < end else end + 1 + suffix(w) for i, (w, _) in enumerate(head)], np.int64)

    # Mass, types and endings of each suffix unit; the hash runs in Spark as in suffix().
    spark = counts.sparkSession
    is_own = F.broadcast(spark.createDataFrame([(w,) for w in own], "word binary"))
    unit_of = (F.crc32(F.expr("substring(word, -2, 2)")) % SUFFIXES).cast("int")
    rows = counts.join(is_own, "word", "left_anti").groupBy(F.expr("substring(word, -2, 2)").alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # at most 65,792
    mass, types = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in rows:
        u = suffix(bytes(r["e"]))
        mass[u] += r["n"]
        types[u] += r["v"]
    unseen = np.log10(np.where(mass > 0, DISCOUNT * types / np.maximum(mass, 1), 1.0))
    other = SPELL / endings_in_units()
    endings = {bytes(r["e"]): float(np.log10((r["v"] + other[suffix(bytes(r["e"]))]) / (types[suffix(bytes(r["e"]))] + SPELL))) for r in rows}

    pairs = unit_pairs(texts, {w: i for i, w in enumerate(own)})
    cls, joint = cluster(pairs, own)
    share = (joint.sum(0) + 1) / (joint.sum() + len(joint))
    step = np.log10((joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR))
    often = unit_counts(pairs, units) + 0.5
    emit = np.log10(often / np.bincount(cls, often)[cls])
    c = np.array([n for _, n in head], np.float64)
    inside = np.where(unit <= end, 0.0, np.log10(np.maximum(c - DISCOUNT, 1e-9) / np.maximum(mass[np.maximum(unit - end - 1, 0)], 1))) if len(c) else c
    model = Model(number, unit, inside, np.log10(c + 1), step, cls, emit, end, math.log10(n_texts + 1), unseen, endings, np.log10(other / (types + SPELL)), spelling(counts), tokens, distinct)

    in_head = F.broadcast(spark.createDataFrame([(w,) for w in number], "word binary"))  # as many rows as are broadcast with the model
    per_unit = F.array(*(F.lit(float(math.log10(m)) if m else 0.0) for m in mass))
    rare = counts.join(in_head, "word", "left_anti")
    rare = rare.select("word", "c", (F.log10(F.col("c") - DISCOUNT) - F.element_at(per_unit, unit_of + 1)).alias("inside"), F.log10(F.col("c") + 1.0).alias("base"))
    return model, rare


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per row, in one pass over the texts, a join of rare words, and a sum by row.

    A word is rare if it isn't broadcast: fewer than one in HEAD tokens is any one such word, so no key of the join holds more of them.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["word", "rows", "id", "n", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number, ends = m.number, {}
        unit, inside, base, cls = m.unit.tolist(), m.inside, m.base, m.cls
        size = len(number)
        norm = math.log10(m.tokens + 1 * (m.distinct + 1))
        where: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            n, gap = len(where), lambda kind: pa.nulls(len(where), kind)
            words = list(where)
            never = m.spelt(words) + m.unseen[[suffix(w) for w in words]] if words else []  # if it was never seen
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(where.values(), pa.list_(pa.int64())), gap(pa.int64()), pa.array([0] * n, pa.int64()), gap(pa.int64()), gap(pa.float64()), pa.array(never, pa.float64())], names=names)
            where.clear()
            return made

        for batch in batches:
            rows, done = batch.column(0).to_pylist(), []
            for row, doc, text in zip(rows, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                line, local, rest = [m.end], [], 0
                for w in split(text):
                    i = number.get(w)
                    if i is not None:
                        local.append(i)
                        line.append(unit[i])
                        continue
                    u = ends.get(w[-2:])
                    if u is None:
                        u = ends[w[-2:]] = m.end + 1 + suffix(w)
                    line.append(u)
                    where.setdefault(w, []).append(row)
                    rest += 1
                line.append(m.end)
                units, at = np.array(line), np.array(local, np.int64)
                c = cls[units]
                lm = m.step[c[:-1], c[1:]].sum() + m.emit[units[1:]].sum() + (inside[at].sum() if size else 0.0)
                plain = (base[at].sum() if size else 0.0) + m.end_base - norm * (len(line) - 1)
                done.append((b" %d" % row, [row], doc, len(line) - 1, len(local) + (m.end_base > 0), plain, lm))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done), kinds)], names=names)
            if len(where) > HELD:
                yield flush()
        yield flush()

    # A word's row lists the texts in which it stands, once for each time; a text's own row has a key that no word can have.
    found = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(run, "word binary, rows array<long>, id long, n long, known long, base double, score double")
    joined = found.join(rare.withColumnRenamed("base", "w_base").withColumnRenamed("inside", "w_in"), "word", "left")
    own = F.col("base").isNotNull()  # a text's own row
    each = joined.select(
        F.explode("rows").alias("row"),
        "id",
        "n",
        F.when(own, F.col("known")).otherwise(F.col("c").isNotNull().cast("long")).alias("known"),
        F.when(own, F.col("base")).otherwise(F.coalesce("w_base", F.lit(0.0))).alias("base"),
        F.when(own, F.col("score")).otherwise(F.coalesce("w_in", "score")).alias("score"),
    )
    summed = each.groupBy("row").agg(F.max("id").alias("id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.drop("row")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Null texts count as empty (a text's end alone). Rows with a null id are held
    out; repeated ids keep their rows and count as often as they stand. A very
    long text costs its own length. Without a training text all scores are those
    of the priors; an empty table gives no rows. Further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    model, rare = train(docs.where(~is_held_out(id_col)).select(utf8(text_col).alias("t")))
    out = score(docs, model, rare, id_col, text_col)
    return out.select("id", is_held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
