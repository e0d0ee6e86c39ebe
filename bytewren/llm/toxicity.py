"""Toxicity: subword-bag embeddings averaged over a window of words, under a linear softmax.

A word is the bag of its character n-grams with word borders; an n-gram is a row
of an embedding table found by hash. A window's embedding is the mean over its
words, and a document is as toxic as its most toxic window, so that one insult
in a long text counts. Embeddings and softmax are trained jointly by gradient
descent in numpy. A misspelt word shares most n-grams with words seen in
training. For scoring, table and softmax collapse to one number per n-gram.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import bound_batches, least_hashes, table as written, utf8

#: Sizes of the model: n-grams in bytes, rows and width of the table, words in a window and between windows.
GRAMS, ROWS, WIDTH, WINDOW, STRIDE = (3, 4, 5), 1 << 17, 12, 8, 4
#: The bounds of the sample that the fit reads, parameters of train(): labelled rows of either label, and bytes of the texts of
#: either label. They bound what is learnt from, not what is scored.
SAMPLE, SAMPLE_BYTES = 3000, 8 << 20
EPOCHS, RATE, SEED = 60, 0.5, 7
#: Log odds of a text about which nothing is known, as an empty one; a fixed prior, so that words must make a text toxic.
PRIOR = -2.0
#: Words longer than this are cut into words of this many bytes, so that junk makes no long bag.
LONG_WORD = 64


def words(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z only) between ASCII white space."""
    out = []
    for w in text.lower().split():
        out += [w] if len(w) <= LONG_WORD else [w[i : i + LONG_WORD] for i in range(0, len(w), LONG_WORD)]
    return out


def bags(words: list[bytes], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row of each n-gram, number of its word), words in order; a word with borders has at least one n-gram."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = buf == 32
    word = (np.cumsum(space) - 1).astype(np.int32)  # a border belongs to the word after it
    found_rows, found_words = [], []
    mixed = np.zeros(len(buf), np.uint64)
    inner = np.zeros(len(buf), bool)  # a border inside the n-gram
    for n in range(1, max(GRAMS) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] + buf[n - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n >= 3:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        if n in GRAMS:
            at = np.flatnonzero(~inner[:m])
            found_rows.append(((mixed[at] >> np.uint64(40)) % np.uint64(rows)).astype(np.int32))
            found_words.append(word[at])
    return np.concatenate(found_rows), np.concatenate(found_words)


def _windows(values: np.ndarray) -> np.ndarray:
    """Mean of each window's word values; windows begin every STRIDE words, and the last one ends with the text."""
    n = len(values)
    total = np.concatenate([[0.0], np.cumsum(values)])
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, n)
    starts = np.maximum(0, ends - WINDOW)
    return (total[ends] - total[starts]) / np.maximum(1, ends - starts)


@dataclass
class Model:
    """What scoring needs: the toxic-minus-clean logit of every n-gram, and of the bias."""

    gram: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        """0 to 1; a text without words has the score of the bias alone."""
        w = words(text)
        if not w:
            return float(1 / (1 + np.exp(-self.bias)))
        rows, of = bags(w, len(self.gram))
        n = np.bincount(of, minlength=len(w))
        value = np.bincount(of, self.gram[rows], len(w)) / np.maximum(1, n)
        return float(1 / (1 + np.exp(-np.clip(_windows(value).max() + self.bias, -30, 30))))


@dataclass
class Corpus:
    """Texts as numbers of words, every word once as rows of its n-grams."""

    flat: np.ndarray  # words of all texts
    begin: np.ndarray  # of each text, and the end
    rows: np.ndarray  # of each n-gram, words in order
    of: np.ndarray  # the word of each n-gram
    size: np.ndarray  # n-grams of each word

    #: N-grams looked at in one pass, so that no temporary is as long as all of them.
    SLICE = 1 << 20

    @staticmethod
    def of_texts(texts: list[bytes]) -> "Corpus":
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words(t) or [b""]], np.int32) for t in texts]
        rows, of = bags([w or b"\0" for w in number])
        size = np.maximum(1, np.bincount(of, minlength=len(number))).astype(np.float64)
        return Corpus(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]), rows, of, size)

    def _slices(self) -> list[tuple[int, int]]:
        return [(i, i + self.SLICE) for i in range(0, max(1, len(self.rows)), self.SLICE)]

    def running(self, gram: np.ndarray) -> np.ndarray:
        """Running sums over all texts' words of a word's value, the mean of its n-grams'."""
        word = sum(np.bincount(self.of[i:j], gram[self.rows[i:j]], len(self.size)) for i, j in self._slices()) / self.size
        return np.concatenate([[0.0], np.cumsum(word[self.flat])])

    def back(self, lo: np.ndarray, hi: np.ndarray, error: np.ndarray, rows: int) -> np.ndarray:
        """What each row of the table gets of the spans' errors: a span's goes to its words alike, a word's to its n-grams."""
        part = error / (hi - lo)
        steps = np.bincount(lo, part, len(self.flat) + 1) - np.bincount(hi, part, len(self.flat) + 1)
        of_word = np.bincount(self.flat, np.cumsum(steps)[:-1], len(self.size)) / self.size
        return sum(np.bincount(self.rows[i:j], of_word[self.of[i:j]], rows) for i, j in self._slices())


def gradients(corpus: Corpus, table: np.ndarray, soft: np.ndarray, total: np.ndarray, lo: np.ndarray, hi: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss of each text, of_gram, gradient of soft): weighted cross-entropy of the softmax over the mean of each span's words.

    The table's gradient is the outer product of of_gram and the softmax's difference. total: running() for it.
    """
    logit = (total[hi] - total[lo]) / (hi - lo) + PRIOR
    toxic = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    of_gram = corpus.back(lo, hi, (toxic - y) * weight, len(table))  # of the softmax's second output; the first has its negative
    loss = -weight * np.log(np.where(y == 1, toxic, 1 - toxic))
    return loss, of_gram, table.T @ np.stack([-of_gram, of_gram], axis=1)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Train on labelled texts; with no text of either label the score is the share of label 1 (1/2 without any)."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(np.zeros(ROWS, np.float32), float(np.log(share / (1 - share))))
    corpus = Corpus.of_texts(texts)
    begin = corpus.begin
    starts, ends, owner = [], [], []
    for k, (b, e) in enumerate(zip(begin, begin[1:])):
        s = np.arange(b, max(b + 1, e - WINDOW + STRIDE), STRIDE)
        t = np.minimum(s + WINDOW, e)
        starts.append(np.maximum(b, t - WINDOW))
        ends.append(t)
        owner.append(np.full(len(s), k))
    starts, ends, owner = map(np.concatenate, (starts, ends, owner))
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])

    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1, 1, (ROWS, WIDTH)) / WIDTH
    soft = rng.uniform(-1, 1, (WIDTH, 2)) / WIDTH
    grow_t, grow_s = np.full((ROWS, 1), 1e-8), np.full((WIDTH, 2), 1e-8)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for epoch in range(EPOCHS):
        side = soft[:, 1] - soft[:, 0]
        total = corpus.running(table @ side)  # one number for an n-gram, so that no n-gram's embedding is ever gathered
        if epoch < 3:  # all of a text first; its most toxic window once n-grams differ
            lo, hi = begin[:-1], begin[1:]
        else:
            value = (total[ends] - total[starts]) / (ends - starts)
            top = np.maximum.reduceat(value, first)
            best = np.full(len(y), len(value))
            hit = np.flatnonzero(value == top[owner])
            np.minimum.at(best, owner[hit], hit)
            lo, hi = starts[best], ends[best]
        _, of_gram, grad_s = gradients(corpus, table, soft, total, lo, hi, y, weight)
        # AdaGrad; every embedding row has one rate.
        grow_t[:, 0] += (of_gram**2) * (side @ side)
        grow_s += grad_s**2
        table -= RATE * np.outer(of_gram, side) / np.sqrt(grow_t)
        soft -= RATE * grad_s / np.sqrt(grow_s)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), PRIOR)


def fold(id_col: str = "doc_id", folds: int = 5):
    """The fold of an id: CRC-32 of its decimal text; a null id is in fold 0, held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` rows and ``sample_bytes`` of texts of either label outside fold 0, taken by the least hash of the id.

    A text that would overrun what is left of the bytes is passed over, those
    after it are not; if a label has only such texts the shortest is taken. Null
    labels are no labels, repeated labels count as the highest, repeated
    documents as their least text; labels without a document are ignored. Null
    texts are empty ones. See fit() for empty tables.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [least_hashes(known.where(F.col("y") == y), sample, count.get(y, 0), "id") for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).join(chosen, "id").groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    texts = written(texts.withColumn("size", F.octet_length("t")).withColumn("h", F.xxhash64("id")))
    rows, left = [], {0: sample_bytes, 1: sample_bytes}
    for r in texts.where(F.col("size") <= sample_bytes).orderBy("h", "id").toLocalIterator():
        text, y = bytes(r["t"]), r["y"]
        if len(text) <= left[y]:
            rows.append((text, y))
            left[y] -= len(text)
    for y in {0, 1} - {y for _, y in rows}:
        rows += [(bytes(r["t"]), y) for r in texts.where(F.col("y") == y).orderBy("size", "t").limit(1).collect()]
    return fit([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; null and empty texts have the score of the bias. Only the text is looked at.

    Null and repeated ids keep their rows; an empty table gives none; a very long text costs its own length.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.gram, model.bias))  # 4 bytes for each of ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            made = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, "id long, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has a score below ``least``; null and empty texts have that of the bias.

    An empty table gives no rows; columns of any name pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.gram, model.bias))

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        m = Model(*shared.value)
        return texts.map(m.score).astype(float)

    bound_batches(docs.sparkSession)
    return docs.where(value(utf8(text_col)) < least)
