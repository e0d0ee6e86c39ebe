"""Secret scanning: fixed formats, and guess cost for values in a credential context.

The cost of a value is the least sum, over all ways to cut it into segments, of
the segments' log10 guesses: dictionary words, dates, repeats, runs, keyboard
walks, and brute force for what is left. A value that would take many guesses is
a secret though it has no known format.

A word's guesses are its rank in the best of several lists: common passwords,
the words of public vocabulary files, and the corpus's own commonest words as
they stand outside credential values. So what is prose in the corpus's languages
is cheap, whatever they are.
"""


import base64
import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import bound_batches, commonest, map_rows, table, utf8, word_counts

# The base formats, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more; shorter runs fail as a whole
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST = 12

#: Names that announce a credential, and the value that follows. Wider than the base format: any printable value.
_NAME = r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|client[_-]?secret|credentials?|bearer)["']?\x20*(?:[:=]|(?P<is>\x20is\x20))\x20*"""
#: What ends a value without quotes besides white space: a quote that closes something around it, or a delimiter before the next name and its value.
_STOP = r"""["](?:[\s,;:)\]}>&]|\Z)|[,;&]["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[:=]["'\w]"""
#: A quoted value ends at its own quote, which a backslash hides.
CONTEXT = re.compile(_NAME + r"""(?:"((?:\\[!-~]|[!#-\[\]-~]){6,})|'((?:\\[!-~]|[!-&(-\[\]-~]){6,})|(?!["'])((?:(?!""" + _STOP + r""")[!-&(-~]){6,}))""", re.IGNORECASE | re.ASCII)

# Common passwords and the words they are made of; a word's guesses are its rank.
WORDS = (
    "password the and you that secret admin token letmein welcome dragon monkey qwerty master login hello "
    "freedom whatever trustno shadow sunshine princess football baseball superman batman iloveyou starwars "
    "summer winter spring autumn monday friday january february march april june july august september october "
    "november december root user test guest demo example sample changeme default system server database access "
    "account public private internal service client secure security love money happy home work house flower "
    "angel baby cookie coffee orange apple banana cherry purple yellow green black white silver golden diamond "
    "tiger lion eagle horse house mouse computer internet network windows linux google amazon null none true false "
    "value string text your here this with from have what when where enter insert replace placeholder redacted"
).split()
#: Letters in a word of the dictionary, words of the corpus in it, and how often such a word must stand in the corpus.
WORD_LENGTHS, KEPT, SEEN = (3, 24), 50_000, 3
LEET = str.maketrans("013457@$!", "oleastasi")

# The rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}

#: log10 guesses from which a credential's value is a secret, and of opening a brute-force segment.
LEAST_COST, SEGMENT_COST = 8.0, 0.3

DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
#: Ends of a repeat, run or walk that are offered besides the last one: those this near its start or its end.
NEAR = 32
#: Longest value whose cost is remembered, and how many are.
SHORT, REMEMBERED = 128, 50_000
#: Characters of a long value that are looked at first, and by what more if they don't tell.
FIRST_LOOK = 256


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


#: By character code: kind (1 digit, 2 letter, 0 other), keyboard row (-9: none) and place in it.
_KIND = np.array([1 if chr(i).isdigit() else 2 if chr(i).isalpha() else 0 for i in range(128)], np.int16)
_ROW = np.array([PLACE.get(chr(i), (-9, 0))[0] for i in range(128)], np.int16)
_COLUMN = np.array([PLACE.get(chr(i), (-9, 0))[1] for i in range(128)], np.int16)


def _runs(code: np.ndarray) -> np.ndarray:
    """1 or -1 where the next character of the same kind is the next or the previous one in the alphabet, else 0."""
    kind, step = _KIND[code], np.diff(code)
    return np.where((kind[1:] > 0) & (kind[1:] == kind[:-1]) & (np.abs(step) == 1), step, 0)


def _moves(code: np.ndarray) -> np.ndarray:
    """A number from 1 for each move to a neighbour on the keyboard, 0 where the next character is none."""
    row, column = _ROW[code], _COLUMN[code]
    r, c = np.diff(row), np.diff(column)
    near = (row[1:] >= 0) & (row[:-1] >= 0) & (np.abs(r) <= 1) & (np.abs(c) <= 1) & ((r != 0) | (c != 0))
    return np.where(near, 3 * r + c + 5, 0)


def _reach(holds: np.ndarray) -> np.ndarray:
    """For each place, and the one after the last, the first one from there on at which ``holds`` is false."""
    n = len(holds)
    at = np.append(np.where(holds, n, np.arange(n)), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def _ends(first: int, last: int, step: int = 1) -> list[int]:
    """first, first + step, ... up to last; of many those near either end."""
    if last < first:
        return []
    last -= (last - first) % step
    if last - first <= 2 * NEAR:
        return list(range(first, last + 1, step))
    near = NEAR // step * step
    return [*range(first, first + near + 1, step), *range(last - near, last + 1, step)]


class Guesser:
    """Guess costs under one dictionary: rank by word in lower case."""

    def __init__(self, ranks: dict[str, int] | None = None) -> None:
        self.ranks = ranks_of([WORDS]) if ranks is None else ranks
        self.longest = max(map(len, self.ranks), default=0)
        self.known: dict[tuple[str, float], float] = {}

    def cost(self, value: str, enough: float = math.inf) -> float:
        """Least log10 guesses over all segmentations of printable ASCII; empty: 0.

        Where that is ``enough`` or more, some number from ``enough`` up: the rest of
        the value need not be looked at. Linear in the length: patterns are found
        from tables made once, and a place offers a bounded number of ends.
        """
        key = (value, enough)
        found = self.known.get(key)
        if found is None:
            found = self._cost(value, enough)
            if len(value) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = found
        return found

    def _cost(self, value: str, enough: float) -> float:
        size = FIRST_LOOK
        while size < len(value):  # a long value mostly costs enough before its first characters end
            found = self._fold(value[:size], enough, size - 2 * WORD_LENGTHS[1])
            if found >= enough:
                return found
            size *= FIRST_LOOK
        return self._fold(value, enough, len(value))

    def _fold(self, value: str, enough: float, until: int) -> float:
        """The least cost, or a number from ``enough`` up once every way from the first ``until`` characters on costs that; 0 if that is not so by then."""
        n = len(value)
        best = [0.0] + [math.inf] * n
        pending: list[tuple[float, int]] = []  # (cost, end) of segments that go on
        brute = math.inf  # the least cost if a brute-force segment is open
        segments = self._segments(value)
        for i in range(until):
            for j, cost in segments(i):
                if best[i] + cost < best[j]:
                    best[j] = best[i] + cost
                    pending.append((best[j], j))
            brute = min(brute, best[i] + SEGMENT_COST) + math.log10(_alphabet(value[i]))
            best[i + 1] = min(best[i + 1], brute)
            costly = brute >= enough and best[i + 1] >= enough
            if costly or len(pending) > 8 * NEAR:
                pending = [p for p in pending if p[1] > i + 1]
            if costly and all(c >= enough for c, _ in pending):  # every way to the end leads over one of these
                return min([brute, best[i + 1], *(c for c, _ in pending)])
        return best[n] if until == n else 0.0

    def _segments(self, value: str):
        """A function from a place to (end, log10 guesses) of the patterns that begin there."""
        n, low = len(value), value.lower()
        plain = low.translate(LEET)
        code = np.minimum(np.frombuffer(low.encode("latin-1", "replace"), np.uint8), 127).astype(np.int16)
        upper = np.concatenate([[0], np.cumsum([c.isupper() for c in value])])
        runs, moves = _runs(code), _moves(code)
        same_run = _reach((runs[:-1] != 0) & (runs[:-1] == runs[1:]))
        walked = _reach(moves > 0)
        turns = np.concatenate([[0], np.cumsum(moves[1:] != moves[:-1])])
        exact = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        repeats = [_reach(exact[u:] == exact[:-u]) for u in range(1, min(8, n - 1) + 1)]
        # A cut deep inside a repeat helps no way: whatever ends or begins there can do so near the repeat's ends.
        deep = np.zeros(n + 1, bool)
        for reach in repeats if n > 2 * NEAR else ():
            deep[NEAR : NEAR + len(reach)] |= (reach - np.arange(len(reach)) >= 2 * NEAR)[: n + 1 - NEAR]
        ranks, longest, least = self.ranks, self.longest, WORD_LENGTHS[0]

        def at(i: int):
            if deep[i]:
                return
            for j in range(i + least, min(n, i + longest) + 1):
                rank, leet = ranks.get(low[i:j]), ranks.get(plain[i:j])
                if rank or leet:
                    guesses = min(rank or math.inf, 4 * leet if leet else math.inf)
                    count = int(upper[j] - upper[i])
                    variants = 1 if not count else 2 if count == j - i or (count == 1 and value[i].isupper()) else 2**count
                    yield j, math.log10(guesses * variants + 1)
            for m in (DATE.match(value, i), DATE.match(value, i, min(n, i + 4))):
                if m and m.end() - i >= 4:
                    yield m.end(), math.log10(119 * (1 if m.end() - i == 4 else 365) * (4 if re.search("[-/.]", m[0]) else 1))
            for unit, reach in enumerate(repeats, 1):
                if i < len(reach) and reach[i] - i >= unit:  # so many characters equal the one a unit later
                    for j in _ends(i + max(2 * unit, -(-3 // unit) * unit), int(reach[i]) + unit, unit):
                        yield j, math.log10(_alphabet(value[i])) * unit + math.log10((j - i) // unit)
            if i < len(runs) and runs[i]:
                for j in _ends(i + 3, int(same_run[i]) + 2):
                    yield j, math.log10(_alphabet(value[i]) * 2 * (j - i))
            if i < len(walked):
                for j in _ends(i + 4, int(walked[i]) + 1):
                    yield j, math.log10(47 * (j - i)) + int(turns[j - 2] - turns[i]) * math.log10(6)

        return at


def ranks_of(lists: Sequence[Sequence[str]]) -> dict[str, int]:
    """Rank by word, the best of several lists; words outside WORD_LENGTHS are left out."""
    out: dict[str, int] = {}
    for words in lists:
        for i, w in enumerate(words, 1):
            if WORD_LENGTHS[0] <= len(w) <= WORD_LENGTHS[1] and i < out.get(w, i + 1):
                out[w] = i
    return out


def vocabulary_words(path: str) -> list[str]:
    """The words of a byte-level vocabulary (base64 tokens with ranks), by rank: tokens that begin with a space and go on in ASCII letters."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in sorted(f, key=lambda x: int(x.split()[1]))]
    return list(dict.fromkeys(t[1:].lower().decode() for t in tokens if t[:1] == b" " and t[1:].isalpha() and t[1:].isascii()))


_WORD = re.compile(r"\b[a-z]{4,%d}\b" % WORD_LENGTHS[1])


def _outside(text: bytes) -> list[str]:
    """Words of ASCII letters, in lower case, that are no part of a credential's value."""
    text = text.decode("utf-8", "replace")
    if CONTEXT.search(text):
        text = CONTEXT.sub(" ", text)
    return [w.encode() for w in _WORD.findall(text.lower())]


def dictionary(docs: DataFrame, text_col: str = "text", vocabularies: Sequence[str] = (), kept: int = KEPT) -> dict[str, int]:
    """Ranks for a Guesser from common passwords, vocabulary files and all texts of ``docs``.

    Of the corpus's words the ``kept`` commonest count that stand at least SEEN times
    outside credential values, so that a secret in many copies doesn't become a
    word. Null and empty texts, and an empty table, give no words. The result has
    a row for each word kept and of the files: a bound on what is broadcast.
    """
    bound_batches(docs.sparkSession)
    counts = table(word_counts(docs.select(utf8(text_col).alias("t")), _outside).where(F.col("c") >= SEEN))
    own = [w.decode() for w, _ in commonest(counts, kept)]
    return ranks_of([WORDS, *map(vocabulary_words, vocabularies), own])


_plain = Guesser()


def guess_cost(value: str, enough: float = math.inf) -> float:
    """Guesser.cost with common passwords alone."""
    return _plain.cost(value, enough)


def _covered(i: int, j: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether spans, by start, leave nothing of i to j."""
    for _, a, b in spans:
        if a <= i < b:
            i = b
    return i >= j


def find(text: str, guesser: Guesser = _plain) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span in code points, by start, then kind in the order of KINDS.

    Base kinds: the leftmost non-overlapping matches of each; ``assign`` spans the
    whole match and needs a value of ASSIGN_LEAST characters. ``guess`` spans a
    credential's value of cost LEAST_COST or more that base spans do not cover
    whole. No such value: letters alone after "is" without quotes, and what goes on
    with a letter outside ASCII; both are prose.
    """
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: s[1])
    more = []
    for m in CONTEXT.finditer(text):
        i, j = m.span(m.lastindex)
        after = text[j : j + 1]
        closed = m.lastindex < 4 and after == text[i - 1]
        while not closed and j > i and text[j - 1] in "\"'.,;:)]}>":
            j -= 1
        prose = not closed and (after.isalpha() or (m["is"] and text[i:j].isalpha()))
        if j - i >= 6 and not prose and not _covered(i, j, base) and guesser.cost(text[i:j], LEAST_COST) >= LEAST_COST:
            more.append(("guess", i, j))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, mark: str = "<secret>", guesser: Guesser = _plain) -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``; unchanged if there is none."""
    out, at = [], 0
    for _, start, end in find(text, guesser):
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:] if out else text


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) per row; a null text counts as empty, without spans.

    ranks: see dictionary(); without it common passwords alone. Null and repeated
    ids keep their rows; an empty table gives none; a very long text or value
    costs its own length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        guesser = Guesser(sent.value)

        def row(values: tuple) -> tuple:
            spans = find(values[1].decode("utf-8", "replace"), guesser)
            base = [s for s in spans if s[0] != "guess"]
            counts = [sum(s[0] == k for s in spans) for k in KINDS]
            return values[0], *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

        return row

    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), make, "id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", ranks: dict[str, int] | None = None) -> DataFrame:
    """All rows and columns of ``docs``; texts with secrets have them replaced (and ``length_col`` follows), null texts stay null.

    ranks: as for scan(). An empty table gives no rows; columns of any name pass through.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        guesser = Guesser(sent.value)
        for texts in batches:
            yield texts.map(lambda t: redact(t, guesser=guesser) if t is not None else None)

    out = docs.withColumn(text_col, hide(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
