"""Byte-level BPE as a lazily determinised transducer, and streaming decode by a UTF-8 state machine.

In a BPE vocabulary the encoding of a prefix is fixed by its last token, and two
tokens may stand side by side exactly if encoding their joined bytes gives them
back. So a state is a set of hypotheses: where the open token began (a trie
node), the token before it, and tokens not yet certain. A byte moves every
hypothesis along the trie, drops the impossible ones, and emits what the others
have in common; no token is longer than the vocabulary's longest, which bounds
the lookahead. States and arcs are made when first met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewren.llm.common import KEPT, map_rows, utf8

#: States, spellings and neighbours are forgotten beyond these numbers and made again; results don't depend on them. Some 200 MB in all.
MOST_STATES, MOST_PIECES, MOST_PAIRS = 150_000, 150_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """BPE by definition: join the neighbours whose union has the lowest rank until none or ``least`` parts are left. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings to token ids; one instance serves any number of texts."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES) -> None:
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {((0, -1, ()),): 0}
        self.members: list[tuple] = [((0, -1, ()),)]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose union is the last step of the token's own encoding; None for a byte or an unreachable token."""
        if token not in self.halves:
            parts = merge(self.bytes_of[token], self.ranks, 2)
            self.halves[token] = tuple(parts) if len(parts) == 2 and len(self.bytes_of[token]) > 1 else None
        return self.halves[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether encoding both tokens' bytes gives them back: no union across the border comes before they are whole.

        The border is replayed backwards: of the two tokens the one made later is
        taken apart, and a union that existed before that moment would have won.
        """
        if last < 0:
            return len(self.bytes_of[token]) == 1 or self._halves(token) is not None
        pair = (last, token)
        known = self.beside.get(pair)
        if known is not None:
            return known
        if len(self.beside) >= MOST_PAIRS:
            self.beside.clear()
        fits = self._may_follow(-1, token)
        made_before = 1 << 60  # unions of at least this rank come too late
        left, right = last, token
        while fits:
            union = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if union is not None and union < made_before:
                fits = False
                break
            halves_l, halves_r = self._halves(left), self._halves(right)
            if halves_l is None and halves_r is None:
                break
            # A tie can't be: left == right splits the right one first, as the leftmost union of a rank is made first.
            if halves_r is None or (halves_l is not None and left > right):
                made_before, left = left, halves_l[1]
            else:
                made_before, right = right + 1, halves_r[0]
        self.beside[pair] = fits
        return fits

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        kept, ended = [], None
        for node, last, due in self.members[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            if self.child[node]:
                kept.append((node, last, due))
            token = self.token[node]
            if token >= 0 and ended is None and self._may_follow(last, token):
                ended = (0, token, (*due, token))
        if ended is None:
            raise ValueError("the vocabulary lacks a single byte")
        kept.append(ended)
        out = kept[0][2]  # what all hypotheses begin with is certain
        for _, _, due in kept:
            if due[: len(out)] != out:
                n = 0
                for a, b in zip(out, due):
                    if a != b:
                        break
                    n += 1
                out = out[:n]
            if not out:
                break
        n = len(out)
        target = tuple([(node, last, due[n:]) for node, last, due in kept]) if n else tuple(kept)
        arc = self.arcs[state][byte] = (self._state(target), out)
        return arc

    def _state(self, members: tuple) -> int:
        to = self.states.get(members)
        if to is None:
            to = self.states[members] = len(self.members)
            self.members.append(members)
            self.arcs.append({})
        return to

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece that no pre-tokeniser cut crosses, as repeated merging would give them.

        States are forgotten inside a piece too, but for the one it is in: however
        long a piece is, it takes no more memory than its ids.
        """
        if piece in self.ranks:
            return [self.ranks[piece]]
        arcs, state, out = self.arcs, 0, []
        for byte in piece:
            arc = arcs[state].get(byte)
            if arc is None:
                if len(self.members) >= self.most_states:
                    live = self.members[state]
                    self.forget()
                    arcs, state = self.arcs, self._state(live)
                arc = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        return out + list(self.members[state][-1][2])


class Encoder:
    """Whole texts to ids: pieces by the pattern, each through the transducer, spellings remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer, self.pieces = Transducer(ranks), regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _spell(self, piece: str) -> str:
        ids = self.older.get(piece) or " ".join(map(str, self.transducer.encode(piece.encode())))
        if len(piece) < 64:
            self.known[piece] = ids
        return ids

    def decimal(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        if len(self.known) > MOST_PIECES:
            self.older, self.known = self.known, {}
        known, spell = self.known, self._spell
        return " ".join([known.get(p) or spell(p) for p in self.pieces(text)])

    def ids(self, text: str) -> list[int]:
        return list(map(int, self.decimal(text).split()))


#: UTF-8 lead bytes: how many bytes follow, and the range of the first of them.
LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


def _leads() -> dict[int, tuple[int, int, int]]:
    return {b: (n, lo, hi) for first, last, n, lo, hi in LEADS for b in range(first, last + 1)}


class Decoder:
    """Ids to text piece by piece. The state is the open UTF-8 sequence, if any; moves are remembered by state and id.

    Bytes that fit no sequence become U+FFFD, one for each maximal part of a sequence.
    """

    leads = _leads()

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.closed: dict[str, str] = {}
        self.pending = b""

    def step(self, pending: bytes, data: bytes) -> tuple[bytes, str]:
        """One run of the state machine over bytes: what stays open, and the text that is complete."""
        out = []
        for b in data:
            if pending:
                n, lo, hi = self.leads[pending[0]]
                if (lo <= b <= hi) if len(pending) == 1 else (0x80 <= b <= 0xBF):
                    pending += bytes((b,))
                    if len(pending) == n + 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            if b < 0x80:
                out.append(chr(b))
            elif b in self.leads:
                pending = bytes((b,))
            else:
                out.append("�")
        return pending, "".join(out)

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            moves = self.moves.setdefault(self.pending, {})
            move = moves.get(i)
            if move is None:
                move = moves[i] = self.step(self.pending, self.bytes_of[i])
            self.pending = move[0]
            out.append(move[1])
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending = "�" * bool(self.pending), b""
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()

    def decode_decimal(self, decimal: str) -> str:
        """As decode, for ids in decimal; ids that open no sequence and close none take one lookup each."""
        ids, closed = decimal.split(), self.closed
        try:
            return "".join([closed[i] for i in ids])
        except KeyError:
            pass
        out = []
        for i in ids:
            if not self.pending:
                text = closed.get(i)
                if text is None:
                    self.pending, text = self.step(b"", self.bytes_of[int(i)])
                    if not self.pending:
                        closed[i] = text
                out.append(text)
            else:
                out.append(self.feed((int(i),)))
        return "".join(out) + self.finish()


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder; a reused worker keeps what it has learned until ``forget``."""
    if ("codec", path, pattern) not in KEPT:
        encoder = Encoder(load_ranks(path), pattern)
        KEPT["codec", path, pattern] = encoder, Decoder(encoder.transducer.bytes_of)
    return KEPT["codec", path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of whole texts, without special tokens; null texts count as empty and have no ids.

    Null and repeated ids keep their rows; an empty table gives none. A very long
    text or piece takes the memory of its ids.
    """

    def make():
        encoder, _ = codec(path, pattern)
        return lambda row: (row[0], encoder.ids(row[1].decode("utf-8", "replace")))

    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), make, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, text) from (id, ids); unknown ids raise KeyError, null ids count as none."""

    def make():
        _, decoder = codec(path, pattern)
        return lambda row: (row[0], decoder.decode(row[1] or ()))

    return map_rows(encoded.select("id", "ids"), make, "id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: texts are encoded, then decoded from their ids again.

    Null texts count as empty and have no ids. Null and repeated ids keep their
    rows; an empty table gives none; further columns are ignored.
    """

    def make():
        encoder, decoder = codec(path, pattern)

        def row(values: tuple) -> tuple:
            decimal = encoder.decimal(values[1].decode("utf-8", "replace"))
            back = decoder.decode_decimal(decimal).encode()
            return values[0], decimal.count(" ") + 1 if decimal else 0, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

        return row

    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded_sha256) per row: what training reads, and the digest of the text decoded from the ids.

    Nulls, repeated ids, long texts and empty tables as in digests().
    """

    def make():
        encoder, decoder = codec(path, pattern)

        def row(values: tuple) -> tuple:
            decimal = encoder.decimal(values[1].decode("utf-8", "replace"))
            ids = np.array(decimal.split(), np.int32)
            return values[0], len(ids), ids, hashlib.sha256(decoder.decode_decimal(decimal).encode()).hexdigest()

        return row

    return map_rows(docs.select(F.col(id_col).cast("long"), utf8(text_col)), make, "id long, n_tokens long, ids array<int>, decoded_sha256 string")
