"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into machines over the tropical semiring (min, +):

* the normaliser, with arcs from characters to symbols (blanks to the escape
  mark, a dummy prefix, runs of blanks to one where the model says so);
* the pieces, a trie whose arcs read one symbol each, and whose piece ends
  write the piece and weigh its negative score;
* byte fallback, an arc that reads a symbol which no piece covers, writes its
  UTF-8 bytes and weighs more than any piece;
* for BPE models the pairs, an acceptor whose state is the last piece written:
  two pieces may stand side by side, at weight 0, only if merging their text
  gives back just that pair, and else weigh infinity. Any sequence whose
  neighbours all pass is the encoding by merges, whatever the scores.

An input is composed with the machines as it is read, and the path of least
weight is the encoding; a state is a position and, for BPE, the last piece.
Decoding is the inverse transducer, from pieces to bytes.

No piece reaches across a blank from the left, so an input falls apart into
chunks. The chunks of a block are told apart by their bytes, each different one
is composed once and remembered, and the ids of the rows are gathered from them;
no Python string is made for a row.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import _BYTES, blocks, running, span_hash
from .storage import table

MARK = "▁"
#: Piece types in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks and pairs that a Python worker remembers.
REMEMBERED, PAIRS = 500_000, 1_000_000
#: Characters of a chunk that is solved together with others.
LONGEST = 40
#: How much worse than the worst piece an uncovered character is.
UNKNOWN_PENALTY = 10.0
#: The model file, unless the session names another one; the driver reads it.
MODEL_PATH, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.chalkline.sentencepiece.model"
#: Symbols of the machines: any other character, and the piece that stands for byte fallback.
ANY, FALLBACK = "", -1
_START = -2

def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Machine:
    """A transducer: arcs[state][symbol] is (output, weight, next state); ANY reads what has no arc of its own and writes it as it is."""

    arcs: list[dict[str, tuple]] = field(default_factory=lambda: [{}])

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1


def normaliser(dummy_prefix: bool, collapse: bool, escape: bool) -> Machine:
    """States: 0 before anything is written, 1 behind a character; 2 behind blanks that aren't written yet, if runs collapse."""
    blank = MARK if escape else " "
    m = Machine()
    begin = blank if dummy_prefix else ""
    m.state()
    m.arcs[0] = {ANY: (begin, 0.0, 1), " ": ("", 0.0, 0) if collapse else (begin + blank, 0.0, 1)}
    m.arcs[1] = {ANY: ("", 0.0, 1), " ": ("", 0.0, m.state()) if collapse else (blank, 0.0, 1)}
    if collapse:
        m.arcs[2] = {ANY: (blank, 0.0, 1), " ": ("", 0.0, 2)}
    return m


def trie(pieces: dict[str, int], scores: list[float], floor: float) -> tuple[Machine, list[tuple[int, float] | None]]:
    """The pieces and byte fallback: a machine, and what each of its states writes, with the weight, when it goes back to the beginning."""
    m, ends = Machine(), [None]
    for piece, number in pieces.items():
        at = 0
        for c in piece:
            if c not in m.arcs[at]:
                m.arcs[at][c] = (None, 0.0, m.state())
                ends.append(None)
            at = m.arcs[at][c][2]
        ends[at] = (number, -scores[number])
    m.arcs[0][ANY] = (FALLBACK, -floor, 0)
    return m, ends


@dataclass
class Transducer:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    bpe: bool = True
    byte_fallback: bool = False
    dummy_prefix: bool = True
    collapse: bool = False
    escape: bool = True
    arcs: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.arcs = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.text = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types)]
        self.text[self.unknown] = " ⁇ ".encode()  # what the library writes for an unknown piece
        floor = min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.normaliser = normaliser(self.dummy_prefix, self.collapse, self.escape)
        used = self.arcs if not self.bpe else {p: i for p, i in self.arcs.items() if len(p) == 1 or self._merged(p) == [p]}
        self.trie, self.ends = trie(used, self.scores, floor)
        covered = set("".join(self.arcs))
        self.breaks = [c for c in "\n\t\r" if c not in covered]
        #: Whether texts fall apart into chunks: no piece holds a mark behind another character, and uncovered characters don't melt into one piece.
        self.split = self.byte_fallback and self.escape and not self.collapse and not any(MARK in p.lstrip(MARK) for p in self.arcs)
        self.pairs: dict[tuple[int, int], bool] = {}
        size = np.array([len(x) for x in self.text], np.int64)
        self.text_first, self.text_flat = np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(self.text), np.uint8)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        pieces, scores, types, own = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append(piece), scores.append(score), types.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
                own |= {"bpe": trainer.get(3, UNIGRAM) == BPE, "byte_fallback": bool(trainer.get(35, 0))}
                if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or trainer.get(24, 0):
                    raise NotImplementedError("only unigram and BPE models that mark the beginnings of words")
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise NotImplementedError("models with a character map")
                own |= {"dummy_prefix": bool(norm.get(3, 1)), "collapse": bool(norm.get(4, 1)), "escape": bool(norm.get(5, 1))}
        if USER in types:
            raise NotImplementedError("models with user-defined symbols")
        return cls(pieces, scores, types, **own)

    # the machines at work

    def normalise(self, text: str) -> str:
        """What the normaliser writes for the text."""
        out, at = [], 0
        for c in text:
            got = self.normaliser.arcs[at].get(c)
            if got is None:
                got = self.normaliser.arcs[at][ANY]
                out.append(got[0] + c)
            else:
                out.append(got[0])
            at = got[2]
        return "".join(out)

    def _merged(self, text: str) -> list[str]:
        """text merged greedily: the best-scored neighbours first, of equals the leftmost."""
        symbols, arcs, scores = list(text), self.arcs, self.scores
        while len(symbols) > 1:
            best, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                p = arcs.get(symbols[i] + symbols[i + 1])
                if p is not None and scores[p] > best:
                    best, at = scores[p], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _weight(self, a: int, b: int) -> float:
        """Of the pair acceptor's arc b from the state of last piece a."""
        if a < 0 or b < 0:
            return 0.0
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            got = self.pairs[a, b] = self._merged(x + y) == [x, y]
        return 0.0 if got else np.inf

    def _fallback(self, c: str) -> list[int]:
        if self.byte_fallback:
            return [self.bytes[b] for b in c.encode()]
        return [self.unknown]

    def shortest(self, symbols: str) -> list[int]:
        """The output of the lightest path of the symbols through the composed machines; of equals the one whose last arcs begin first."""
        n, arcs, ends, bpe = len(symbols), self.trie.arcs, self.ends, self.bpe
        # (position, state of the pair acceptor): weight, position and state before; unigram models need one state
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
        best[0][_START] = (0.0, 0, _START)
        fallback, weight = arcs[0][ANY][0], arcs[0][ANY][1]
        for i in range(n):
            here = best[i]
            if not here:
                continue
            at, written = 0, []
            for j in range(i, n):
                arc = arcs[at].get(symbols[j])
                if arc is None:
                    break
                at = arc[2]
                if ends[at] is not None:
                    written.append((j + 1, *ends[at]))
            if not written or written[0][0] != i + 1:
                written.append((i + 1, fallback, weight))
            for j, piece, w in written:
                state, there = piece if bpe else 0, best[j]
                for a, (x, _, _) in here.items():
                    y = x + w + (self._weight(a, piece) if bpe else 0.0)
                    if y < np.inf and (state not in there or y < there[state][0]):
                        there[state] = (y, i, a) if bpe else (y, i, piece)
        out: list[int] = []
        i = n
        state = min(best[n], key=lambda k: best[n][k][0]) if n else _START
        while i:
            _, before, x = best[i][state]
            piece = state if bpe else x
            out += [piece] if piece >= 0 else self._fallback(symbols[before])[::-1]
            i, state = before, x if bpe else (0 if before else _START)
        out.reverse()
        if not self.byte_fallback:  # neighbouring unknowns are one piece
            out = [p for k, p in enumerate(out) if p != self.unknown or not k or out[k - 1] != p]
        return out

    def _compiled(self) -> tuple[np.ndarray, ...]:
        """The trie as arrays: symbol of each code point, (state, symbol) of the arcs in order, their next states, and the piece of each state (-1: none)."""
        if not hasattr(self, "_arrays"):
            alphabet = sorted({c for arcs in self.trie.arcs for c in arcs if c != ANY})
            symbol = np.full(0x110000, -1, np.int32)
            symbol[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
            if self.escape:
                symbol[0x20] = symbol[ord(MARK)]
            arcs = np.array([(at * len(alphabet) + symbol[ord(c)], arc[2]) for at, own in enumerate(self.trie.arcs) for c, arc in own.items() if c != ANY], np.int64)
            arcs = arcs[np.argsort(arcs[:, 0])]
            piece = np.array([-1 if e is None else e[0] for e in self.ends], np.int64)
            self._arrays = symbol, len(alphabet), arcs[:, 0].copy(), arcs[:, 1].copy(), piece, -np.array(self.scores)
            self._pair_keys, self._pair_free = np.zeros(1, np.int64), np.zeros(1, bool)
        return self._arrays

    def _pair_weights(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair acceptor's weights of many arcs."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        free, new = self._pair_free[at], self._pair_keys[at] != key
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            got = np.array([self._weight(int(k >> 32), int(k & 0xFFFFFFFF)) == 0.0 for k in keys])
            free[new] = got[back]
            if len(self._pair_keys) > PAIRS:
                self._pair_keys, self._pair_free = np.zeros(1, np.int64), np.zeros(1, bool)
            where = np.searchsorted(self._pair_keys, keys)
            self._pair_keys, self._pair_free = np.insert(self._pair_keys, where, keys), np.insert(self._pair_free, where, got)
        return np.where((a < 0) | free, 0.0, np.inf)

    def shortest_many(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """shortest() of many inputs of up to LONGEST characters that pieces cover: the ids one after another, and how many of each.

        All inputs take the same step at once. A position has one state: for
        unigram models there is but one, and for BPE the pair acceptor leaves
        one, since every prefix has one encoding.
        """
        symbol, size, arc_keys, arc_next, piece_of, weight_of = self._compiled()
        n = np.diff(first)
        k, top = len(n), int(n.max(initial=0))
        grid = np.full((k, top), -1, np.int64)
        row = np.repeat(np.arange(k), n)
        grid[row, np.arange(len(points)) - first[row]] = symbol[points]
        weight, last, begin = np.full((k, top + 1), np.inf), np.full((k, top + 1), _START, np.int64), np.zeros((k, top + 1), np.int64)
        weight[:, 0] = 0
        for i in range(top):
            own = np.flatnonzero((n > i) & np.isfinite(weight[:, i]))
            at = np.zeros(len(own), np.int64)
            for j in range(i, top):
                live = n[own] > j
                own, at = own[live], at[live]
                if not len(own):
                    break
                key = at * size + grid[own, j]
                place = np.minimum(np.searchsorted(arc_keys, key), len(arc_keys) - 1)
                found = (arc_keys[place] == key) & (grid[own, j] >= 0)
                own, at = own[found], arc_next[place[found]]
                p = piece_of[at]
                ends = np.flatnonzero(p >= 0)
                w, q = own[ends], p[ends]
                cost = weight[w, i] + weight_of[q]
                if self.bpe:
                    cost = cost + self._pair_weights(last[w, i], q)
                better = cost < weight[w, j + 1]
                w, q = w[better], q[better]
                weight[w, j + 1], last[w, j + 1], begin[w, j + 1] = cost[better], q, i
        # back along the paths
        out, place, step = np.zeros((k, top), np.int32), n.copy(), 0
        count = np.zeros(k, np.int64)
        while (live := np.flatnonzero(place > 0)).size:
            out[live, top - 1 - step] = last[live, place[live]]
            place[live] = begin[live, place[live]]
            count[live] += 1
            step += 1
        return out[np.arange(top)[None, :] >= top - count[:, None]], count

    def encode(self, text: str) -> list[int]:
        return self.shortest(self.normalise(text)) if text else []

    def decode(self, ids) -> str:
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    def written(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that rows of counts[r] ids decode to, one row after another, and where each begins; the dummy prefix is gone."""
        size = self.text_first[ids + 1] - self.text_first[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(self.text_first[ids] - ends[:-1], size) + np.arange(ends[-1])
        data, offsets = self.text_flat[index], ends[np.concatenate([[0], np.cumsum(counts)])]
        if not self.dummy_prefix or not len(data):
            return data, offsets
        begins = offsets[:-1][np.diff(offsets) > 0]
        drop = np.zeros(len(data), bool)
        drop[begins[data[begins] == 0x20]] = True
        return data[~drop], offsets - np.concatenate([[0], np.cumsum(drop)])[offsets]


class Encoder:
    """A transducer with the chunks that it has met: their hash, bytes and ids."""

    def __init__(self, fst: Transducer):
        self.fst = fst
        self.breaks = np.zeros(256, bool)
        self.breaks[[ord(c) for c in fst.breaks]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.id_first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.data, self.first = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where chunks begin and end, and the chunks of each row: a run of blanks and what follows it; characters that no piece covers stand alone."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        blank, alone = data == 0x20, self.breaks[data]
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[1:] |= alone[1:] | alone[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(data)), np.diff(np.searchsorted(start, offsets))

    def _solved(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of the chunks in memory; new ones are composed with the transducer and remembered. Chunks differ from each other."""
        h = span_hash(running(_BYTES[data]), start, end)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        slot = np.where(self.keys[at] == h, self.slot[at], -1) if len(self.keys) else np.full(len(h), -1)
        # a hash that is known must stand for the same bytes
        met = np.flatnonzero(slot >= 0)
        n = end[met] - start[met]
        same = n == self.first[slot[met] + 1] - self.first[slot[met]]
        met, n = met[same], n[same]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = data[np.repeat(start[met], n) + step] == self.data[np.repeat(self.first[slot[met]], n) + step]
        known = np.zeros(len(h), bool)
        known[met] = np.add.reduceat(equal, np.cumsum(n) - n) == n if len(n) else False
        new = np.flatnonzero(~known)
        if len(new):
            n = end[new] - start[new]
            own = data[np.repeat(start[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ids, counts = self._composed(own, np.concatenate([[0], np.cumsum(n)]))
            slot[new] = len(self.first) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.id_first = np.concatenate([self.id_first, self.id_first[-1] + np.cumsum(counts)])
            self.data = np.concatenate([self.data, own])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(end[new] - start[new])])
            keys, kept = np.unique(np.concatenate([self.keys, h[new]]), return_index=True)
            self.keys, self.slot = keys, np.concatenate([self.slot, slot[new]])[kept]
        return slot

    def _composed(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after another, and how many of each; those that are long or hold an uncovered character go one by one."""
        whole = data.tobytes()
        points = np.frombuffer(whole.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[first]
        odd = np.diff(at) > LONGEST
        if len(points) != at[-1]:  # not UTF-8
            odd[:] = True
        else:
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            odd[row[self.fst._compiled()[0][points] < 0]] = True
        counts, ids = np.zeros(len(odd), np.int64), []
        even = np.flatnonzero(~odd)
        if len(even):
            n = np.diff(at)[even]
            got, counts[even] = self.fst.shortest_many(points[np.repeat(at[even] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.concatenate([[0], np.cumsum(n)]))
        if not odd.any():
            return got, counts
        single = {k: np.array(self.fst.shortest(whole[first[k] : first[k + 1]].decode("utf-8", "replace").replace(" ", MARK)), np.int32) for k in np.flatnonzero(odd)}
        for k, x in single.items():
            counts[k] = len(x)
        out, ends = np.zeros(counts.sum(), np.int32), np.cumsum(counts)
        alone = np.zeros(len(out), bool)
        for k, x in single.items():
            out[ends[k] - len(x) : ends[k]] = x
            alone[ends[k] - len(x) : ends[k]] = True
        if len(even):
            out[~alone] = got
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, round trips) of the rows of a block."""
        fst, rows = self.fst, len(offsets) - 1
        marked = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        plain = np.unique(np.searchsorted(offsets, marked, "right") - 1) if fst.split else np.arange(rows)
        size = np.diff(offsets)
        size[plain] = 0
        body = data if not len(plain) else data[np.repeat(~np.isin(np.arange(rows), plain), np.diff(offsets))]
        ends = np.concatenate([[0], np.cumsum(size)])
        if fst.dummy_prefix:
            begins = ends[:-1][size > 0]
            body, ends = np.insert(body, begins, 0x20), ends + np.concatenate([[0], np.cumsum(size > 0)])
        if len(self.first) > REMEMBERED:
            self.forget()
        start, end, chunks = self._chunks(body, ends)
        h = span_hash(running(_BYTES[body]), start, end)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        n = end - start
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = n != n[at][back]
        if len(n) and not other.any():
            equal = body[np.repeat(start, n) + step] == body[np.repeat(start[at][back], n) + step]
            other |= np.add.reduceat(equal, np.cumsum(n) - n) < n
        if other.any():  # chunks of one hash and different bytes: each is met alone
            at, back = np.arange(len(n)), np.arange(len(n))
        slot = self._solved(body, start[at], end[at])[back]
        per = self.id_first[slot + 1] - self.id_first[slot]
        ids = self.ids[np.repeat(self.id_first[slot] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
        counts = np.diff(np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(chunks)])])
        back_data, back_first = fst.written(ids, counts)
        again = np.diff(back_first) == np.diff(offsets)
        if len(plain):
            again[plain] = False
        for r in np.flatnonzero(again) if len(back_data) != len(data) or not np.array_equal(back_data, data) else ():
            again[r] = np.array_equal(back_data[back_first[r] : back_first[r + 1]], data[offsets[r] : offsets[r + 1]])
        if len(plain):
            split, whole = np.split(ids, np.cumsum(counts)[:-1]), data.tobytes()
            for r in plain:
                text = whole[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
                got = fst.encode(text)
                split[r], again[r] = np.array(got, np.int32), fst.decode(got) == text.replace(MARK, " ")
            ids, counts = np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids.astype(np.int32), counts, again


SCHEMA = "doc_id long, n_tokens long, round_trip boolean, ids array<int>"
_LOADED: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One for each Python worker, so that chunks are remembered from task to task."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Transducer.load(model))
    return _LOADED[key]


def _model(spark: SparkSession, path: str | None):
    """The model's bytes, read on the driver and broadcast: one file, whatever the input."""
    with open(path or spark.conf.get(MODEL_SETTING, MODEL_PATH), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def tokens(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row for each row of documents: its ids, their number, and whether they decode to the text.

    Null and empty texts have no ids and round-trip as empty. A text with the
    escape mark U+2581 of its own decodes to one with blanks in its place and
    is compared as such. A row counts as often as it occurs, a null doc_id
    stays null, and other columns are not read. Texts are encoded whole.
    """
    shipped = _model(documents.sparkSession, model_path)

    def run(batches):
        encoder = _encoder(shipped.value)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                ids, counts, same = encoder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(same), lists], ["doc_id", "n_tokens", "round_trip", "ids"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def texts(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the texts that the ids decode to. Null ids give the empty text; an id that the model lacks is an error."""
    shipped = _model(encoded.sparkSession, model_path)

    def run(batches):
        fst = _encoder(shipped.value).fst
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            data, offsets = fst.written(lists.flatten().to_numpy(zero_copy_only=False), counts)
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents with their ids, the number of ids, and whether they decode to the text."""
    return tokens(docs)
