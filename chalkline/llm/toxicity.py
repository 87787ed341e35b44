"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares words: K(s, t) sums over all subsequences of ORDER symbols
that s and t share, each weighted by DECAY to the power of the span that it takes
in either word, divided by the roots of K(s, s) and K(t, t). So inserted
characters and gaps cost a little instead of breaking the match. It is computed
exactly, by dynamic programming over the prefixes of both words, for all pairs that
have such a subsequence in common; no value is cut off.
Symbols are letters in lower case, with a mark at either end of the word; other
characters inside a word are dropped ("id*iot"), and runs of single letters
("i d i o t") are read as one word. A word of more than LONGEST letters is taken
in overlapping windows, of which the likeliest counts.

Landmarks of the Nyström map are chosen among the words of toxic texts that
harmless texts lack, by pivoted Cholesky: each time the word that the landmarks
so far explain least, weighed by the number of texts that hold it. Since the SVM
is linear in the map, a word has one weight, found once for each different word
of a block, and a text's score is that of its most toxic word, calibrated to a
probability.

Labels belong to texts, so the SVM is fitted as multiple-instance learning: each
toxic text gives the landmarks that it holds, or else its most toxic word, as
positive examples, and words of harmless texts are negative ones. Each positive word is also shown with one to three
letters, and with a letter after every letter, inserted at random places, so that
the SVM learns what small kernel values of disguised words are worth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .kernels import SPACE, Words, blocks, mix, running, span_hash, _BYTES
from .learning import labelled_sample, platt, released, sigmoid
from .storage import table

ORDER, DECAY = 5, 0.95
#: Letters of a word, or of a window of a longer one; such windows begin STEP letters apart.
LONGEST, STEP = 28, 14
#: Landmarks, and the least share of a word that the landmarks so far don't explain.
LANDMARKS, LEAST_RESIDUAL = 120, 0.05
#: Words that are so uneven by chance, among all the words tried, that may be expected among the candidates for landmarks; and how often one may stand in harmless texts, as a share of its rate in toxic ones.
MOST_BY_CHANCE, MOST_HARMLESS = 0.5, 0.1
#: A toxic text whose words are all less like a landmark than this says nothing about words.
LEAST_LIKE = 0.5
#: Weight in the SVM's loss of the toxic texts, beside that of the harmless ones, each text counting alike; among toxic words the share of disguised ones; and disguised copies of a word and kind.
TOXIC_WEIGHT, DISGUISED, COPIES = 0.08, 0.3, 6
#: Word weights that a Python worker remembers.
REMEMBERED = 1 << 20
#: Labelled rows of each class that the fit may use, and words of harmless texts.
SAMPLE_PER_CLASS, NEGATIVES = 2500, 12_000
#: Bytes of text that the fit handles at once.
FIT_BLOCK = 1 << 17

#: Symbols: 26 letters, 4 kinds of other bytes, and the marks.
_SYMBOL = np.full(256, -1, np.int32)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(26)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(26)
_SYMBOL[0x80:0xC0] = 26 + np.arange(64) % 3
_SYMBOL[0xC0:] = 29
_SYMBOL[ord("^")], _SYMBOL[ord("$")] = 30, 31
_BITS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Units:
    """The units (cleaned words) of a block: bytes, spans with the marks, and row of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    lower = _LOWER[data]
    accent = np.zeros(len(data), bool)  # upper-case letters of Latin-1 in UTF-8
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lower[accent] += 32
    keep = (_SYMBOL[data] >= 0) & (data != ord("^")) & (data != ord("$")) | SPACE[data]
    new = np.concatenate([[0], np.cumsum(keep)])
    packed = lower[keep]
    w = Words(packed, new[offsets])
    # runs of single letters become one unit: drop the spaces between them
    single = (w.end - w.start) == 1
    joined = np.zeros(len(single), bool)
    if len(single) > 1:
        joined[1:] = single[1:] & single[:-1] & (w.row[1:] == w.row[:-1])
    if joined.any():
        stay = ~SPACE[packed]
        new = np.concatenate([[0], np.cumsum(stay)])
        head = ~joined
        stop = np.append(np.flatnonzero(head)[1:], len(single)) - 1
        return _begun(packed[stay], new[w.start[head]], new[w.end[stop]], w.row[head])
    return _begun(packed, w.start, w.end, w.row)


def _begun(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> Units:
    """The units one after another, each between "^" and "$"."""
    n = end - start + 2
    stop = np.cumsum(n)
    index = np.repeat(start - 1 - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    out = data[np.clip(index, 0, max(0, len(data) - 1))] if len(data) else np.zeros(len(index), np.uint8)
    out[stop - n], out[stop - 1] = ord("^"), ord("$")
    return Units(out, stop - n, stop, row)


def unit(word: bytes) -> bytes:
    return b"^" + word + b"$"


def _windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and unit of the windows: short units as they are, longer ones in pieces that overlap."""
    n, top = end - start, LONGEST + 2
    pieces = np.where(n <= top, 1, 1 + -(-(n - top) // STEP))
    each = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.minimum(start[each] + k * STEP, np.maximum(start[each], end[each] - top))
    return begin, np.minimum(begin + top, end[each]), each


def _common(grid: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each row of symbols shares a subsequence of ORDER symbols with each word of masks (bit i of masks[c, w]: symbol i of word w is c), by bit-parallel longest common subsequences."""
    full = np.bitwise_or.reduce(masks, axis=0)
    state = np.broadcast_to(full, (len(grid), masks.shape[1])).copy()
    for k in range(grid.shape[1]):
        m = masks[grid[:, k]]
        x = state & m
        state = (state + x) | (state - x)
    return np.bitwise_count(~state & full[None, :]) >= ORDER


def _plain(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel before it is normalised, of each row of s and the same row of t (symbols; -1 behind the end of t), by dynamic programming over prefixes."""
    rows, n = len(s), t.shape[1]
    square = np.float32(DECAY * DECAY)
    # part[i, j]: subsequences of i symbols in s so far and in t[:j], weighed up to the ends of both
    part = np.zeros((ORDER, n + 1, rows), np.float32)
    part[0] = 1
    out = np.zeros(rows, np.float32)
    s, t = np.ascontiguousarray(s.T.astype(np.int8)), np.ascontiguousarray(t.T.astype(np.int8))
    open_, before, step = (np.empty((k, rows), np.float32) for k in (ORDER - 1, ORDER, ORDER - 1))
    decay = np.float32(DECAY)
    for symbol in s:
        same = (t == symbol[None, :]).astype(np.float32) * square
        open_[:] = 0
        before[:] = part[:, 0]  # part[:, j - 1] as it was before this symbol
        for j in range(1, n + 1):
            hit = same[j - 1]
            out += hit * before[-1]
            np.multiply(before[:-1], hit, out=step)
            open_ *= decay
            open_ += step
            before[:] = part[:, j]
            own = part[1:, j]
            own *= decay
            own += open_
    return out


class Landmarks:
    """Words and what finds them: masks for the search of common subsequences, symbols and norms for the kernel."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.array([len(w) for w in words])
        self.symbols = np.full((len(words), self.sizes.max()), -1, np.int32)
        self.masks = np.zeros((1 << _BITS, len(words)), np.uint32)
        for i, w in enumerate(words):
            self.symbols[i, : len(w)] = _SYMBOL[np.frombuffer(w, np.uint8)]
            for k, c in enumerate(w):
                self.masks[_SYMBOL[c], i] |= np.uint32(1 << k)
        self.norms = np.zeros(len(words), np.float32)
        for n in {len(w) for w in words}:
            own = [i for i, w in enumerate(words) if len(w) == n]
            self.norms[own] = np.sqrt(_plain(self.symbols[own, :n], self.symbols[own, :n]))

    def likeness(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units that share a subsequence of ORDER symbols with any landmark, and for each of them the kernel with every landmark."""
        begin, stop, owner = _windows(start, end)
        symbols, size = _SYMBOL[data], stop - begin
        units_, kernels = [], []
        for length in np.unique(size[size >= ORDER]):
            own = np.flatnonzero(size == length)
            for lo in range(0, len(own), 1 << 13):  # at once, to bound memory
                index = own[lo : lo + (1 << 13)]
                grid = symbols[begin[index][:, None] + np.arange(length)[None, :]]
                word, mark = np.nonzero(_common(grid, self.masks))
                if not len(word):
                    continue
                some, at = np.unique(word, return_inverse=True)
                norm = np.sqrt(_plain(grid[some], grid[some]))
                order = np.argsort(self.sizes[mark], kind="stable")  # pairs of landmarks of like sizes together
                value = np.empty(len(word), np.float32)
                for k in range(0, len(word), 1 << 13):  # as many as the caches hold
                    pair = order[k : k + (1 << 13)]
                    value[pair] = _plain(grid[word[pair]], self.symbols[mark[pair], : self.sizes[mark[pair[-1]]]])
                kernel = np.zeros((len(some), len(self.words)), np.float32)
                kernel[at, mark] = value / (norm[at] * self.norms[mark])
                units_.append(owner[index[some]])
                kernels.append(kernel)
        if not units_:
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        u, k = np.concatenate(units_), np.concatenate(kernels)
        order = np.argsort(u, kind="stable")
        u, k = u[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        return u[first], np.maximum.reduceat(k, first, axis=0)


@dataclass
class ToxicityModel:
    words: list[bytes]
    alpha: np.ndarray
    bias: float
    a: float
    b: float

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("words", "alpha", "bias", "a", "b")}

    @property
    def landmarks(self) -> Landmarks:
        if "_landmarks" not in self.__dict__:
            self._landmarks = Landmarks(self.words)
        return self._landmarks

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weights of units."""
        out = np.full(len(start), self.bias)
        word, k = self.landmarks.likeness(data, start, end)
        out[word] += k @ self.alpha
        return out

    def weights(self, u: Units) -> np.ndarray:
        """The weight of each unit. Those of other blocks are remembered, up to REMEMBERED of them."""
        h = span_hash(running(_BYTES[u.data]), u.start, u.end)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        known, value = self.__dict__.setdefault("memory", (np.zeros(1, np.uint64), np.zeros(1)))
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        weight, new = value[place], np.flatnonzero(known[place] != keys)
        if len(new):
            fresh = self.of(u.data, u.start[at[new]], u.end[at[new]])
            weight[new] = fresh
            if len(known) + len(new) > REMEMBERED:
                self.memory = keys, weight
            else:
                where = np.searchsorted(known, keys[new])
                self.memory = np.insert(known, where, keys[new]), np.insert(value, where, fresh)
        return weight[back]

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the weight of its most toxic unit; a row without words has the bias."""
        return self.highest(units(data, offsets), len(offsets) - 1)

    def highest(self, u: Units, rows: int) -> np.ndarray:
        out = np.full(rows, self.bias)
        if len(u.start):
            np.maximum.at(out, u.row, self.weights(u))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(offsets) - 1)
        return sigmoid(self.a * _flattened(self.raw(data, offsets)) + self.b)


def _flattened(z: np.ndarray) -> np.ndarray:
    """Scores beyond the margin, ten times closer to it, so that a few extreme texts don't set the slope of the calibration."""
    inner = np.clip(z, -1, 1)
    return inner + 0.1 * (z - inner)


def _parts(texts: list[str]) -> Iterator[tuple[int, Units, int]]:
    """The units of texts, a few texts at a time to bound the driver's memory: number of the first text, units, number of texts."""
    for lo in range(0, len(texts), 256):
        for at, end, data, offsets in blocks(pa.array(texts[lo : lo + 256], pa.large_string()), FIT_BLOCK):
            yield lo + at, units(data, offsets), end - at


def _vocabulary(texts: list[str], contexts: bool = False) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """The units of texts: the number of texts that hold each, and if asked for of different contexts (the words around it), since copies of a text add none."""
    count: dict[bytes, int] = {}
    number: dict[bytes, int] = {}
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for _, u, _ in _parts(texts):
        if not len(u.start):
            continue
        h = span_hash(running(_BYTES[u.data]), u.start, u.end)
        first = np.unique(h ^ mix(u.row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        _, at, back, n = np.unique(h[first], return_index=True, return_inverse=True, return_counts=True)
        whole = u.data.tobytes()
        names = [whole[a:b] for a, b in zip(u.start[first[at]].tolist(), u.end[first[at]].tolist())]
        for w, k in zip(names, n.tolist()):
            count[w] = count.get(w, 0) + k
        if contexts:
            near = mix(np.append(h[1:], np.uint64(0))) ^ np.concatenate([np.zeros(1, np.uint64), h[:-1]])
            own = np.array([number.setdefault(w, len(number)) for w in names], np.uint32)[back]
            pair, at = np.unique(mix(near[first] + own * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            seen.append((pair, own[at]))
    if not seen:
        return count, {}
    pair, own = (np.concatenate(x) for x in zip(*seen))
    own = own[np.unique(pair, return_index=True)[1]]
    return count, dict(zip(number, np.bincount(own, minlength=len(number)).tolist()))


def _by_chance(toxic: int, harmless: int, share: float) -> float:
    """The probability that a word without regard to the labels stands in so many or more toxic texts, of those that hold it."""
    n = toxic + harmless
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    k = np.arange(toxic, n + 1)
    return float(np.exp(log[n] - log[k] - log[n - k] + k * np.log(share) + (n - k) * np.log1p(-share)).sum())


def _kernel(words: list[bytes], marks: Landmarks) -> np.ndarray:
    out = np.zeros((len(words), len(marks.words)), np.float32)
    for lo in range(0, len(words), 10_000):  # to bound memory
        part = words[lo : lo + 10_000]
        data = np.frombuffer(b"".join(part), np.uint8)
        end = np.cumsum([len(w) for w in part])
        at, k = marks.likeness(data, end - np.array([len(w) for w in part]), end)
        out[lo + at] = k
    return out


def _choose(toxic: list[str], harmless: list[str], harmless_count: dict[bytes, int]) -> list[bytes]:
    """Landmarks by pivoted Cholesky among the words that toxic texts hold and harmless ones lack."""
    count, contexts = _vocabulary(toxic, contexts=True)
    rate, share = MOST_HARMLESS * len(harmless) / len(toxic), len(toxic) / (len(toxic) + len(harmless))
    most = MOST_BY_CHANCE / len(count.keys() | harmless_count.keys())
    pool = [w for w, n in count.items() if ORDER <= len(w) <= LONGEST + 2 and harmless_count.get(w, 0) <= rate * n]
    pool = [w for w in pool if _by_chance(min(count[w], contexts[w]), harmless_count.get(w, 0), share) <= most]
    pool = sorted(pool, key=lambda w: (-count[w], w))[: 20 * LANDMARKS]
    if not pool:
        return []
    weight = np.array([count[w] for w in pool], float)
    left, rows, out = np.ones(len(pool)), [], []
    while len(out) < LANDMARKS and (left > LEAST_RESIDUAL).any():
        i = int(np.argmax(np.where(left > LEAST_RESIDUAL, weight * left, -1)))
        column = _kernel(pool, Landmarks([pool[i]]))[:, 0].astype(float)
        for r in rows:
            column -= r * r[i]
        column /= np.sqrt(left[i])
        rows.append(column)
        left = np.maximum(0, left - column**2)
        left[i] = 0
        out.append(pool[i])
    return out


def disguised(word: bytes, copies: int = COPIES) -> list[bytes]:
    """The word with one, two and three letters inserted at random places, and with one after every letter but the last."""
    rng = np.random.default_rng(int.from_bytes(word, "big") % (1 << 63))
    letters, out = word[1:-1], []
    if len(letters) < 3:
        return out
    for k in (1, 2, 3, len(letters) - 1):
        for _ in range(copies):
            places = np.sort(rng.choice(len(letters) - 1, min(k, len(letters) - 1), replace=False)) + 1
            parts = np.split(np.frombuffer(letters, np.uint8), places)
            out.append(unit(b"".join(p.tobytes() + (bytes([97 + int(rng.integers(26))]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))))
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40, c: float = 30_000.0) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton's method on the rows within the margin. The last of the result is the bias."""
    t = np.where(y == 1, 1.0, -1.0)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    penal = np.diag(np.append(np.ones(x.shape[1] - 1), 1e-9))

    def loss(w: np.ndarray) -> float:
        return float(w @ penal @ w) / 2 + c * float(weight @ (np.maximum(0, 1 - t * (x @ w)) ** 2))

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        own = t * (x @ w) < 1
        part = x[own] * (2 * c * weight[own])[:, None]
        step, best = np.linalg.solve(part.T @ x[own] + penal, part.T @ t[own]) - w, loss(w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > best:
            size /= 2
        if size <= 1e-4 or np.abs(size * step).max() < 1e-8:
            break
        w = w + size * step
    return w


def fit(sample: list[tuple[int, str, int]], prior: float | None = None, rounds: int = 3) -> ToxicityModel:
    """prior: share of toxic rows among all labels, for which the scores are calibrated. Without labels of both classes, a model that finds every text harmless."""
    none = ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0)
    y = np.array([x[2] for x in sample], int)
    if len(set(y)) < 2:
        return none
    texts = [x[1] for x in sample]
    tune = np.arange(len(y)) % 5 == 4  # for the calibration only
    if min(len(set(y[tune])), len(set(y[~tune]))) < 2:
        tune = np.zeros(len(y), bool)
    toxic, harmless = ([texts[i] for i in np.flatnonzero(~tune & (y == k))] for k in (1, 0))
    known, _ = _vocabulary(harmless)
    words = _choose(toxic, harmless, known)
    if not words:
        return none
    marks = Landmarks(words)
    value, vector = np.linalg.eigh(_kernel(words, marks).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    # negatives: the words of harmless texts that are likest to a landmark, and others by chance
    order = sorted(known)
    most = np.concatenate([_kernel(order[lo : lo + 10_000], marks).max(axis=1) for lo in range(0, len(order), 10_000)]) if order else np.zeros(0)
    hard = np.argsort(-most, kind="stable")[: NEGATIVES // 2]
    some = np.argsort(mix(np.arange(len(order), dtype=np.uint64)), kind="stable")[: NEGATIVES // 2]
    use = np.union1d(hard, some)
    negative, times = _kernel([order[i] for i in use], marks) @ root, np.array([known[order[i]] for i in use]) / len(harmless)
    bags: list[list[bytes]] = []  # the units of each toxic text
    own: dict[bytes, bytes] = {}
    for _, u, n in _parts(toxic):
        whole = u.data.tobytes()
        for r in range(n):
            a, b = np.searchsorted(u.row, [r, r + 1])
            bags.append(sorted({own.setdefault(w, w) for w in (whole[i:j] for i, j in zip(u.start[a:b].tolist(), u.end[a:b].tolist()))}))
    vocabulary = sorted(own)
    del own
    number, kernel = {w: i for i, w in enumerate(vocabulary)}, _kernel(vocabulary, marks)
    alpha, bias, chosen = np.ones(len(words)), 0.0, set(words)  # the first witness of a text is its word most like all landmarks
    score = kernel.max(axis=1)
    for _ in range(rounds):
        witness: dict[int, int] = {}
        for b in bags:
            if b:  # the landmarks that the text holds, or else its most toxic word
                best = max(b, key=lambda w: score[number[w]])
                for i in {number[w] for w in b if w in chosen} or ({number[best]} if kernel[number[best]].max() >= LEAST_LIKE else ()):
                    witness[i] = witness.get(i, 0) + 1
        plain = np.array(sorted(witness))
        extra = [(d, witness[i]) for i in plain if kernel[i].max() > 0.9 for d in disguised(vocabulary[i])]
        x = np.vstack([kernel[plain] @ root, _kernel([d for d, _ in extra], marks) @ root, negative])
        label = np.concatenate([np.ones(len(plain) + len(extra)), np.zeros(len(negative))])
        share = DISGUISED if extra else 0.0
        n, e = np.array([witness[i] for i in plain], float), np.array([c for _, c in extra], float)
        weight = np.concatenate([TOXIC_WEIGHT * (1 - share) * n / n.sum(), TOXIC_WEIGHT * share * e / max(1e-9, e.sum()), (1 - TOXIC_WEIGHT) * times])
        w = _svm(x, label, weight)
        alpha, bias = root @ w[:-1], float(w[-1])
        score = np.concatenate([kernel[lo : lo + 10_000] @ alpha for lo in range(0, len(kernel), 10_000)]) + bias
    del bags, kernel, number, vocabulary, known, order
    model = ToxicityModel(words, alpha, bias, 1.0, 0.0)
    # calibration: the texts that the fit didn't see, and the toxic words of the toxic ones with a letter inserted
    own = np.flatnonzero(tune) if tune.any() else np.arange(len(y))
    z, hidden = [], []
    for lo, u, n in _parts([texts[i] for i in own]):
        z.append(model.highest(u, n))
        strong = np.flatnonzero(model.weights(u) > 0) if len(u.start) else np.zeros(0, np.int64)
        strong = strong[y[own[lo + u.row[strong]]] == 1]
        hidden += [d for i in np.unique(strong) for d in disguised(u.data[u.start[i] : u.end[i]].tobytes(), 1)[:1]]
    z, label = np.concatenate(z), y[own]
    if hidden:
        data, end = np.frombuffer(b"".join(hidden), np.uint8), np.cumsum([len(w) for w in hidden])
        z, label = np.append(z, model.of(data, end - np.array([len(w) for w in hidden]), end)), np.append(label, np.ones(len(hidden), int))
    model.a, model.b = platt(_flattened(z), label)
    if prior is not None and 0 < prior < 1:
        model.b += float(np.log(prior / (1 - prior)) - np.log(label.mean() / (1 - label.mean())))
    # 0.5 lies no lower than half way from the highest harmless text to the SVM's boundary, or than that text where it is beyond
    most = float(_flattened(z[label == 0]).max(initial=-1.0))
    if model.a > 0:
        model.b = min(model.b, -model.a * (most + max(most, 0.0)) / 2 - 1e-6)
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text divides by 5. A null id never trains either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each row of documents with its score (0 to 1) and prediction.

    Null and empty texts score as a text without words does. Ids, languages and
    sources are not inputs of the score; other columns of documents are not
    read. A row counts as often as it occurs. Texts are read whole.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # LANDMARKS words, whatever the input

    def score(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                p = shipped.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, SCHEMA)


def trained(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    prior = known.agg(F.avg("toxic")).first()[0]
    model = fit(labelled_sample(documents, known, "toxic", SAMPLE_PER_CLASS), prior)
    model.__dict__.pop("memory", None)  # weights of words, which the fit has filled; workers have their own
    released()
    return model


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, trained(documents, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that the model doesn't reject. The model is fitted on the documents given."""
    model = trained(docs, table(spark, sf_dir, "labels"))
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def clean(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(shipped.value.score(data, offsets) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
