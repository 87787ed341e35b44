"""Quality rules: counted base rules, and a calibrated n-gram classifier scored in Arrow batches.

The classifier is a logistic regression on hashed word 1- and 2-grams and
character 3- and 4-grams, each family normalised by its number of n-grams, so the score
doesn't depend on length. It is fitted on the driver on a bounded sample of
labelled rows (SAMPLE_PER_CLASS rows of each class), calibrated by Platt's
method on a fifth of the sample that the fit doesn't see, and shipped to the
executors as one array of DIMS weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import SPACE, Words, blocks, byte_sums, lines, mix, running, span_hash
from .learning import fit_sparse, labelled_sample, platt, sigmoid
from .storage import table

#: Buckets of the hashed n-grams, by family: words 1, words 2, characters 3, characters 4.
BITS = 16
DIMS = 4 << BITS
#: Labelled rows of each class that the fit may use.
SAMPLE_PER_CLASS = 1500
#: Fixed thresholds: words, share of repeated words in percent, probability of good quality.
MIN_WORDS, MAX_REPEATED, MIN_GOOD = 50, 50, 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64


def _grams(w: Words):
    """For each family: the bucket of each n-gram, and where each row's n-grams begin (rows + 1 entries)."""
    top = _U(64 - BITS)
    h, bounds = w.hashes(), np.arange(len(w.offsets))
    yield (h >> top).astype(np.int64), w.first
    two = w.windows(2)
    h2 = span_hash(running(h), two, two + 2) if len(two) else np.zeros(0, _U)
    yield (h2 >> top).astype(np.int64) + (1 << BITS), np.searchsorted(w.row[two], bounds)
    at = np.flatnonzero((w.data & 0xC0) != 0x80)  # where each character begins
    chars = np.searchsorted(at, w.offsets)
    at, sums = np.append(at, len(w.data)), byte_sums(w.data)
    for k, family in ((3, 2), (4, 3)):
        keep = np.ones(max(0, len(at) - k), bool)
        for i in range(1, k):  # n-grams that reach into the next row
            edge = chars[1:-1] - i
            keep[edge[(edge >= 0) & (edge < len(keep))]] = False
        i = np.flatnonzero(keep)
        yield (span_hash(sums, at[i], at[i + k]) >> top).astype(np.int64) + (family << BITS), np.searchsorted(i, chars)


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


@dataclass
class QualityModel:
    weights: np.ndarray  # DIMS + 1, the last is the bias
    a: float
    b: float

    def raw(self, w: Words) -> np.ndarray:
        z = np.full(len(w.offsets) - 1, self.weights[-1], np.float64)
        for bucket, first in _grams(w):
            z += _row_sums(self.weights[bucket], first) / np.maximum(1, np.diff(first))
        return z

    def good(self, w: Words) -> np.ndarray:
        return sigmoid(self.a * self.raw(w) + self.b)


def fit(sample: list[tuple[int, str, int]], prior: float | None = None) -> QualityModel:
    """prior: share of good rows among all labels, for which the probabilities are calibrated. Without labels of both classes, a model that finds every text good."""
    y = np.array([x[2] for x in sample], int)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(DIMS + 1, np.float32), 0.0, 8.0)
    rows, cols, vals, at = [], [], [], 0
    for lo, hi, data, offsets in blocks(pa.array([x[1] for x in sample], pa.large_string())):
        w = Words(data, offsets)
        for bucket, first in _grams(w):
            n = np.diff(first)
            key, count = np.unique(np.repeat(np.arange(hi - lo, dtype=np.int64), n) * DIMS + bucket, return_counts=True)
            r = key // DIMS
            rows.append((r + lo).astype(np.int32))
            cols.append((key % DIMS).astype(np.int32))
            vals.append((count / n[r]).astype(np.float32))
    row, col, val = map(np.concatenate, (rows, cols, vals))
    held = mix(np.array([x[0] for x in sample], np.int64).view(_U)) % _U(5) == 0
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        held = np.zeros(len(y), bool)
    use = ~held[row]
    renumber = np.cumsum(~held) - 1
    weights = fit_sparse(renumber[row[use]], col[use], val[use], y[~held], DIMS, steps=70).astype(np.float32)
    z = np.bincount(row, weights[col] * val, len(y)) + weights[-1]
    own = held if held.any() else ~held
    a, b = platt(z[own], y[own])
    if prior is not None and 0 < prior < 1:
        b += np.log(prior / (1 - prior)) - np.log(y[own].mean() / (1 - y[own].mean()))
    return QualityModel(weights, a, b)


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules, for each row."""
    n, offsets, data = len(w.offsets) - 1, w.offsets, w.data

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = per_row(~SPACE[data] & ((data & 0xC0) != 0x80))
    sums = byte_sums(data)
    start, end, row = lines(data, offsets)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    salt = mix(row.astype(_U) + _U(1))
    distinct = np.unique(span_hash(sums, start, end) ^ salt, return_index=True)[1]
    dup = np.bincount(row, minlength=n) - np.bincount(row[distinct], minlength=n)
    three, covered = w.windows(3), np.zeros(len(w.start) + 1, np.int64)
    if len(three):
        key = span_hash(running(w.hashes()), three, three + 3) ^ mix(w.row[three].astype(_U) + _U(1))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = three[count[back] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return {"n_words": w.count, "word_chars": chars, "n_symbols": per_row(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]]}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, good double, kept boolean"


def quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """One row for each row of documents: its counts, whether the base rules fail it, its probability of good quality, and the verdict.

    Null and empty texts have no words, so the base rules fail them. A row
    counts as often as it occurs; a null doc_id stays null. Other columns of
    documents are not read. Texts are read whole; a block holds about
    kernels.BLOCK bytes, or one longer text.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # DIMS weights, whatever the input

    def score(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                c = base_counts(w)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
                good = shipped.value.good(w)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array(c[k], pa.int64()) for k in c), pa.array(failed), pa.array(good), pa.array(~failed & (good >= MIN_GOOD))],
                    ["doc_id", *c, "base_failed", "good", "kept"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(score, SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    prior = labels.where("quality IN (0, 1)").agg({"quality": "avg"}).first()[0]
    return quality(documents, fit(labelled_sample(documents, labels, "quality", SAMPLE_PER_CLASS), prior))
