"""License scans: ordered signature rules.

A rule (license_rules.py) is a regular expression with a priority, a label and a
confidence. Its keywords are read off its syntax: literals without white space of
which any match must hold one, so the prefilter can't hide a match. A text is
searched with a rule only if it holds one of the rule's keywords, and at all only
if it holds one of a few gates that cover all keywords and are looked for in the
bytes of a whole block at once. Detections are taken in the order of priority;
one whose interval lies within that of a taken detection, or overlaps it, is
suppressed, so "Attribution-NonCommercial" is not "Attribution" as well.

Beside the rules stands the base search: places where the words of a phrase of
PHRASES stand one after another, whatever lies between the words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import Words, blocks
from .license_rules import gates, rules
from .storage import table

#: Phrases of the base search and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@lru_cache(maxsize=1)
def keywords() -> list[str]:
    return sorted({k for r in rules() for k in r.keywords})


def scan(text: str, prefilter: bool = True) -> list[tuple[str, int, int, float]]:
    """Detections (label, start, end, confidence) in a lower-cased text, in the order of their starts."""
    present = {k for k in keywords() if k in text} if prefilter else set(keywords())
    taken: list[tuple[str, int, int, float]] = []
    for r in rules():
        if present.isdisjoint(r.keywords):
            continue
        for m in r.pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for _, s, e, _ in taken):
                taken.append((r.label, m.start(), m.end(), r.confidence))
    return sorted(taken, key=lambda d: (d[1], -d[2], d[0]))


#: Word characters of the base search: digits, a-z, and all that isn't ASCII.
_APART = np.ones(256, bool)
_APART[0x30:0x3A] = _APART[0x61:0x7B] = _APART[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@lru_cache(maxsize=1)
def _phrase_hashes() -> list[tuple[np.ndarray, str]]:
    out = []
    for phrase, label in PHRASES.items():
        w = Words(data := np.frombuffer(phrase.encode(), np.uint8), np.array([0, len(data)]), _APART)
        out.append((w.hashes(), label))
    return out


def _rows_with(data: bytes, offsets: np.ndarray, needles: list[bytes]) -> np.ndarray:
    found = np.zeros(len(offsets) - 1, bool)
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(needle) <= offsets[row + 1]:
                found[row] = True
                at = data.find(needle, int(offsets[row + 1]))
            else:
                at = data.find(needle, at + 1)
    return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,confidence:double>>"
_DETECTIONS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def licenses(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: base counts, labels, and the detections with their intervals (code points).

    The score is that of the surest detection; a text with base places but no
    detection has 0.5, one with neither has 0 and empty labels. Null texts count
    as empty. A row counts as often as it occurs, a null doc_id stays null, and
    other columns are not read. Texts are read whole.
    """

    def find(batches):
        for batch in batches:
            for lo, hi, raw, offsets in blocks(batch.column(1)):
                yield from _block(batch.column(0).slice(lo, hi - lo), _LOWER[raw], offsets)

    def _block(ids, data, offsets):
        n = len(offsets) - 1
        w = Words(data, offsets, _APART)
        h = w.hashes()
        starts, labels = [], [set() for _ in range(n)]
        for phrase, label in _phrase_hashes():
            at = np.flatnonzero(h == phrase[0])
            for i in range(1, len(phrase)):
                at = at[at + i < len(h)]
                at = at[(h[at + i] == phrase[i]) & (w.row[at + i] == w.row[at])]
            starts.append(at)
            for r in np.unique(w.row[at]):
                labels[r].add(label)
        at = np.concatenate(starts)
        row = w.row[at]
        count = np.bincount(row, minlength=n)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(first, row, at - w.first[row])
        np.maximum.at(last, row, at - w.first[row])
        base = [",".join(sorted(s)) for s in labels]
        score, found = np.where(count > 0, 0.5, 0.0), [[] for _ in range(n)]
        whole = data.tobytes()
        for r in np.flatnonzero(_rows_with(whole, offsets, gates())):
            got = scan(whole[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"))
            if got:
                found[r] = [{"label": a, "start": s, "end": e, "confidence": c} for a, s, e, c in got]
                labels[r] |= {x[0] for x in got}
                score[r] = max(score[r], max(x[3] for x in got))
        none = count == 0
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(w.count, pa.int64()), pa.array(count, pa.int64()), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array(base, pa.string()),
             pa.array([",".join(sorted(s)) for s in labels], pa.string()), pa.array(score), pa.array(found, _DETECTIONS)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(find, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
