"""Line dedup by a deletion-neighbourhood join.

A line (trimmed, of at least MIN_CHARS code points) goes if an equal line, or
one within MAX_EDITS = 1 edit, stands earlier in the corpus, in the order of
doc_id and line; the earliest stays. Lines are judged on the input.

1. Equal lines are folded by a 128-bit hash, with the first place of each.
2. Lines within one edit share, unchanged, the left or the right half of the
   shorter one. Lines whose halves no other line shares have no neighbour, so
   only the others go on. Each line is looked up under its own length and, as
   the longer one of a pair, under the length below.
3. Those emit their deletion neighbourhood: for every position the hash of the
   line without that character, and the hash of the whole line. Lines with the
   same variant at the same position differ by one replaced character; a whole
   line that equals a variant differs by one inserted character. So the earliest
   line of each variant is the only one to compare with: a group of n lines
   costs n rows, never n * n.
4. The edit distance of each line and the earlier one it met is verified.

What grows with the corpus is joined by sorting on both sides, at every size, and
never broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import SPACE, blocks, byte_sums, lines, mix, powers, running, signed, span_hash
from .storage import NO_ID, drop, table, written

MIN_CHARS, MAX_EDITS = 20, 1
_U = np.uint64


def _trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at their ends; blank ones are empty."""
    full = np.flatnonzero(~SPACE[data])
    if not len(full):
        return start, start
    left = full[np.minimum(np.searchsorted(full, start), len(full) - 1)]
    right = full[np.maximum(np.searchsorted(full, end) - 1, 0)] + 1
    blank = (left < start) | (left >= end)
    return np.where(blank, start, left), np.where(blank, start, right)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc, line, halves) of the lines that count, of docs (doc, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                start, end, row = lines(data, offsets)
                number = np.arange(len(start)) - np.searchsorted(row, np.arange(hi - lo))[row]
                start, end = _trimmed(data, start, end)
                chars = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
                first = np.searchsorted(chars, start)
                n = np.searchsorted(chars, end) - first
                ok = np.flatnonzero(n >= MIN_CHARS)
                start, end, row, number, first, n = (x[ok] for x in (start, end, row, number, first, n))
                at = np.append(chars, len(data))
                sums = byte_sums(data)
                halves = np.empty((len(ok), 4), _U)
                for k, m in ((0, n), (2, n - 1)):  # as a line of its own length, and as the longer one of a pair
                    left, right = m // 2, m - m // 2
                    halves[:, k] = mix(span_hash(sums, start, at[first + left]) + m.astype(_U) * _U(2))
                    halves[:, k + 1] = mix(span_hash(sums, at[first + n - right], end) + m.astype(_U) * _U(2) + _U(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(span_hash(sums, start, end))), pa.array(signed(span_hash(byte_sums(data, True), start, end, True))), pa.array(ids[lo + row], pa.int64()), pa.array(number.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1) * 4, pa.int32()), pa.array(signed(halves.ravel())))],
                    ["h1", "h2", "doc", "line", "halves"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, line int, halves array<long>")


def variants(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its deletion neighbourhood: number of the text, position of the deleted character (-1: none), hash."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U)
    n = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    sums = running(mix(points + _U(1)))
    up, down = powers(len(sums))
    text = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(points))
    a, b, local = first[text], first[text + 1], i - first[text]
    without = (sums[i] - sums[a]) * down[a] + (sums[b] - sums[i + 1]) * down[i + 1] * up[local]
    whole = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
    return (np.concatenate([text, np.arange(len(n))]), np.concatenate([local, np.full(len(n), -1)]),
            np.concatenate([mix(without + (n[text] - 1).astype(_U)), mix(whole + n.astype(_U))]))


def _neighbourhoods(docs: DataFrame) -> DataFrame:
    """(variant, pos, doc, line, text) of the lines asked for: docs has doc, text and asked (line numbers). Only whole lines have a text."""

    def run(batches):
        for batch in batches:
            ids, texts, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            doc, line, found, size = [], [], [], 0
            for r in range(len(ids) + 1):
                if r < len(ids):
                    pieces = (texts[r] or "").split("\n")
                    for k in sorted(set(asked[r])):
                        t = pieces[k].strip(" \t\n\x0b\x0c\r") if k < len(pieces) else ""
                        if len(t) >= MIN_CHARS:  # else another row of the same doc_id was meant
                            doc.append(ids[r]), line.append(k), found.append(t)
                            size += len(t)
                if found and (size > 1 << 18 or r == len(ids)):
                    which, pos, variant = variants(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(variant)), pa.array(pos.astype(np.int32)), pa.array(np.array(doc, np.int64)[which]), pa.array(np.array(line, np.int32)[which]),
                         pa.array([None] * (len(which) - len(found)) + found, pa.string())],
                        ["variant", "pos", "doc", "line", "text"])
                    doc, line, found, size = [], [], [], 0

    return docs.mapInArrow(run, "variant long, pos int, doc long, line int, text string")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, gone) of docs (doc, text): the numbers of the lines to remove, for documents that have any."""
    spark = docs.sparkSession
    occurrences, p_all = written(_occurrences(docs), "line-all")
    distinct = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", "halves")).alias("f"), F.count(F.lit(1)).alias("n")).select("h1", "h2", "f.*", "n")
    distinct, p_distinct = written(distinct, "line-distinct")

    halves = distinct.select(F.explode("halves").alias("half"), "h1", "doc", "line")
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    asked = halves.join(shared.hint("merge"), "half", "left_semi").groupBy("doc").agg(F.collect_set("line").alias("asked"))
    rows, p_rows = written(_neighbourhoods(docs.join(asked.hint("merge"), "doc").select("doc", "text", "asked")), "line-variants")

    place = F.struct("doc", "line")
    twice = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("variant")
    some, p_some = written(rows.join(twice.hint("merge"), "variant", "left_semi"), "line-common")
    common = some.groupBy("variant").agg(F.min(F.when(F.col("pos") < 0, place)).alias("whole"), F.min(F.when(F.col("pos") >= 0, place)).alias("cut"))
    same = some.where("pos >= 0").groupBy("variant", "pos").agg(F.min(place).alias("first"))
    some = some.select("variant", "pos", "doc", "line").join(common.hint("merge"), "variant").join(same.hint("merge"), ["variant", "pos"], "left")
    met = some.select("doc", "line", F.explode(F.when(F.col("pos") < 0, F.array("cut")).otherwise(F.array("whole", "first"))).alias("w")).where("w IS NOT NULL").where(F.col("w") < place)
    met = met.select("doc", "line", F.col("w.doc").alias("d"), F.col("w.line").alias("l")).distinct()
    texts = rows.where("pos < 0").select("doc", "line", "text")
    pairs = met.hint("merge").join(texts, ["doc", "line"]).join(texts.select(F.col("doc").alias("d"), F.col("line").alias("l"), F.col("text").alias("other")).hint("merge"), ["d", "l"])
    near = pairs.where(F.levenshtein("text", "other", MAX_EDITS) >= 0).select("doc", "line").distinct()
    near, p_near = written(near, "line-near")
    drop(spark, p_rows, p_some)

    later = distinct.select("h1", "h2", "doc", "line", "n").join(near.withColumn("near", F.lit(True)).hint("merge"), ["doc", "line"], "left").where("n > 1 OR near")
    later = later.select("h1", "h2", F.col("doc").alias("d"), F.col("line").alias("l"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = occurrences.select("h1", "h2", "doc", "line").join(later.hint("merge"), ["h1", "h2"]).where("near OR doc <> d OR line <> l").groupBy("doc").agg(F.collect_set("line").alias("gone"))
    gone, _ = written(gone, "line-gone")
    drop(spark, p_all, p_distinct, p_near)
    return gone


def without_lines(text: str | None, gone: list[int] | None) -> tuple[str, int, int]:
    """The text without these lines, its number of lines before, and of lines removed."""
    if not text:
        return "", 0, 0
    pieces, numbers = text.split("\n"), set(gone or ())
    kept = [x for i, x in enumerate(pieces) if i not in numbers]
    return "\n".join(kept), len(pieces), len(pieces) - len(kept)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def line_dedup(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: its lines, those removed, the text that stays and its hash.

    Null and empty texts have no lines; blank and short lines always stay. A
    null doc_id counts as the smallest. Rows that repeat a doc_id and a text
    hold the same lines at the same places and don't repeat each other. Other
    columns are not read; an empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))

    def run(batches):
        for batch in batches:
            got = [without_lines(t, g) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in got], pa.string()), pa.array([x[0] for x in got], pa.string())],
                ["doc_id", "n_lines", "n_removed", "kept_sha256", "text"])

    out = docs.join(removed_lines(docs.select("doc", "text")).hint("merge"), "doc", "left").select("doc_id", "text", "gone")
    return out.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents without repeated lines; those of which only blanks would be left go. n_chars follows the text."""
    gone = removed_lines(_keyed(docs)).withColumnsRenamed({"doc": "__line_doc", "gone": "__line_gone"})
    joined = docs.join(gone.hint("merge"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == gone["__line_doc"], "left")
    pieces = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("__line_gone"), i)), "\n")
    out = joined.withColumn("text", F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(left))
    out = out.where(F.col("__line_gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__line_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents WHERE text <> ''),
t AS (SELECT doc_id, raw, p, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l),
u AS (SELECT s, min((doc_id, p)) AS place, length(s) AS n FROM t WHERE length(s) >= {MIN_CHARS} GROUP BY s),
m AS (SELECT *, unnest([n, n - 1]) AS m FROM u),
h AS (SELECT s, place, n, m, 'left' AS side, substr(s, 1, m // 2) AS half FROM m UNION ALL SELECT s, place, n, m, 'right', right(s, m - m // 2) FROM m),
pairs AS (SELECT DISTINCT a.s AS a, a.n AS x, b.s AS b, b.n AS y FROM h a JOIN h b ON b.m = a.m AND b.side = a.side AND b.half = a.half AND b.place < a.place WHERE abs(a.n - b.n) <= 1 AND levenshtein(a.s, b.s) <= 4),
near AS (SELECT DISTINCT a AS s FROM pairs WHERE len(list_filter(range(greatest(x, y)), lambda i: substr(a, 1, i) = substr(b, 1, i) AND CASE WHEN x = y THEN substr(a, i + 2) = substr(b, i + 2) WHEN x > y THEN substr(a, i + 2) = substr(b, i + 1) ELSE substr(a, i + 1) = substr(b, i + 2) END)) > 0),
g AS (SELECT t.*, coalesce(near.s IS NOT NULL OR (t.doc_id, t.p) <> u.place, false) AS gone FROM t LEFT JOIN u ON u.s = t.s LEFT JOIN near ON near.s = t.s),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
