"""Substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words. The index consists of immutable runs,
each a table in buckets by fingerprint and sorted within them; documents come in
batches in the order of doc_id, a batch is merge-joined with each run, then
becomes a run itself, and more than MAX_RUNS runs are compacted into one.

Not every window is stored. Of the GRAM-word grams of a window the one of the
least hash is its anchor; equal windows have the same anchor at the same place,
and neighbouring windows mostly share theirs, so there is about one anchor for
nine words. The windows of an anchor form a run of starts, whose words are
hashed as one span. An entry is (anchor, span, document, start, windows).

1. An anchor whose (anchor, span) is in the index, or came earlier in the batch,
   repeats all of its windows.
2. Where an anchor stands in several different spans - at the ends of repeated
   passages - the windows themselves are hashed, for the first document of each
   such span only, and compared one by one.
3. Hits are verified word by word: those of one document and one earlier place
   are joined to passages, and each passage is compared with the one that it is
   held to repeat. Hashes of two different byte tables and bases make a wrong hit
   a matter of 2^-64; should there be one, the index is built again with other
   hashes, and hits that still differ are dropped.

Rows are combined on the map side or joined by hash, so neither a passage in a
third of all documents nor a huge group of copies meets in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .kernels import Words, blocks, mix, running, signed, span_hash
from .storage import NO_ID, drop, fresh, session, swept, table, written

WINDOW, GRAM = 20, 5
#: Batches of the query; and runs that the index may have.
BATCHES, MAX_RUNS = 3, 1
#: Times that an index is built with other hashes.
SEEDS = 3
#: Bits of the hashes of each seed, all of them but in tests.
BITS = (64, 64, 64)
_ENTRY = "anchor long, span long, doc long, start int, more int"


class Collision(Exception):
    """Different words of the same hashes."""


def _seeded(h: np.ndarray, seed: int) -> np.ndarray:
    h = mix(h + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))) if seed else h
    return h if BITS[seed] == 64 else h & np.uint64((1 << BITS[seed]) - 1)


def _anchors(w: Words, seed: int = 0) -> tuple[np.ndarray, ...]:
    """For each anchor: its hash, the hash of its span, its row, the first start of its windows in words of the row, and the windows after the first."""
    none = np.zeros(0, np.int64)
    first = w.windows(WINDOW)
    if not len(first):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h, h2 = w.hashes(), w.hashes(second=True)
    gram = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(len(h) - GRAM + 1)
    gram[: len(at)] = span_hash(running(h), at, at + GRAM)
    width = WINDOW - GRAM + 1
    best = np.lib.stride_tricks.sliding_window_view(gram, width)
    place = np.empty(len(first), np.int64)
    for lo in range(0, len(first), 1 << 16):
        s = first[lo : lo + (1 << 16)]
        place[lo : lo + (1 << 16)] = s + best[s].argmin(axis=1)
    row = w.row[first]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(first)) - 1
    a, b, p = first[new], first[last], place[new]
    span = mix(span_hash(running(h2, second=True), a, b + WINDOW, second=True) + (p - a).astype(np.uint64) * np.uint64(64) + (b - a).astype(np.uint64))
    return _seeded(gram[p], seed), _seeded(span, seed), row[new], a - w.first[row[new]], b - a


def entries(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The anchors of docs (doc, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in blocks(batch.column(1)):
                anchor, span, row, start, more = _anchors(Words(data, offsets), seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(span)), pa.array(ids[lo + row], pa.int64()), pa.array(start.astype(np.int32)), pa.array(more.astype(np.int32))], ["anchor", "span", "doc", "start", "more"])

    return docs.mapInArrow(run, _ENTRY)


def _window_hashes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(h1, h2, doc, start, new) of the windows asked for: docs has doc, text and asked (start, more, new)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(2)
            bounds, flat = asked.offsets.to_numpy().astype(np.int64), asked.values
            start, more, new = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                s1, s2 = running(w.hashes()), running(w.hashes(second=True), second=True)
                part = slice(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                n = more[part].astype(np.int64) + 1
                each = np.repeat(np.arange(len(n)), n)
                at = start[part].astype(np.int64)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                ok = at + WINDOW <= w.count[row[each]]  # else another row of the same doc_id was meant
                each, at = each[ok], at[ok]
                r = row[each]
                a = w.first[r] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(_seeded(span_hash(s1, a, a + WINDOW), seed))), pa.array(signed(_seeded(span_hash(s2, a, a + WINDOW, second=True), seed))), pa.array(ids[lo + r], pa.int64()), pa.array(at.astype(np.int32)), pa.array(new[part][each])],
                    ["h1", "h2", "doc", "start", "new"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, start int, new boolean")


def _cut(w: Words, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words [start[i], stop[i]) of the block with a blank after each, one span after another, and where each begins."""
    n = stop - start
    word = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    begin, length = w.start[word], (w.end - w.start)[word] + 1
    ends = np.cumsum(length)
    index = np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    text = w.data[np.minimum(index, max(0, len(w.data) - 1))]
    text[ends - 1] = 0x20
    return text, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]


def _passages(docs: DataFrame) -> DataFrame:
    """(d, s, n, doc, start, words) of the passages asked for: docs has doc, text and asked (start, n, d, s)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(2)
            bounds, flat = asked.offsets.to_numpy().astype(np.int64), asked.values
            start, n, d, s = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                each = np.arange(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                ok = start[each] + n[each] <= w.count[row]  # else another row of the same doc_id was meant
                each, row = each[ok], row[ok]
                for k in range(0, len(each), 4096):  # passages of a document may overlap
                    e, r = each[k : k + 4096], row[k : k + 4096]
                    text, cut = _cut(w, w.first[r] + start[e], w.first[r] + start[e] + n[e])
                    whole = text.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d[e]), pa.array(s[e]), pa.array(n[e]), pa.array(ids[lo + r], pa.int64()), pa.array(start[e]), pa.array([whole[x:y] for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                        ["d", "s", "n", "doc", "start", "words"])

    return docs.mapInArrow(run, "d long, s long, n long, doc long, start long, words binary")


class Index:
    """The log-structured index. Batches must come in the order of doc_id, since what the index holds counts as earlier.

    folder: where the runs lie; an index that an earlier session left there is
    taken up. Without one the index lies in the shared folder and is new.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, seed: int = 0):
        self.spark, self.seed = spark, seed
        self.folder = folder or fresh(spark, "substr-index")
        self.runs: list[tuple[str, str, int]] = []  # table, path, buckets
        if folder:
            fs, path = self._fs()
            for f in sorted(str(x.getPath()) for x in fs.listStatus(path)) if fs.exists(path) else ():
                _, seed, buckets, name = f.rsplit("/", 1)[1].split("-")
                self.seed = int(seed)
                self._register(name, f, int(buckets))

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _register(self, name: str, path: str, buckets: int) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_ENTRY}) USING parquet CLUSTERED BY (anchor, span) SORTED BY (anchor, span) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.runs.append((name, path, buckets))

    def _write(self, new: DataFrame) -> None:
        """A run: one sorted file for each bucket."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"substr_run_{fresh(self.spark, '').rsplit('-', 1)[1]}"
        path = f"{self.folder}/run-{self.seed}-{buckets}-{name}"
        with swept(self.spark):
            new.repartition(buckets, "anchor", "span").write.format("parquet").option("path", path).bucketBy(buckets, "anchor", "span").sortBy("anchor", "span").saveAsTable(name)
        self.runs.append((name, path, buckets))

    def _remove(self, runs: list[tuple[str, str, int]]) -> None:
        for name, _, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, *[path for _, path, _ in runs])

    def remove(self) -> None:
        self._remove(self.runs)
        self.runs = []

    def history(self) -> DataFrame:
        out = self.spark.createDataFrame([], _ENTRY)
        for name, _, _ in self.runs:
            out = out.unionByName(self.spark.table(name))
        return out

    def add(self, docs: DataFrame, store: DataFrame) -> tuple[DataFrame, list[str]]:
        """Adds docs (doc, text). Gives (doc, start, stop): ranges of words that earlier windows cover, and the tables they lie in.

        store: (doc, text) of this and all earlier batches, where the locators point to.
        """
        spark = self.spark
        rows, staged = written(entries(docs, self.seed), "substr-entries")
        first = rows.groupBy("anchor", "span").agg(F.min(F.struct("doc", "start", "more")).alias("f"), F.count(F.lit(1)).alias("n"))
        places = []
        for i, (name, _, _) in enumerate(self.runs):  # an entry is in one run at most
            run = spark.table(name).select("anchor", "span", F.struct(F.col("doc").alias("d"), F.col("start").alias("s")).alias(f"o{i}"))
            first = first.join(run.hint("merge"), ["anchor", "span"], "left")
            places.append(F.col(f"o{i}"))
        old = F.coalesce(*places) if places else F.lit(None).cast("struct<d:long,s:int>")
        with session(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            first, grouped = written(first.select("anchor", "span", "f.*", "n", old.alias("old")), "substr-grouped")

        again = first.where("old IS NOT NULL OR n > 1").select("anchor", "span", F.coalesce("old.d", "doc").alias("d"), F.coalesce("old.s", "start").alias("s"))
        whole = rows.join(again, ["anchor", "span"]).where("doc <> d OR start <> s").select("doc", "start", (F.col("start") + F.col("more") + WINDOW).alias("stop"), "d", "s")
        _, dup1 = written(whole, "substr-repeats")
        drop(spark, staged)

        new = first.where("old IS NULL").select("anchor", "span", "doc", "start", "more")
        entries_now = new.withColumn("new", F.lit(True)).unionByName(self.history().withColumn("new", F.lit(False)))
        shared = entries_now.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("any")).where("n > 1 AND any").select("anchor")
        edges = entries_now.join(shared, "anchor", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("start", "more", "new")).alias("asked"))
        windows, hashed = written(_window_hashes(store.join(edges.hint("merge"), "doc").select("doc", "text", "asked"), self.seed), "substr-windows")
        least = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", F.col("f.doc").alias("d"), F.col("f.start").alias("s"))
        single = windows.where("new").join(least, ["h1", "h2"]).where("doc <> d OR start <> s").select("doc", "start", (F.col("start") + WINDOW).alias("stop"), "d", "s")
        _, dup2 = written(single, "substr-ends")
        drop(spark, hashed)

        hits = spark.read.schema("doc long, start int, stop int, d long, s int").parquet(dup1, dup2)
        good, verified = self._verified(hits, store)
        self._write(new)
        drop(spark, grouped, dup1, dup2)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return good, [verified]

    def _verified(self, hits: DataFrame, store: DataFrame) -> tuple[DataFrame, str]:
        """hits (doc, start, stop, d, s) as passages (doc, start, stop) whose words are those at (d, s)."""
        spark = self.spark
        line = Window.partitionBy("doc", "d", F.col("s") - F.col("start")).orderBy("start", "stop")
        reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
        marked = hits.withColumn("begins", F.when(F.col("start") <= reach, 0).otherwise(1))
        marked = marked.withColumn("island", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("off", F.col("s") - F.col("start"))
        joined = marked.groupBy("doc", "d", "off", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        passages, path = written(joined.select("doc", "start", "stop", "d", (F.col("start") + F.col("off")).alias("s")), "substr-passages")
        own = passages.select("doc", "start", (F.col("stop") - F.col("start")).alias("n"), "d", "s")
        both = own.unionByName(own.select("d", "s", "n").distinct().select(F.col("d").alias("doc"), F.col("s").alias("start"), "n", "d", "s"))
        asked = both.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "d", "s")).alias("asked"))
        said = _passages(store.join(asked.hint("merge"), "doc").select("doc", "text", "asked"))
        wrong, p_wrong = written(said.groupBy("d", "s", "n").agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a <> b").select("d", "s", "n"), "substr-wrong")
        if wrong.isEmpty():
            drop(spark, p_wrong)
            return passages.select("doc", "start", "stop"), path
        if self.seed + 1 < SEEDS:
            drop(spark, p_wrong, path)
            raise Collision
        # the ids are to blame: rows of one doc_id and several texts
        differ = said.join(wrong, ["d", "s", "n"])
        source = differ.where("doc = d AND start = s").select("d", "s", "n", F.col("words").alias("told"))
        right = differ.join(source, ["d", "s", "n"]).where("words = told").select("doc", "start", "n", "d", "s").distinct()
        plain = own.join(wrong, ["d", "s", "n"], "left_anti").unionByName(right.select("doc", F.col("start").cast("int"), F.col("n").cast("int"), "d", F.col("s").cast("int")).where("doc <> d OR start <> s"))
        good, p_good = written(plain.select("doc", "start", (F.col("start") + F.col("n")).alias("stop")), "substr-passages")
        drop(spark, p_wrong, path)
        return good, p_good

    def compact(self) -> None:
        """Merges all runs into one."""
        old, self.runs = self.runs, []
        merged = self.spark.createDataFrame([], _ENTRY)
        for name, _, _ in old:
            merged = merged.unionByName(self.spark.table(name))
        self._write(merged)
        self._remove(old)


def _kept(docs: DataFrame) -> DataFrame:
    """The digest columns of docs (doc_id, text, ranges)."""

    def run(batches):
        for batch in batches:
            ranges = batch.column(2)
            if ranges.null_count:
                bounds = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in ranges])])
                flat = ranges.flatten()
            else:
                bounds, flat = ranges.offsets.to_numpy().astype(np.int64), ranges.values
            begin, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                part = slice(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                cover = np.zeros(len(w.start) + 1, np.int64)
                top = w.first[row + 1]
                np.add.at(cover, np.minimum(w.first[row] + begin[part], top), 1)
                np.add.at(cover, np.minimum(w.first[row] + stop[part], top), -1)
                keep = np.cumsum(cover[:-1]) == 0
                removed = np.concatenate([[0], np.cumsum(~keep)])
                word = np.flatnonzero(keep)
                text, ends = _cut(w, word, word + 1)
                cut = ends[np.concatenate([[0], np.cumsum(keep)])[w.first]]
                whole = text.tobytes()
                digests = [hashlib.sha256(whole[cut[r] : max(cut[r], cut[r + 1] - 1)]).hexdigest() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.count, pa.int64()), pa.array(np.diff(removed[w.first]), pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeats(documents: DataFrame, batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """(doc, ranges): for each document with repeated windows the ranges of words that they cover.

    documents: (doc, text). A window is repeated if its words also start
    earlier: in a document of smaller doc_id, or earlier in the same one.
    folder keeps the index, which else goes at the end.
    """
    spark = documents.sparkSession
    cuts = documents.selectExpr(f"percentile_approx(doc, array({', '.join(str(i / batches) for i in range(1, batches))}))").first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []))
    for seed in range(SEEDS):
        index, paths = Index(spark, folder, seed), []
        try:
            for lo, hi in zip([None, *edges], [*edges, None]):
                upto = documents if hi is None else documents.where(F.col("doc") <= hi)
                _, made = index.add(upto if lo is None else upto.where(F.col("doc") > lo), upto)
                paths += made
            break
        except Collision:
            index.remove()
            drop(spark, *paths)
    found = spark.read.schema("doc long, start int, stop int").parquet(*paths)
    ranges, _ = written(found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "substr-ranges")
    drop(spark, *paths)
    if not folder:
        index.remove()
    return ranges


def substring_dedup(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of documents: its words, how many of them are removed, and the hash of the rest.

    Null and empty texts have no words; the hash is that of the empty text.
    Texts of fewer than WINDOW words lose nothing. A null doc_id counts as the
    smallest. Rows that repeat a doc_id and a text repeat no window by each
    other, since theirs start at the same place of the same document; give
    different texts different ids. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    return _kept(docs.join(repeats(docs.select("doc", "text"), batches), "doc", "left").select("doc_id", "text", "ranges"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
g AS (SELECT doc_id, p, string_agg(word, ' ') OVER o AS k, count(*) OVER o AS n FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM g WHERE n = {WINDOW}),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM f WHERE r > 1),
k AS (SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
