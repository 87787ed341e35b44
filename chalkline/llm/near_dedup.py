"""Near-dedup by ProbMinHash on weighted shingles, banding and verification.

A text is a weighted set of its 5-word shingles; a shingle that stands n times
weighs 1 + ln n. Every shingle starts a Poisson process whose rate is its
weight; each arrival hits one of COMPONENTS components at random, and the
component keeps the shingle that hit it first. The shingles of all rows of a
block advance by one arrival at a time, and a process ends as soon as it is
later than the latest of its row's components. Two texts agree in a component
with the probability Jaccard similarity of their weights.

Texts of the same words are one node from the start. Nodes that agree in a band
of ROWS components share a bucket. Buckets of up to SMALL nodes are verified
pair by pair. In a larger one the node that meets most others in all its
buckets leads, and the members are verified against it, which finds the centre
of a group of near copies. Buckets that then still hold several classes are cut
into blocks of about BLOCK nodes, and all pairs of nodes of two classes are
verified, block against block, each pair in the first band that it shares; the
blocks of a bucket's largest class don't meet each other. So every pair that
shares a bucket is verified or in one class already, and a text is sent once for
each block that it meets instead of once for each node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .kernels import Words, blocks, mix, running, signed, span_hash
from .storage import NO_ID, drop, table, with_group, written

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability 7e-5.
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
SMALL, BLOCK = 8, 64
_U = np.uint64


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the different shingles of each row, ordered by row; a text of fewer than SHINGLE words is one shingle."""
    h = w.hashes()
    sums = running(h)
    at = w.windows(SHINGLE)
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    start, stop = np.concatenate([at, w.first[short]]), np.concatenate([at + SHINGLE, w.first[short + 1]])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    key, row = span_hash(sums, start, stop), w.row[start]
    _, index, count = np.unique(key ^ mix(row.astype(_U) + _U(1)), return_index=True, return_counts=True)
    order = np.lexsort((key[index], row[index]))
    index = index[order]
    return row[index], key[index], 1 + np.log(count[order])


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m): the shingle that first hits each component; zeros for rows without shingles."""
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, _U)
    many = np.bincount(row, minlength=n)
    alone = many[row] == 1  # hits everything
    for r, k in zip(row[alone], key[alone]):
        winner[r * m : (r + 1) * m] = k
    row, key, weight = row[~alone], key[~alone], weight[~alone]
    time, step = np.zeros(len(row)), 0
    while len(row):
        step += 1
        a = mix(key + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = row * m + (mix(a ^ _U(0xA0761D6478BD642F)) % _U(m)).astype(np.int64)
        better = np.flatnonzero(time < first[place])
        p, t = place[better], time[better]
        np.minimum.at(first, p, t)
        won = t == first[p]
        winner[p[won]] = key[better[won]]
        latest = first.reshape(n, m).max(axis=1)
        go = time < latest[row]
        row, key, weight, time = row[go], key[go], weight[go], time[go]
    return winner.reshape(n, m)


def bands(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    out = np.zeros((n, BANDS), _U)
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + signature[:, r::ROWS][:, :BANDS])
    return mix(out + np.arange(1, BANDS + 1, dtype=_U)[None, :])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    x_only, y_only = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio = ratio[order]
    below = np.concatenate([[0.0], np.cumsum(y[order])])[np.searchsorted(ratio, ratio, "left")] + y_only
    above = x.sum() - np.concatenate([[0.0], np.cumsum(x[order])])[np.searchsorted(ratio, ratio, "left")] + x_only
    return float((1 / (above / x[order] + below / y[order])).sum())


def _describe(docs: DataFrame) -> DataFrame:
    """(doc, n_words, e1, e2, bands) of docs (doc, text); e1 and e2 hash all words."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                w = Words(data, offsets)
                h = w.hashes()
                e1 = span_hash(running(h), w.first[:-1], w.first[1:])
                e2 = span_hash(running(h, second=True), w.first[:-1], w.first[1:], second=True)
                keys = bands(signatures(*shingles(w), hi - lo))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.count, pa.int64()), pa.array(signed(e1)), pa.array(signed(e2)), lists], ["doc", "n_words", "e1", "e2", "bands"])

    return docs.mapInArrow(run, "doc long, n_words long, e1 long, e2 long, bands array<long>")


def _sets(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted set of each text."""
    out = []
    for lo, hi, data, offsets in blocks(column):
        row, key, weight = shingles(Words(data, offsets))
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        out += [(key[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return out


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, ta, tb) that are similar enough."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                good = [similarity(x, y) >= threshold for x, y in zip(_sets(part.column(2)), _sets(part.column(3)))]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _classed(met: DataFrame, label: DataFrame) -> DataFrame:
    """(band, doc, class) of the members of large buckets."""
    return met.where(F.col("size") > SMALL).join(label.select(F.col("id").alias("doc"), "root"), "doc", "left").select("band", "doc", F.coalesce("root", "doc").alias("class"))


def _faced(classed: DataFrame) -> DataFrame:
    """(band, x, y, doc, class, me): the members of buckets of several classes, once for each pair x <= y of blocks that meet; me is the member's own."""
    tally = classed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = tally.groupBy("band").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    cut = mixed.select("band", F.col("m.class").alias("major"), F.ceil((F.col("size") - F.col("m.n")) / BLOCK).alias("minors"), F.ceil(F.col("m.n") / BLOCK).alias("majors"))
    own, at = F.col("class") == F.col("major"), F.xxhash64("doc")
    placed = classed.join(cut, "band").withColumn("me", F.when(own, F.col("minors") + F.pmod(at, "majors")).otherwise(F.pmod(at, "minors")))
    facing = F.explode(F.sequence(F.lit(0).cast("long"), F.when(own, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1))
    return placed.withColumn("other", facing).select("band", F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"), "doc", "class", "me")


def _verify_blocks(faced: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of two classes, of faced (band, x, y, doc, class, me, text, bands)."""

    def run(key, part):
        band, lo, hi = (k.as_py() for k in key)
        doc, kind, me = (part.column(c).to_numpy() for c in ("doc", "class", "me"))
        keys = part.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sets = [s for chunk in part.column("text").chunks for s in _sets(chunk)]
        here = int(np.flatnonzero(keys[0] == band)[0])
        first = np.concatenate([[0], np.cumsum([len(k) for k, _ in sets])])
        codes, code = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
        mass = np.concatenate([w / w.sum() for _, w in sets])
        dense, linked, a, b = np.zeros(len(codes)), set(), [], []
        for i in np.flatnonzero(me == hi):
            own = slice(first[i], first[i + 1])
            dense[code[own]] = mass[own]
            most = np.add.reduceat(np.minimum(mass, dense[code]), first[:-1])  # no similarity is higher
            dense[code[own]] = 0
            other = (me == lo) & (kind != kind[i]) & (most >= threshold - 1e-9)
            for j in np.flatnonzero(other):
                if (lo == hi and j > i) or (kind[i], kind[j]) in linked or int(np.argmax(keys[i] == keys[j])) != here:
                    continue
                if similarity(sets[i], sets[j]) >= threshold:
                    linked |= {(kind[i], kind[j]), (kind[j], kind[i])}
                    a.append(max(doc[i], doc[j]))
                    b.append(min(doc[i], doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return faced.groupBy("band", "x", "y").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, class) of docs (doc, text): class is the least doc of the documents linked by similar pairs."""
    spark = docs.sparkSession
    described, p_all = written(_describe(docs), "near-all")
    worded = described.where("n_words > 0")
    nodes, p_nodes = written(worded.groupBy("e1", "e2").agg(F.min(F.struct("doc", "bands")).alias("f")).select("e1", "e2", "f.doc", "f.bands"), "near-nodes")

    members = nodes.select(F.explode("bands").alias("band"), "doc")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met, p_met = written(members.join(sizes, "band"), "near-met")
    used, label = [p_met], None
    if not met.isEmpty():
        fame, p_fame = written(met.groupBy("doc").agg(F.sum("size").alias("fame")), "near-fame")
        texts, p_texts = written(docs.join(fame.select("doc"), "doc", "left_semi"), "near-texts")
        small = met.where(F.col("size") <= SMALL).select("band", "doc")
        pairs = small.select("band", F.col("doc").alias("a")).join(small.select("band", F.col("doc").alias("b")), "band").where("a > b").select("a", "b")
        large = met.where(F.col("size") > SMALL).join(fame, "doc")
        heads = large.groupBy("band").agg(F.max(F.struct(F.col("fame"), (-F.col("doc")).alias("neg"))).alias("r")).select("band", (-F.col("r.neg")).alias("lead"))
        led = large.join(heads, "band").where("doc <> lead").select(F.greatest("doc", "lead").alias("a"), F.least("doc", "lead").alias("b"))
        pairs, p_pairs = written(pairs.unionByName(led).distinct(), "near-pairs")
        full = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
        found, p_found = written(_verify(full, threshold), "near-links")
        label, new = _relabelled(None, found)
        used += [p_fame, p_texts, p_pairs, p_found, *new]
        faced, p_faced = written(_faced(_classed(met, label)), "near-faced")
        used.append(p_faced)
        if not faced.isEmpty():
            full = faced.join(texts.join(nodes.select("doc", "bands"), "doc").select("doc", "text", "bands"), "doc")
            found, p_found = written(_verify_blocks(full, threshold), "near-links")
            label, new = _relabelled(label, found)
            used += [p_found, *new]

    out = described.select("doc", "n_words", "e1", "e2").join(nodes.select("e1", "e2", F.col("doc").alias("node")), ["e1", "e2"], "left")
    if label is None:
        out = out.withColumn("root", F.lit(None).cast("long"))
    else:
        out = out.join(label.select(F.col("id").alias("node"), "root"), "node", "left")
    out, _ = written(out.select("doc", F.when(F.col("n_words") > 0, F.coalesce("root", "node")).otherwise(F.col("doc")).alias("class")), "near-classes")
    drop(spark, p_all, p_nodes, *used)
    return out


def _relabelled(label: DataFrame | None, links: DataFrame) -> tuple[DataFrame, list[str]]:
    """The classes (id, root) with these links (a, b) added, and the tables they lie in."""
    if label is None:
        out, path = components(links)
        return out, [path]
    for side in ("a", "b"):
        links = links.join(label.select(F.col("id").alias(side), F.col("root").alias("r")), side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
    among, path = components(links)
    moved = among.select(F.col("id").alias("root"), F.col("root").alias("new"))
    old = label.join(moved, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    both, p_both = written(old.unionByName(among.join(label.select("id"), "id", "left_anti").select("id", "root")), "near-label")
    return both, [path, p_both]


def near_dedup(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of documents: its class, the rows of the class, and whether it stays (the smallest doc_id of the class does).

    Documents without a word (null, empty, blank) are classes of their own;
    texts of fewer than SHINGLE words are near copies only of texts with the
    same words. A null doc_id counts as the smallest. Rows that repeat a doc_id
    should repeat its text; they share its class. Other columns are not read;
    an empty table gives no rows.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    out = classes(docs, threshold)
    sizes, _ = written(out.groupBy("class").agg(F.count(F.lit(1)).alias("class_size")), "near-sizes")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return with_group(out, sizes, "class", "class_size", "doc").select(null("doc").alias("doc_id"), null("class").alias("class_id"), "class_size", (F.col("doc") == F.col("class")).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each class. What goes is a list of ids, which meets the texts in one join."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    gone = classes(plain).where("doc <> class").select("doc").distinct()
    return docs.join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == gone["doc"], "left_anti")
