"""Exact, near, line and substring dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.llm import components, exact_dedup, line_dedup, near_dedup, substrings

from . import helpers as h


def test_exact_groups(spark, tmp_path):
    rows = h.copies()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op1_exact_dedup(spark, h.saved(spark, tmp_path, rows)).collect()}
    assert got == h.exact_groups(rows)


def test_exact_groups_with_colliding_digests(spark, tmp_path):
    rows = h.copies()[60:]
    folder = h.saved(spark, tmp_path, rows)
    short = exact_dedup.exact_dedup(spark, f"{folder}/documents.parquet", digest=lambda t: F.concat(F.lit("d"), (F.crc32(t) % 3).cast("string")))
    expected = h.exact_groups(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in short.collect()} == {k: v[:3] for k, v in expected.items()}


def test_exact_state_carries_on(spark, tmp_path):
    folder, state, log = f"{tmp_path}/d.parquet", f"{tmp_path}/state", f"{tmp_path}/log"
    for part in ([(1, "a b")], [(2, "ab  "), (3, "c")]):
        h.documents(spark, part).coalesce(1).write.mode("append").parquet(folder)
        exact_dedup.update_state(spark, folder, spark.read.parquet(folder).select("doc_id", "text").schema, state, log)
    last = spark.read.parquet(f"{log}/*").where("batch = 1")
    assert sorted((r.group_size, -r.keeper.neg_id) for r in last.collect()) == [(1, 3), (2, 2)]


def test_near_classes(spark):
    rows = h.copies()
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(h.documents(spark, rows)).collect()}
    assert got == h.near_classes(rows)


def test_a_large_group_is_one_class(spark):
    rng = random.Random(3)
    base, rows = h.prose(rng, 150), []
    for i in range(120):
        x = base[:]
        x[rng.randrange(len(x))] = f"w{i}"
        rows.append((i, " ".join(x)))
    out = near_dedup.near_dedup(h.documents(spark, rows)).collect()
    assert {r.class_id for r in out} == {0} and [r.doc_id for r in out if r.kept] == [0]


def test_pairs_within_a_family_just_below_the_threshold(spark):
    """400 texts of one template (similarity 0.78), 60 of them with a partner (0.815) that is like no third text."""
    rng = random.Random(8)
    base, rows = h.prose(rng, 250), []

    def changed(x, n, name):
        x = x[:]
        for k, i in enumerate(rng.sample(range(0, 250, 6), n)):
            x[i] = f"{name}x{k}"
        return x

    members = [changed(base, 3, f"m{i}") for i in range(400)]
    for i, x in enumerate(members):
        rows.append((i, " ".join(x)))
    rows += [(1000 + i, " ".join(changed(members[i], 5, f"p{i}"))) for i in range(60)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(h.documents(spark, rows)).collect()}
    near = h.probability_jaccard
    sets = {i: h.weighted_shingles(t) for i, t in rows if i < 20 or 1000 <= i < 1020}
    linked = {(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j]) >= 0.8}
    assert {(i, 1000 + i) for i in range(20)} <= linked
    assert [i for i in range(60) if got[1000 + i] != got[i]] == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out, _ = components.components(spark.createDataFrame(edges, "a long, b long"))
    single = {a for a, b in edges if a == b}
    got = {r.id: r.root for r in out.collect()}
    assert got == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= single


def test_signatures_estimate_the_similarity():
    import numpy as np
    import pyarrow as pa

    from chalkline.llm.kernels import Words, blocks

    rng = random.Random(5)
    a = h.prose(rng, 300)
    b = a[:100] + ["Q"] + a[101:] + ["z"] * 40
    texts = [" ".join(a), " ".join(b)]
    w = Words(*next(blocks(pa.array(texts)))[2:])
    row, key, weight = near_dedup.shingles(w)
    s = near_dedup.signatures(row, key, weight, 2, 4000)
    c = np.searchsorted(row, [0, 1, 2])
    exact = near_dedup.similarity((key[: c[1]], weight[: c[1]]), (key[c[1] :], weight[c[1] :]))
    assert exact == pytest.approx(h.probability_jaccard(*map(h.weighted_shingles, texts)))
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_lines(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abé 🙂") for _ in range(rng.randint(15, 40))) for _ in range(25)]

    def changed(s):
        s = list(s)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
        return "".join(s)

    rows = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(None, "a" * 25 + "\n" + "a" * 26), (500, None), (501, ""), (502, "\n\n"), (503, " " + "a" * 25 + " \r\nshort"), (504, "a" * 30)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.line_dedup(h.documents(spark, rows)).collect()}
    assert got == h.lines_removed(rows)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    rng = random.Random(7)
    rows = h.copies(8) + [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(30)] + [(None, "q " * 50), (400, "q " * 50 + "\n z")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(h.documents(spark, rows), batches).collect()}
    assert got == h.windows_removed(rows)


def test_index_compacts(spark):
    docs = [(i, " ".join(h.prose(random.Random(i), 60))) for i in range(6)]
    table = spark.createDataFrame(docs, "doc long, text string")
    index = substrings.Index(spark)
    for i in range(6):
        index.add(table.where(F.col("doc") == i), table.where(F.col("doc") <= i))
    assert len(index.runs) <= substrings.MAX_RUNS and index.history().count() == substrings.entries(table).select("anchor", "span").distinct().count()


def test_substrings_with_forced_collisions(spark, monkeypatch):
    """Hashes of three bits at first: the index must find out and be built again."""
    rng = random.Random(8)
    rows = h.copies(8) + [(300 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(12)]
    monkeypatch.setattr(substrings, "BITS", (3, 64, 64))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(h.documents(spark, rows), 2).collect()}
    assert got == h.windows_removed(rows)


def test_substring_index_is_taken_up_later(spark, tmp_path):
    """Documents that come later are compared with the index that an earlier call left, and batches outnumber MAX_RUNS."""
    rows = [r for r in h.copies(9) if r[0] is not None]
    docs = h.documents(spark, rows).select(F.col("doc_id").alias("doc"), "text")
    ids = sorted({d for d, _ in rows})
    found = []
    for k in range(6):
        part = ids[k * len(ids) // 6 : (k + 1) * len(ids) // 6]
        index = substrings.Index(spark, str(tmp_path / "index"))
        assert len(index.runs) <= substrings.MAX_RUNS and bool(index.runs) == bool(k)
        good, _ = index.add(docs.where(F.col("doc").between(part[0], part[-1])), docs.where(F.col("doc") <= part[-1]))
        found += [(r.doc, r.start, r.stop) for r in good.collect()]
    gone = {}
    for d, a, b in found:
        gone.setdefault(d, set()).update(range(a, b))
    expected = {d: n for d, (_, n, _) in h.windows_removed(rows).items() if n}
    assert {d: len(x) for d, x in gone.items()} == expected
