"""The queries against DuckDB, on empty tables and odd rows, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from chalkline.llm import line_dedup, near_dedup, queries

from . import helpers as h

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    got = duck.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    order = lambda columns, rows: sorted(repr([r[columns.index(c)] if not isinstance(r[columns.index(c)], float) else round(r[columns.index(c)], 8) for c in sorted(columns)]) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(names, got.fetchall())


NAMES = sorted(n for n in queries.QUERIES if n != "op7_chat_formatting")
ODD = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "one two three four five six"), (4, "x " * 3000), (5, "y" * 50_000), (6, "\n\n"), (7, " é "), (8, "a b")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, h.saved(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, tmp_path, name):
    out = queries.QUERIES[name](spark, h.saved(spark, tmp_path, ODD, [(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)])).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in ODD)


def test_pipeline_stages(spark, tmp_path):
    rows = [(d, t) for d, t in h.copies() if d is not None]
    folder = h.saved(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, after = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "line_dedup":
            given = [(r.doc_id, r.text) for r in before.collect()]
            kept = {r.doc_id: r.text for r in after.collect()}
            counts = h.lines_removed(given)
            assert all((d in kept) == (counts[d][1] == 0 or bool(line_dedup.without_lines(t, [])[0] and kept.get(d))) for d, t in given)
        if name == "minhash_near_dedup":
            given = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in after.collect()} == set(h.near_classes(given).values())
        docs = after
    assert all(r.round_trip for r in docs.collect())


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, h.saved(spark, tmp_path, [])).count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    docs = h.documents(spark, h.copies())
    kept = {r.doc_id for r in near_dedup.stage(spark, docs, "").collect()}
    assert kept == set(h.near_classes(h.copies()).values())
