"""Queries on odd tables against DuckDB."""

import os
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from chalkline import catalog, plans  # noqa: F401
from chalkline.functions import text as t
from chalkline.operators import sinks
from chalkline.sources import files

from .test_oracle import rows


def same(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        parts = "/*.parquet" if os.path.isdir(f"{folder}/{f}") else ""
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}{parts}'")
    df, got = catalog.QUERIES[name](spark, str(folder)), c.execute(catalog.SQL[name])
    names, want = [d[0] for d in got.description], got.fetchall()
    assert want and rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)


def test_boards_of_search_texts_in_upper_case(spark, tmp_path):
    texts = ["Enen\xdf und", "ﬁnŉe", "\U0001f600ΐ abc", "", None, "a\n\xdfb", "ᾀᾈǰ", "plain text"]
    turns = [(i // 4, 2 * (i % 4) + k, "user", x) for i, x in enumerate(texts) for k in range(2)] + [(9, 0, "system", "none"), (9, 1, "user", "Stra\xdfe")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    same(spark, tmp_path, "search_document_text")


def test_upper_case_of_every_letter(spark):
    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    parts = [every[lo : lo + 4096] for lo in range(0, len(every), 4096)]
    c = duckdb.connect()
    got = spark.createDataFrame(list(enumerate(parts)), "i int, s string").select("i", t.upper(F.col("s"))).collect()
    other = {(a, b) for i, u in got for a, b in zip(u, c.execute("select upper(?)", [parts[i]]).fetchone()[0], strict=True) if a != b}
    assert not other, other


def test_tables_that_are_folders(spark, tmp_path):
    for n in ("b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "c.PARQUET/day=1/x.parquet/part-0", "a.parquet", "d.txt", "e/f.parquet", "_g.parquet"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"xy")
    want = [("a.parquet", 2), ("b.parquet", 4), ("c.PARQUET", 2)]
    for folder in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        got = [(r.path, r.length) for r in files.find_tables(spark, folder).collect()]
        assert [(p.removeprefix(f"file:{tmp_path}/"), n) for p, n in got] == want
    assert files.find_tables(spark, str(tmp_path / "none")).count() == 0 and files.find_tables(spark, str(tmp_path / "e" / "..")).count() == 3


def test_directory_scan_finds_tables_in_parts(spark, tmp_path):
    for name in os.listdir("/root/testdata/sf0.001"):
        parts = name in ("documents.parquet", "labels.parquet")
        spark.read.parquet(f"/root/testdata/sf0.001/{name}").repartition(3).write.parquet(str(tmp_path / name)) if parts else os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    same(spark, tmp_path, "directory_scan")


def test_recognised_frames_are_one_file_a_run(spark, tmp_path):
    kinds = ["view", "error", "click"]
    events = [(i, i % 40, kinds[i % 3], datetime(2024, 1, 1, 0, i % 60), float(i)) for i in range(1200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    texts = [(i, f"board {i}\nmore" if i % 5 else None if i % 2 else "") for i in range(100) if i % 7] + [(3, "again"), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        same(spark, tmp_path, "ocr_results_json")
    finally:
        for k in settings:
            spark.conf.unset(k)
    path = sinks.run_folder(spark, "ocr_results").removeprefix("file:")
    assert [len([f for f in os.listdir(f"{path}/{run}") if f.endswith(".json")]) for run in os.listdir(path) if run.startswith("run_id=")] == [1] * 40
