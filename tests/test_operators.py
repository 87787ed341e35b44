"""Alignment, dedup, folds, sentences, packaging, providers and streams on rows built by hand."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import align, dedup, folds, media, providers, runs, search, sentences
from chalkline.sources import files
from chalkline.streaming.incremental import keep_stream, latest_states


def test_both_nearest_joins_equal_a_python_minimum(spark):
    random.seed(1)
    frames = [(r, i, float(random.randint(0, 40))) for r in "ab" for i in range(30)] + [("c", 0, 5.0)]
    segs = [(r, i, random.choice([0.0, 0.5, 7.0, 60.0, 20.5, float(random.randint(0, 40))])) for r in "abcd" for i in range(40)]
    expected = {(r, i): min(((abs(t - m), t, k) for q, k, t in frames if q == r), key=lambda x: (x[0], x[1], x[2]))[2] if r != "d" else None for r, i, m in segs}
    f = spark.createDataFrame(frames, "run_id string, frame_idx long, time_s double")
    s = spark.createDataFrame(segs, "run_id string, seg_idx long, mid double")
    got = {(r.run_id, r.seg_idx): r.frame_idx for r in align.nearest(s, f, "mid", ["frame_idx"]).collect()}
    assert got == expected
    ordered = [(r, i, t) for r in "ab" for i, t in enumerate(sorted(t for q, _, t in frames if q == r))] + [("c", 0, 5.0)]  # frames in the order of time, as recordings have them
    f = spark.createDataFrame(ordered, "run_id string, frame_idx long, time_s double")
    a = {tuple(r) for r in align.nearest(s, f, "mid", ["frame_idx"]).select("run_id", "seg_idx", "frame_idx").collect()}
    b = {tuple(r) for r in align.nearest_small(s, f, "mid", ["frame_idx"]).select("run_id", "seg_idx", "frame_idx").collect()}
    assert a == b


def test_nearest_is_linear_in_a_run(spark):
    """One run of 200,000 frames and 20,000 segments."""
    import time

    f = spark.range(200_000).select(F.lit("a").alias("run_id"), F.col("id").alias("frame_idx"), (F.col("id") * 2.0).alias("time_s"))
    s = spark.range(20_000).select(F.lit("a").alias("run_id"), F.col("id").alias("seg_idx"), (F.col("id") * 20.0 + 5.0).alias("mid"))
    began = time.time()
    out = align.nearest(s, f, "mid", ["frame_idx"]).where("frame_idx <> seg_idx * 10 + 2").count()
    assert out == 0 and time.time() - began < 120


def test_folds_pass_long_runs(spark):
    """A run of 50,000 rows in one pass; the state is the last kept row."""
    rows = spark.range(50_000).select(F.lit("a").alias("run_id"), F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("value"))
    out = folds.keep_fold(rows, ["n"], ["value"], lambda last, row: (abs(row["value"] - last["value"]) >= 3, row["value"] - last["value"]), more="moved double")
    last, kept = None, 0
    for i in range(50_000):
        if last is None or abs(i % 7 - last) >= 3:
            last, kept = i % 7, kept + 1
    assert out.where("kept").count() == kept and out.where("moved IS NULL").count() == 1


def test_guards_options_and_skips(spark):
    r = spark.createDataFrame([(1, None, None), (2, "running", True), (3, "completed", False), (4, "completed", True), (5, "completed", None)], "id int, status string, ok boolean")
    assert [x.g for x in r.orderBy("id").select(runs.guard(F.col("status"), F.col("ok")).alias("g")).collect()] == [404, 400, 400, 200, 400]
    o = spark.createDataFrame([(True, 50, 1.0), (False, 50, 1.0), (True, 0, 1.0), (True, 100, 0.0)], "e boolean, q int, i double")
    assert [x.w for x in o.select(files.option_error(F.col("e"), F.col("q"), F.col("i")).alias("w")).collect()] == [None, "no such video", "quality must be from 1 to 100", "interval must be positive"]
    k = spark.createDataFrame([(True, 0.5, 0.5), (False, 0.9, 0.0012)], "k boolean, s double, c double")
    assert [x.m for x in k.select(folds.skip_method(F.col("k"), F.col("s"), F.col("c")).alias("m")).collect()] == ["vision", "skipped_similar_frame (sim=0.900, change=0.0012)"]


def test_search_of_many_equals_search_of_one(spark, monkeypatch):
    random.seed(4)
    monkeypatch.setattr(search, "BLOCK", 3)
    rows = [(i, [random.uniform(-1, 1) for _ in range(6)]) for i in range(60)] + [(100, [0.0] * 6), (101, None), (102, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.top_k_each(v, v.where("vec_id % 20 = 0"), "vec_id", k=4, parts=5).collect()
    for q in (0, 20, 40):
        one = search.top_k(v.where("size(embedding) = 6"), rows[q][1], k=4, order="vec_id").collect()
        assert [(r.vec_id, round(r.score, 9)) for r in sorted((r for r in got if r.query == q), key=lambda r: -r.score)] == [(r.vec_id, round(r.score, 9)) for r in one]
    assert not [r for r in got if r.query == 100 or r.vec_id in (100, 101)]


def test_transcription_and_extraction_fail_by_row(spark):
    rows = spark.createDataFrame([(1, "1"), (4, "4"), (0, "x")], "id int, audio string")
    got = {r.id: (r.status, r.asked, (r.error or "").split(":")[0]) for r in providers.transcribed(rows, "audio", providers.RuledService).collect()}
    assert got == {1: ("completed", 2, ""), 4: ("error", 5, "RuntimeError"), 0: ("error", 0, "ValueError")}


def test_visible_ends_are_included(spark):
    t = spark.createDataFrame([("a", 10.0), ("a", 70.0), ("a", 130.5)], "run_id string, t double")
    e = spark.createDataFrame([("a", 1, 10.0, 70.0), ("a", 2, 70.5, 400.0)], "run_id string, id int, first_seen double, last_seen double")
    assert sorted((r.t, r.id) for r in align.visible(t, e).collect()) == [(10.0, 1), (70.0, 1), (130.5, 2)]


def test_attach_last_reply_wins_and_unknown_goes(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1)], "run_id string, seg_idx long")
    rep = spark.createDataFrame([("a", 0, "x", 0), ("a", 0, "y", 1), ("a", 9, "z", 0)], "run_id string, id long, fused string, at int")
    assert sorted((r.seg_idx, r.fused) for r in align.attach(rows, rep).collect()) == [(0, "y"), (1, "")]


def test_first_lines_and_boards(spark):
    b = spark.createDataFrame([("a", 0, 0.0, "X\ny"), ("a", 1, 1.0, "x\n`Z`\nz"), ("a", 2, 1.0, ""), ("b", 0, 0.0, "x")], "run_id string, frame_idx long, time_s double, text string")
    assert {(r.run_id, r.frame_idx): r.text for r in dedup.first_lines(b).collect()} == {("a", 0): "X\ny", ("a", 1): "`Z`", ("a", 2): "", ("b", 0): "x"}
    s = spark.createDataFrame([("a", 0, "```B```"), ("a", 1, "b"), ("a", 2, ""), ("a", 3, None), ("a", 4, "C")], "run_id string, seg_idx long, board string")
    assert {r.seg_idx: r.board for r in dedup.first_boards(s).collect()} == {0: "B", 1: None, 2: None, 3: None, 4: "C"}


def test_frame_folds_equal_a_python_loop(spark):
    random.seed(2)
    rows = []
    for run in "ab":
        for i in range(40):
            base = random.choice([[1.0, 2.0, 9.0, 4.0], [9.0, 1.0, 1.0, 7.0], [5.0, 5.0, 5.0, 5.0]])
            rows.append((run, float(i * random.choice([1, 3])) if i == 0 else rows[-1][1] + random.choice([1.0, 3.0, 6.0]), base, [random.choice([0, 40, 255]) for _ in range(4)], i))

    def corr(a, b):
        ma, mb = sum(a) / 4, sum(b) / 4
        va, vb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
        if va < 1e-9 and vb < 1e-9:
            return 1.0
        return 0.0 if va < 1e-9 or vb < 1e-9 else sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (va * vb) ** 0.5

    expected = {}
    for run in "ab":
        last = None
        for r in (x for x in rows if x[0] == run):
            diff = last and sum(abs(x - y) for x, y in zip(last[3], r[3])) / 4 / 255
            k = last is None or (corr(last[2], r[2]) < 0.85 and diff > 0.05) or r[1] - last[1] >= 5.0
            expected[run, r[4]] = k
            last = r if k else last
    df = spark.createDataFrame(rows, "run_id string, timestamp double, hist array<double>, thumb array<int>, n int")
    out = folds.keep_frames(df)
    assert {(r.run_id, r.n): r.kept for r in out.collect()} == expected
    rgb = df.withColumn("hist_rgb", F.array("hist", "hist", "hist"))
    flags = folds.skip_frames(rgb).select("kept").collect()
    assert len(flags) == len(rows) and any(r.kept for r in flags)


def test_sentences_and_alignment(spark):
    w = spark.createDataFrame([("a", i, x, i * 100, i * 100 + 90) for i, x in enumerate("Hi there. uh So e.g. this works".split())], "run_id string, word_idx long, text string, start_ms long, end_ms long")
    assert [(r.start, r.end, r.text) for r in sentences.words_to_sentences(w).orderBy("sent_idx").collect()] == [(0.0, 0.19, "Hi there."), (0.2, 0.49, "uh So e.g."), (0.5, 0.69, "this works")]
    t = spark.createDataFrame([("a", "Hi there. So this works! Nothing like it")], "run_id string, text string")
    got = [(r.start, r.end, r.text) for r in sentences.align_sentences(w, t).orderBy("sent_idx").collect()]
    assert got == [(0.0, 0.19, "Hi there."), (0.3, 0.69, "So this works!")]


def test_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "seg_idx int, embedding array<double>")
    assert [r.seg_idx for r in search.top_k(v, [1.0, 0.0]).collect()] == [0, 2, 4]
    assert search.top_k(v, [1.0, 0.0], k=0).count() == 0
    with pytest.raises(ValueError):
        search.top_k(v, [1.0, 0.0], k=-1)


def test_runs(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, "queued", None), ("a", 2, "completed", None), ("a", 1, "running", "embeddings"), ("b", 0, "queued", None)], "run_id string, seq int, status string, error string")
    assert sorted((r.run_id, r.status, r.error) for r in runs.latest_state(c).collect()) == [("a", "completed", "embeddings"), ("b", "queued", None)]
    s = spark.createDataFrame([("a", 0, 0.0, 1.0, "x"), ("a", 1, 1.0, 2.0, "y")], "run_id string, seg_idx long, start double, end double, text string")
    one = lambda c, kind="string": spark.createDataFrame([("a", 0, "v")], "run_id string, seg_idx long, v string").select("run_id", "seg_idx", F.col("v").alias(c))
    rows = runs.assembled(s, one("fused_text"), one("frame_path").withColumn("frame_time", F.lit(0.5)), one("board_text"), one("audio_path"))
    runs.write_packages(rows, str(tmp_path / "packages"))
    back = spark.read.json(str(tmp_path / "packages")).first()
    assert back.total == 2 and [x.id for x in back.segments] == [1, 2] and back.segments[1].fused_text == ""
    runs.write_report(rows, str(tmp_path / "report"))
    assert "[Segment 1] 0.0s - 1.0s" in [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]


def test_files(spark, tmp_path):
    for n in ("b.MP4", "a.mov", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.find_videos(spark, str(tmp_path)).collect()] == ["a.mov", "b.MP4"]
    assert files.find_videos(spark, str(tmp_path / "none")).count() == 0
    v = spark.createDataFrame([("a", 10.0, 100, 1.0, 3.0), ("b", 10.0, 25, None, 0.0), ("c", 0.0, 9, None, None)], "run_id string, fps double, total_frames int, start_time double, end_time double")
    got = [(r.run_id, r.frame_number, r.frame_id) for r in files.sampled(v, 1.0).orderBy("run_id", "frame_number").collect()]
    assert got == [("a", 10, "frame_0001"), ("a", 20, "frame_0002"), ("a", 30, "frame_0003"), ("b", 0, "frame_0001"), ("b", 10, "frame_0002"), ("b", 20, "frame_0003")]
    d = spark.createDataFrame([("a", '[{"start": 0, "end": 1, "text": "x"}]'), ("b", '{"segments": [{"start": 2, "end": 3, "text": "y"}]}')], "run_id string, content string")
    assert sorted((r.run_id, r.start, r.text) for r in files.segments_of(d).collect()) == [("a", 0.0, "x"), ("b", 2.0, "y")]
    d = spark.createDataFrame([("a", '{"frames": [{"time": 1, "path": "p"}, {"timestamp": 2, "path": "q"}]}')], "run_id string, content string")
    assert [(r.time, r.path) for r in files.frames_of(d).collect()] == [(1.0, "p"), (2.0, "q")]


def test_providers(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def shout(requests):
        with open(calls, "a") as f:
            f.write("x" * len(requests))
        return [r.upper() for r in requests]

    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "id int, q string")
    memory = str(tmp_path / "memory")
    for _ in range(2):
        out = providers.remembered(spark, rows, "q", "shout", shout, memory)
        assert sorted((r.id, r.answer) for r in out.collect()) == [(0, "A"), (1, "B"), (2, "A"), (3, "")]
    assert len(open(calls).read()) == 3

    tries = []

    def broken(requests):
        tries.append(1)
        raise RuntimeError("429")

    assert providers.retried(broken, ["a"], wait=0) == ([None], "RuntimeError: 429") and len(tries) == 5


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "run_id string, timestamp double, value double"
    for part in ([("a", 0.0, 1.0), ("a", 1.0, 1.1)], [("a", 2.0, 9.0), ("a", 3.0, 9.1), ("b", 0.0, 1.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = keep_stream(stream, lambda a, b: abs(a - b) > 5).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.run_id, r.timestamp) for r in spark.table("kept").where("kept").collect()) == [("a", 0.0), ("a", 2.0), ("b", 0.0)]
    states = spark.createDataFrame([("a", 1, "running"), ("a", 0, "queued")], "run_id string, seq int, status string")
    assert latest_states(states).first().status == "running"


def test_media(spark):
    rows = spark.createDataFrame([("a", 0, "one two", "one two", "B"), ("a", 1, "three", "three", "")], "run_id string, seg_idx long, text string, fused_text string, board_text string")
    v = media.embedded(rows).orderBy("seg_idx").collect()
    assert v[0].document == "one two | board: B" and v[1].document == "three" and len(v[0].embedding) == 64
    assert search.top_k(media.embedded(rows), providers.hashed_vector("three")).first().seg_idx == 1
    wanted = spark.createDataFrame([("a", "en, de")], "run_id string, languages string")
    out = {r.language: (r.chunks, r.audio, r.error) for r in media.podcasts(rows, wanted, width=8).collect()}
    assert set(out) == {"en", "de"} and all(n > 1 and error is None and "three" in audio for n, audio, error in out.values())
    frames = spark.createDataFrame([(0, True, "x"), (1, False, "y")], "id int, kept boolean, request string")
    got = {r.id: (r.text, r.confidence) for r in media.recognised(frames, providers.echo).collect()}
    assert got == {0: ("x", 0.9), 1: ("", 0.0)}
    assert media.answer("why?") == "why?"


def test_polling():
    replies = iter([{"status": "queued"}, {"status": "processing"}, {"status": "completed", "text": "x"}])
    slept = []
    assert providers.polled(lambda: next(replies), [5.0] * 9, slept.append)["text"] == "x" and slept == [5.0, 5.0]
    with pytest.raises(RuntimeError):
        providers.polled(lambda: {"status": "error"}, [], slept.append)
    with pytest.raises(TimeoutError):
        providers.polled(lambda: {"status": "queued"}, [], slept.append)
