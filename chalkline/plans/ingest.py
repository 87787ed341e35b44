"""Queries on sources: files, probes, JSON of several shapes, recognised speech, and what guards them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as t
from ..operators import providers, runs
from ..sources import files
from ..sources.relations import FRAMES_SQL, SEGMENTS_SQL, frames, segments, table

_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(f"SELECT unnest([{', '.join(repr(x + '.parquet') for x in _TABLES)}]) AS name")
def directory_scan(spark, sf_dir):
    """Tables of a folder by their suffix, files or folders of part files, in the order of their paths."""
    return files.find_tables(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("SELECT 'region.parquet' AS name, true AS whole")
def uploaded_file(spark, sf_dir):
    f = files.uploaded(spark, f"{sf_dir}/region.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.octet_length("content") == F.col("length")).alias("whole"))


def _videos(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.count(F.lit(1)) * 100).alias("total_frames"))
    return v.withColumn("fps", F.when(F.col("run_id") % 3 == 0, 0.0).when(F.col("run_id") % 3 == 1, 25.0).otherwise(30.0))


@query("SELECT user_id AS run_id, CASE user_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, count(*) * 100 AS total_frames, CASE user_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN count(*) * 100 / 25.0 ELSE count(*) * 100 / 30.0 END::DOUBLE AS duration FROM events GROUP BY user_id")
def video_probe(spark, sf_dir):
    """Frame rate, frames and length of recordings; without a frame rate the length is 0."""
    return providers.probed(_videos(spark, sf_dir)).select("run_id", "fps", "total_frames", "duration")


@query("SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN '*' || (user_id % 5)::DOUBLE || '-' ELSE '*' || (user_id % 5)::DOUBLE || '-' || (user_id % 5 + 60)::DOUBLE END AS section FROM events")
def download_section(spark, sf_dir):
    v = _videos(spark, sf_dir)
    start = (F.col("run_id") % 5).cast("double")
    return v.select("run_id", files.section(start, F.when(F.col("run_id") % 2 == 1, start + 60)).alias("section"))


def _wrapped(s, rows, key):
    """(run_id, content): the rows of each run as JSON, a bare list or under a key in turn."""
    listed = s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", rows.alias("x")))).alias("l")).select("run_id", F.transform("l", lambda x: x["x"]).alias("l"))
    return listed.select("run_id", F.when(F.col("run_id") % 2 == 0, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias(key)))).alias("content"))


@query(f'WITH {SEGMENTS_SQL} SELECT run_id, seg_idx, start_s AS "start", end_s AS "end", text FROM segments')
def json_segments(spark, sf_dir):
    s = segments(spark, sf_dir)
    made = _wrapped(s, F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text"), "segments")
    return files.segments_of(made).withColumn("seg_idx", F.col("seg_idx").cast("long"))


@query(f"WITH {FRAMES_SQL} SELECT run_id, frame_idx, time_s AS \"time\", printf('f%d.jpg', event_id) AS path FROM frames")
def json_frames(spark, sf_dir):
    """Frames whose time is called timestamp in some files and time in others."""
    f = frames(spark, sf_dir).withColumnRenamed("frame_idx", "seg_idx")
    path = F.format_string("f%d.jpg", F.col("event_id")).alias("path")
    row = F.struct(F.when(F.col("run_id") % 3 == 0, F.col("time_s")).alias("timestamp"), F.when(F.col("run_id") % 3 != 0, F.col("time_s")).alias("time"), path)
    return files.frames_of(_wrapped(f, row, "frames")).withColumn("frame_idx", F.col("frame_idx").cast("long"))


@query(f"WITH {SEGMENTS_SQL} SELECT run_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN text ELSE '' END AS board FROM segments")
def json_boards(spark, sf_dir):
    s = segments(spark, sf_dir)
    one = F.when(F.col("seg_idx") % 2 == 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return files.boards_of(_wrapped(s, one, "board_elements")).withColumn("seg_idx", F.col("seg_idx").cast("long"))


@query("SELECT doc_id, base64(encode(text)) AS base64 FROM documents")
def encoded_images(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.encoded(F.encode("text", "UTF-8")).alias("base64"))


_SPOKEN = "struct<text:string,start:long,end:long>"


def _replies(spark, sf_dir):
    """Replies of a speech service: with sentences, utterances, a text alone, or nothing, by run."""
    s = segments(spark, sf_dir).withColumns({"start": (F.col("start_s") * 1000).cast("long"), "end": (F.col("end_s") * 1000).cast("long")})
    g = s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start", "end"))).alias("l"), F.max("end_s").alias("audio_duration"))
    turns = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    kind, none = F.col("run_id") % 4, F.array().cast(f"array<{_SPOKEN}>")
    return g.select("run_id", "audio_duration", F.when(kind != 3, F.array_join(F.transform("l", lambda x: x["text"]), " ")).otherwise("").alias("text"),
                    F.when(kind == 0, turns).otherwise(none).alias("sentences"), F.when(kind == 1, turns).otherwise(none).alias("utterances"), turns.alias("turns"))


@query(f"""WITH {SEGMENTS_SQL} SELECT run_id, seg_idx, start_s AS "start", end_s AS "end", trim(text, ' ' || chr(10)) AS text FROM segments WHERE run_id % 4 < 2
UNION ALL SELECT run_id, 0, 0.0, max(end_s), trim(string_agg(text, ' ' ORDER BY seg_idx), ' ' || chr(10)) FROM segments WHERE run_id % 4 = 2 GROUP BY run_id""")
def asr_cascade(spark, sf_dir):
    """Sentences, or else utterances, or else one segment of the whole text."""
    return files.spoken(_replies(spark, sf_dir)).withColumn("seg_idx", F.col("seg_idx").cast("long"))


_SPELT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(rf"""WITH {SEGMENTS_SQL}, l AS (SELECT run_id, seg_idx, end_s, unnest({_SPELT}) AS text, unnest(range(1, len({_SPELT}) + 1)) AS i FROM segments),
w AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seg_idx, i) - 1 AS word_idx, text FROM l),
s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_idx FROM w WHERE run_id % 4 = 0)
SELECT run_id, CAST(sent_idx AS BIGINT) AS seg_idx, min(word_idx) * 0.5::DOUBLE AS "start", (max(word_idx) + 1) * 0.5::DOUBLE AS "end", string_agg(text, ' ' ORDER BY word_idx) AS text FROM s GROUP BY run_id, sent_idx
UNION ALL SELECT run_id, seg_idx, start_s, end_s, text FROM segments WHERE run_id % 4 = 1
UNION ALL SELECT run_id, word_idx, word_idx * 0.5, (word_idx + 1) * 0.5, text FROM w WHERE run_id % 4 = 2""")
def asr_rest_cascade(spark, sf_dir):
    """Words as sentences where there is a text (none where there are no words), or else utterances, or else words."""
    r, kind = _replies(spark, sf_dir), F.col("run_id") % 4
    spelt = F.filter(F.split(F.array_join(F.transform("turns", lambda x: x["text"]), " "), r"\s+"), lambda x: x != "")
    words = F.transform(spelt, lambda x, i: F.struct(x.alias("text"), (i * 500).cast("long").alias("start"), ((i + 1) * 500).cast("long").alias("end")))
    none = F.array().cast(f"array<{_SPOKEN}>")
    r = r.select("run_id", F.when(kind.isin(0, 3), "said").otherwise("").alias("text"), F.when(kind == 1, F.col("turns")).otherwise(none).alias("utterances"), F.when(kind.isin(0, 2), words).otherwise(none).alias("words"))
    return files.spoken_rest(r)


@query("""WITH r AS (SELECT conv_id AS run_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT run_id, CASE WHEN run_id % 5 = 4 THEN 'error' ELSE 'completed' END AS status, run_id % 5 + 1 AS asked, CASE WHEN run_id % 5 = 4 THEN 'RuntimeError: no speech' END AS error FROM r""")
def rest_transcription(spark, sf_dir):
    """Upload, request and polling until the status is final, against a service that answers by rule."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("run_id").cast("string").alias("audio"))
    return providers.transcribed(rows, "audio", providers.RuledService).select("run_id", "status", "asked", "error")


@query(f"""WITH {FRAMES_SQL} SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE time_s END, frame_idx) - 1 AS place FROM frames""")
def frames_in_order(spark, sf_dir):
    """Frames by their time; those without one come first, in the order of the input."""
    f = frames(spark, sf_dir).withColumn("timestamp", F.when(F.col("event_id") % 7 != 0, F.col("time_s")))
    return files.in_order(f, "timestamp", "frame_idx").select("run_id", "event_id", "place")


@query("SELECT event_id, event_id % 4 IN (0, 1) AS limited FROM events")
def rate_limit_flag(spark, sf_dir):
    n = F.col("event_id") % 4
    message = F.when(n == 0, "HTTP 429: too many").when(n == 1, "Rate_Limit reached").when(n == 2, "timed out").otherwise("rate of 42.9")
    return table(spark, sf_dir, "events").select("event_id", t.rate_limited(message).alias("limited"))


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT run_id, arg_max(event_type, frame_idx) AS status FROM frames GROUP BY run_id)
SELECT w.run_id, CASE WHEN r.status IS NULL THEN 404 WHEN r.status <> 'view' OR w.run_id % 2 = 1 THEN 400 ELSE 200 END AS answer FROM (SELECT unnest(range(0, 400)) AS run_id) w LEFT JOIN r ON r.run_id = w.run_id""")
def run_readiness(spark, sf_dir):
    """Whether wanted runs can be searched: unknown, not completed or without vectors, ready."""
    e = frames(spark, sf_dir).select("run_id", F.col("frame_idx").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"))
    states = runs.latest_state(e).select("run_id", F.when(F.col("status") == "view", "completed").otherwise(F.col("status")).alias("status"))
    wanted = spark.range(400).withColumnRenamed("id", "run_id")
    return wanted.join(states, "run_id", "left").select("run_id", runs.guard(F.col("status"), F.col("run_id") % 2 == 0).alias("answer"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no such video' WHEN event_id % 130 NOT BETWEEN 1 AND 100 THEN 'quality must be from 1 to 100' WHEN event_id % 3 = 0 THEN 'interval must be positive' ELSE '' END AS error FROM events""")
def checked_options(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wrong = files.option_error(F.col("event_id") % 5 != 0, F.col("event_id") % 130, (F.col("event_id") % 3).cast("double"))
    return e.select("event_id", F.coalesce(wrong, F.lit("")).alias("error"))
