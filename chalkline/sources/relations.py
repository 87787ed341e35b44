"""The driver's tables, and lecture relations derived from them for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# One relation in SQL each, for the oracle; the functions below build the same with DataFrames.
SEGMENTS_SQL = """segments AS (
  SELECT conv_id AS run_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - 1 AS seg_idx,
         CAST(10 * turn AS DOUBLE) AS start_s, CAST(10 * (turn + 1) AS DOUBLE) AS end_s, text
  FROM conversations WHERE role <> 'system')"""
FRAMES_SQL = """frames AS (
  SELECT user_id AS run_id, CAST(row_number() OVER w AS BIGINT) - 1 AS frame_idx, 2.0::DOUBLE * (row_number() OVER w - 1) AS time_s, event_id, event_type, value, ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
OCR_SQL = """ocr AS (
  SELECT f.run_id, f.frame_idx, f.time_s, CASE WHEN f.event_type = 'error' THEN '' ELSE coalesce(d.text, '') END AS text
  FROM frames f LEFT JOIN documents d ON d.doc_id = (f.run_id * 5 + f.event_id % 5) % (SELECT max(doc_id) + 1 FROM documents))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as spoken segments of ten seconds."""
    t = table(spark, sf_dir, "conversations").where("role <> 'system'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select(F.col("conv_id").alias("run_id"), (n.cast("long") - 1).alias("seg_idx"), (F.col("turn") * 10).cast("double").alias("start_s"), ((F.col("turn") + 1) * 10).cast("double").alias("end_s"), "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as frames two seconds apart."""
    t = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return t.select(F.col("user_id").alias("run_id"), n.alias("frame_idx"), (n * F.lit(2.0)).alias("time_s"), "event_id", "event_type", "value", "ts")


def board_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with `doc_id`, the document that their board shows: five for each run, out of all documents; frames of errors show none."""
    n = (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) + 1
    key = F.pmod(F.col("run_id") * 5 + F.col("event_id") % 5, F.lit(n))
    return frames(spark, sf_dir).select("run_id", "frame_idx", "time_s", F.when(F.col("event_type") != "error", key).alias("doc_id"))


def with_boards(rows: DataFrame, spark: SparkSession, sf_dir: str, name: str = "text") -> DataFrame:
    """rows (doc_id, ...) with the text of their document; without one it is empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    return rows.join(d, "doc_id", "left").withColumn(name, F.coalesce("_text", F.lit(""))).drop("_text", "doc_id")


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text of the frames: whole documents."""
    return with_boards(board_keys(spark, sf_dir), spark, sf_dir)


def boards_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as boards(), with the frames of each run in one partition, for sinks with a folder for each run.

    Frames are dealt by run while they are narrow, and the few documents of a run
    come to them, each once; so no text is shuffled for every frame that shows it.
    """
    keys = board_keys(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    shown = keys.where("doc_id IS NOT NULL").select("run_id", "doc_id").distinct().join(d, "doc_id").select(F.col("run_id").alias("_run"), F.col("doc_id").alias("_doc"), "_text")
    # equal documents by two bounds: as an equality they would be a key of the join, and the frames be dealt anew by it
    at = (F.col("run_id") == F.col("_run")) & (F.col("doc_id") <= F.col("_doc")) & (F.col("doc_id") >= F.col("_doc"))
    return keys.join(shown.hint("merge"), at, "left").select("run_id", "frame_idx", "time_s", F.coalesce("_text", F.lit("")).alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as recognised words, half a second each."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_idx", "text"))
    return t.select("run_id", F.col("word_idx").cast("long").alias("word_idx"), "text", (F.col("word_idx") * 500).cast("long").alias("start_ms"), ((F.col("word_idx") + 1) * 500).cast("long").alias("end_ms"))


WORDS_SQL = r"""words AS (
  SELECT run_id, i - 1 AS word_idx, w[i] AS text, (i - 1) * 500 AS start_ms, i * 500 AS end_ms
  FROM (SELECT run_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id AS run_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)))"""
