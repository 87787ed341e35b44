"""Runs: their states, experiments, assembled results and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
STATES = ["queued", "running", "completed", "failed"]


def latest_state(changes: DataFrame) -> DataFrame:
    """(run_id, status, error, changes) of appended changes (run_id, seq, status, error); an error stays with a run that completes."""
    last = changes.groupBy("run_id").agg(F.max(F.struct("seq", "status")).alias("_l"), F.max(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("_e"), F.count(F.lit(1)).alias("changes"))
    return last.select("run_id", F.col("_l.status").alias("status"), F.col("_e.error").alias("error"), "changes")


def experiments(succeeded: DataFrame, failed: DataFrame) -> DataFrame:
    """One log of both kinds of rows; columns that one kind lacks are null."""
    return succeeded.withColumn("status", F.lit("success")).unionByName(failed.withColumn("status", F.lit("failed")), allowMissingColumns=True)


def tally(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def assembled(segments: DataFrame, fused: DataFrame, frames: DataFrame, boards: DataFrame, audio: DataFrame) -> DataFrame:
    """One row for each segment, with ids from 1: all tables are keyed by (run_id, seg_idx), and what is missing is empty."""
    out = segments
    for t in (fused, frames, boards, audio):
        out = out.join(t, ["run_id", "seg_idx"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("run_id", (F.col("seg_idx") + 1).alias("id"), "start", "end", F.col("text").alias("original_text"), empty("fused_text"), empty("frame_path"), "frame_time", empty("board_text"), empty("audio_path"))


def counts(rows: DataFrame) -> DataFrame:
    """(run_id, segments, audio_files, boards) of result rows: what isn't empty counts."""
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("audio_path") != "").alias("audio_files"), F.count_if(F.col("board_text") != "").alias("boards"))


def guard(status: Column, has_vectors: Column) -> Column:
    """The answer to a request for a run: 404 if there is none, 400 if it isn't completed or can't be searched, else 200."""
    return F.when(status.isNull(), 404).when((status != "completed") | ~F.coalesce(has_vectors, F.lit(False)), 400).otherwise(200)


def packaged(rows: DataFrame, by: str = "run_id", order: str = "id", name: str = "segments") -> DataFrame:
    """(run_id, total, name): one row for each run with its rows, in order, as an array of structs. A run is one recording."""
    others = [c for c in rows.columns if c not in (by, order)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct(order, *others))).alias(name))


def joined_text(rows: DataFrame, text: str = "text", order: str = "seg_idx") -> DataFrame:
    """(run_id, transcript): the texts of each run in order, one a line; null counts as empty."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy("run_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("transcript"))


def audio_path(seg_idx: Column, ok: Column) -> Column:
    return F.when(ok, F.format_string("segment_%03d.mp3", seg_idx + 1)).otherwise(F.lit(""))


def voice(names: Column, wanted: Column) -> Column:
    """The first of the names that contains the wanted one, in any case; else null."""
    return F.get(F.filter(names, lambda v: F.contains(F.lower(v), F.lower(wanted))), 0)


def report(rows: DataFrame) -> DataFrame:
    """Lines of a plain report (run_id, id, value): times to a tenth of a second, original and fused text."""
    value = F.concat(F.format_string("[Segment %d] %.1fs - %.1fs\n", F.col("id").cast("int"), F.col("start"), F.col("end")), F.lit("Original: "), F.col("original_text"), F.lit("\nFused: "), F.col("fused_text"), F.lit("\n"))
    return rows.select("run_id", "id", value.alias("value"))


def write_packages(rows: DataFrame, path: str) -> None:
    """The packages as JSON, one folder for each run."""
    packaged(rows).write.mode("overwrite").partitionBy("run_id").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """The report as text, one folder for each run, ordered within it."""
    report(rows).repartition("run_id").sortWithinPartitions("run_id", "id").select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(path)
