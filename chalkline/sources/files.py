"""Files as tables: videos, images, and JSON of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import VIDEO_SUFFIXES, seconds, suffix
from ..operators.sentences import words_to_sentences

SEGMENT = "struct<start:double,end:double,text:string>"
FRAME = "struct<timestamp:double,time:double,path:string>"


def is_video(path: Column) -> Column:
    return suffix(path).isin(VIDEO_SUFFIXES)


def find_files(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(path, length) of the files right in the folder with one of the suffixes, by path. Contents aren't read. A missing folder has none."""
    try:
        files = spark.read.format("binaryFile").load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")
    return files.where(suffix(F.col("path")).isin(suffixes)).select("path", "length").orderBy("path")


def find_tables(spark: SparkSession, folder: str, suffix_: str = ".parquet") -> DataFrame:
    """(path, length) of the tables right in the folder, by path: files with the suffix, and folders with it, whose part files count together.

    Only such folders are looked into, however deep their part files lie. A missing folder has none.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    ending = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix_)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder.rstrip('/')}/*{ending}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")
    entry = F.array_join(F.slice(F.split("path", "/"), 1, root.count("/") + 2), "/")
    return files.groupBy(entry.alias("path")).agg(F.sum("length").alias("length")).orderBy("path")


def find_videos(spark: SparkSession, folder: str) -> DataFrame:
    return find_files(spark, folder, VIDEO_SUFFIXES)


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of an uploaded file, or of all files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, base64) of the files of a folder, as models take them."""
    return spark.read.format("binaryFile").load(folder).select("path", encoded(F.col("content")).alias("base64"))


def encoded(content: Column) -> Column:
    """Base64 in one line; Spark breaks it into lines of 76."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def section(start: Column, end: Column) -> Column:
    """The time slice of a download: "*start-end", open without an end."""
    return F.concat(F.lit("*"), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))


def option_error(exists: Column, quality: Column, interval: Column) -> Column:
    """What is wrong with the options of an extraction; null if nothing is."""
    return F.when(~exists, "no such video").when(~quality.between(1, 100), "quality must be from 1 to 100").when(~(interval > 0), "interval must be positive")


def in_order(frames: DataFrame, time: str, place: str) -> DataFrame:
    """frames with `place` by run: by time, where a missing one counts as 0, then by their place in the input."""
    w = Window.partitionBy("run_id").orderBy(F.coalesce(F.col(time), F.lit(0.0)), place)
    return frames.withColumn("place", F.row_number().over(w).cast("long") - 1)


def duration(fps: Column, frames: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def sampled(videos: DataFrame, interval: float = 2.0, prefix: str = "frame") -> DataFrame:
    """Frames of videos (run_id, fps, total_frames, start_time, end_time) at a stride of interval seconds, the last one included.

    A start or end of 0 or null means the whole video. Times are relative to
    the start; absolute ones are kept beside them. Videos without a positive
    frame rate have no frames.
    """
    begin = F.when(F.coalesce("start_time", F.lit(0.0)) != 0, F.floor(F.col("start_time") * F.col("fps"))).otherwise(F.lit(0)).cast("long")
    stop = F.when(F.coalesce("end_time", F.lit(0.0)) != 0, F.floor(F.col("end_time") * F.col("fps"))).otherwise(F.col("total_frames")).cast("long")
    stride = F.greatest(F.lit(1), F.floor(F.col("fps") * interval)).cast("long")
    v = videos.where("fps > 0").withColumns({"_begin": begin, "_stop": stop, "_stride": stride}).where("_begin <= _stop")
    v = v.select("run_id", "fps", F.coalesce("start_time", F.lit(0.0)).alias("_start"), F.posexplode(F.sequence("_begin", "_stop", "_stride")).alias("_n", "frame_number"))
    absolute = F.col("frame_number") / F.col("fps")
    name = F.format_string(f"{prefix}_%04d", F.col("_n") + 1)
    return v.select("run_id", name.alias("frame_id"), "frame_number", (absolute - F.col("_start")).alias("timestamp"), absolute.alias("absolute_timestamp"), F.concat(name, F.format_string("_t%.1fs.jpg", absolute - F.col("_start"))).alias("path"))


def _either(content: Column, element: str, key: str) -> Column:
    """Elements of a JSON text that is a list of them or an object with the list under key."""
    as_list = F.from_json(content, T._parse_datatype_string(f"array<{element}>"))
    as_object = F.from_json(content, T._parse_datatype_string(f"struct<{key}:array<{element}>>"))[key]
    return F.when(F.trim(content).startswith("["), as_list).otherwise(as_object)


def segments_of(documents: DataFrame, content: str = "content") -> DataFrame:
    """(run_id, seg_idx, start, end, text) of JSON texts (run_id, content), bare or wrapped."""
    s = documents.select("run_id", F.posexplode(_either(F.col(content), SEGMENT, "segments")).alias("seg_idx", "s"))
    return s.select("run_id", "seg_idx", "s.start", "s.end", "s.text")


def frames_of(documents: DataFrame, content: str = "content") -> DataFrame:
    """(run_id, frame_idx, time, path) of JSON texts, bare or wrapped; the time is called timestamp or time."""
    s = documents.select("run_id", F.posexplode(_either(F.col(content), FRAME, "frames")).alias("frame_idx", "f"))
    return s.select("run_id", "frame_idx", F.coalesce("f.timestamp", "f.time", F.lit(0.0)).alias("time"), "f.path")


def boards_of(documents: DataFrame, content: str = "content") -> DataFrame:
    """(run_id, seg_idx, board) of JSON texts, bare or wrapped: a list parallel to the segments, of lists that are empty or hold one text."""
    s = documents.select("run_id", F.posexplode(_either(F.col(content), "array<string>", "board_elements")).alias("seg_idx", "b"))
    return s.select("run_id", "seg_idx", F.coalesce(F.get("b", 0), F.lit("")).alias("board"))


def spoken(replies: DataFrame) -> DataFrame:
    """Segments of replies (run_id, text, audio_duration, sentences, utterances): sentences, or else utterances, or else one segment of the whole text.

    Times are milliseconds in the reply and seconds in the result. Replies
    with words alone go through operators.sentences.align_sentences first.
    """
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("start"), (F.col("audio_duration") * 1000).cast("long").alias("end")))
    best = F.when(F.size("sentences") > 0, F.col("sentences")).when(F.size("utterances") > 0, F.col("utterances")).when(F.coalesce("text", F.lit("")) != "", whole)
    s = replies.select("run_id", F.posexplode(best).alias("seg_idx", "s"))
    return s.select("run_id", "seg_idx", (F.col("s.start") / 1000.0).alias("start"), (F.col("s.end") / 1000.0).alias("end"), F.trim("s.text").alias("text"))


def spoken_by_words(replies: DataFrame) -> DataFrame:
    """Words (run_id, word_idx, text, start_ms, end_ms) of replies (run_id, words): what operators.sentences groups or aligns.

    The cascade for replies of this kind is: words grouped to sentences where
    there is a text, or else utterances, or else one segment for each word.
    """
    w = replies.select("run_id", F.posexplode("words").alias("word_idx", "w"))
    return w.select("run_id", F.col("word_idx").cast("long").alias("word_idx"), "w.text", F.col("w.start").alias("start_ms"), F.col("w.end").alias("end_ms"))


def spoken_rest(replies: DataFrame) -> DataFrame:
    """(run_id, seg_idx, start, end, text) of replies (run_id, text, utterances, words) of the plain service.

    A reply with a text gives its words as sentences, none if it has no words;
    one without a text its utterances, or else a segment for each word.
    """
    has_text = F.coalesce("text", F.lit("")) != ""
    grouped = words_to_sentences(spoken_by_words(replies.where(has_text))).select("run_id", F.col("sent_idx").alias("seg_idx"), "start", "end", "text")
    best = F.when(F.size("utterances") > 0, F.col("utterances")).when(F.size("words") > 0, F.col("words"))
    s = replies.where(~has_text).select("run_id", F.posexplode(best).alias("seg_idx", "s"))
    return grouped.unionByName(s.select("run_id", F.col("seg_idx").cast("long").alias("seg_idx"), seconds(F.col("s.start")).alias("start"), seconds(F.col("s.end")).alias("end"), "s.text"))


def summary(spark: SparkSession, path: str, schema: str = "video string, status string, run_id string, output_dir string, error string") -> DataFrame:
    """The experiment summary at path; empty if there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
