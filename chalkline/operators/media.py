"""What becomes of finished runs: embeddings, answers, and audio in several languages, by providers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import languages, search_text
from .providers import Provider, asked, echo, hashed_vector, retried
from .runs import joined_text
from .sentences import CHUNK_WIDTH, chunks

VECTOR = "array<double>"


def embedded(rows: DataFrame, embed: Callable[[str], list[float]] = hashed_vector) -> DataFrame:
    """Result rows (fused_text, board_text, ...) with `document` and its `embedding`; texts are embedded in Arrow batches."""
    docs = rows.withColumn("document", search_text(F.col("fused_text"), F.col("board_text")))

    @F.pandas_udf(VECTOR)
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(embed)

    return docs.withColumn("embedding", vectors("document"))


def recognised(frames: DataFrame, read: Provider, size: int = 1) -> DataFrame:
    """frames (kept, request, ...) with `text`, `confidence` and `error`: only kept ones are sent, skipped ones have an empty text and no confidence."""
    sent = asked(frames.where("kept"), "request", read, size).withColumn("text", F.coalesce("answer", F.lit(""))).drop("answer")
    skipped = frames.where("NOT kept").withColumns({"error": F.lit(None).cast("string"), "text": F.lit("")})
    return sent.unionByName(skipped).withColumn("confidence", F.when(F.col("text") != "", 0.9).otherwise(0.0))


def podcasts(rows: DataFrame, wanted: DataFrame, translate: Provider = echo, speak: Provider = echo, width: int = CHUNK_WIDTH) -> DataFrame:
    """(run_id, language, chunks, audio, error) of rows (run_id, seg_idx, text) in the languages of wanted (run_id, languages as a list in text).

    The transcript of a run is translated once for each language, cut into
    chunks that a speech model takes, spoken chunk by chunk, and joined in
    order. A run is one recording, so its chunks fit in one row.
    """
    asks = joined_text(rows).join(wanted.select("run_id", F.explode(languages(F.col("languages"))).alias("language")), "run_id")
    asks = asked(asks.withColumn("request", F.concat(F.lit("["), F.col("language"), F.lit("] "), F.col("transcript"))), "request", translate, 1)
    parts = asks.select("run_id", "language", F.col("error").alias("translation_error"), F.posexplode(chunks(F.coalesce("answer", F.lit("")), width)).alias("pos", "chunk"))
    spoken = asked(parts, "chunk", speak, 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("answer", F.lit("")).alias("a")))), lambda x: x["a"]), "")
    return spoken.groupBy("run_id", "language").agg(F.count(F.lit(1)).alias("chunks"), joined.alias("audio"), F.max(F.coalesce("translation_error", "error")).alias("error"))


def answer(question: str, reply: Provider = echo) -> str:
    """The reply to a question; a provider that keeps failing raises its last error."""
    got, error = retried(reply, [question], wait=0)
    if error:
        raise RuntimeError(error)
    return got[0]
