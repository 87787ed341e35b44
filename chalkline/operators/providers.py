"""Calls of outside models: recognition, speech, fusion, embeddings and voices.

A provider is a function from a list of requests to a list of answers. It is
called once for each new request: answers are kept in a table keyed by the
request's hash, the provider's name and its parameters, and read back, so a
repeated action or a lost executor doesn't pay again. Without a network, the
providers below answer by fixed rules.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .runs import audio_path

Provider = Callable[[list[str]], list[str]]

# Presets by what a board shows, and the variants of an image.
MATH = ["equation", "fraction", "integral", "summation", "limit"]
TEXT = ["definition", "bullets", "steps", "abbreviation"]
PRESETS = {"math": {"target_height": 1000, "sharpen": True}, "text": {"target_height": 800, "binarize": True}, "default": {"target_height": 800}}
VARIANTS = ["original", "math_optimized", "text_optimized", "minimal", "aggressive"]
ATTEMPTS, FIRST_WAIT = 5, 1.0


def preset(structure: Column) -> Column:
    return F.when(structure.isin(MATH), "math").when(structure.isin(TEXT), "text").otherwise("default")


def retried(call: Provider, requests: list[str], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str | None], str | None]:
    """The answers, or the last error; waits double from attempt to attempt."""
    error = None
    for n in range(attempts):
        try:
            answers = call(requests)
            if len(answers) != len(requests):
                raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            return list(answers), None
        except Exception as e:  # whatever a service raises is an answer's error, not the job's
            error = f"{type(e).__name__}: {e}"
            if n + 1 < attempts and wait:
                sleep(wait * 2**n)
    return [None] * len(requests), error


def asked(rows: DataFrame, request: str, call: Provider, size: int = 4, wait: float = FIRST_WAIT) -> DataFrame:
    """rows with `answer` and `error`; requests are sent `size` at a time and retried."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "answer string", "error string"])

    def run(frames):
        for f in frames:
            answers, errors = [], []
            for lo in range(0, len(f), size):
                got, error = retried(call, f[request].iloc[lo : lo + size].fillna("").tolist(), wait=wait)
                answers += got
                errors += [error] * len(got)
            yield f.assign(answer=pd.Series(answers, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    return rows.mapInPandas(run, schema)


def polled(ask, waits: list[float], sleep) -> dict:
    """The first answer of ask() whose status is final; sleeps between asking, and gives up when the waits are used up."""
    for wait in [*waits, None]:
        got = ask()
        if got.get("status") == "completed":
            return got
        if got.get("status") == "error":
            raise RuntimeError(got.get("error") or "the service failed")
        if wait is not None:
            sleep(wait)
    raise TimeoutError("no final status")


class RuledService:
    """A speech service without a network: a request is asked for as many times as its number modulo 5 says, and then done, or failed for the last of these."""

    def upload(self, audio: str) -> str:
        return f"memory:{audio}"

    def request(self, address: str) -> str:
        self.left = int(address.rsplit(":", 1)[1]) % 5
        self.fails = self.left == 4
        return address

    def status(self, request: str) -> dict:
        if self.left:
            self.left -= 1
            return {"status": "processing"}
        return {"status": "error", "error": "no speech"} if self.fails else {"status": "completed", "text": request}


def transcribed(rows: DataFrame, audio: str, service: Callable, waits: tuple[float, ...] = (0.0,) * 60) -> DataFrame:
    """rows with `status`, `asked` (times the service was polled), `text` and `error`: each row's audio is uploaded, requested and polled."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("status string, asked long, text string, error string").fields])

    def run(frames):
        for f in frames:
            out = []
            for a in f[audio]:
                s, asked_ = service(), []
                try:
                    request = s.request(s.upload(a))
                    got = polled(lambda: asked_.append(1) or s.status(request), list(waits), time.sleep)
                    out.append(("completed", len(asked_), got.get("text"), None))
                except Exception as e:  # a failed request is a row's error, not the job's
                    out.append(("error", len(asked_), None, f"{type(e).__name__}: {e}"))
            yield f.assign(**{c: pd.Series([x[i] for x in out], index=f.index, dtype=object if i != 1 else "int64") for i, c in enumerate(("status", "asked", "text", "error"))})

    return rows.mapInPandas(run, schema)


def probed(videos: DataFrame) -> DataFrame:
    """videos (fps, total_frames, ...) with `duration` in seconds; 0 without a frame rate."""
    return videos.withColumn("duration", F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(F.lit(0.0)))


def extracted(videos: DataFrame, path: str, extract: Provider) -> DataFrame:
    """videos with `audio`, the path of the sound that extract() made of each, empty where it failed, and `error`."""
    got = asked(videos, path, extract, 1, wait=0)
    return got.withColumn("audio", F.coalesce("answer", F.lit(""))).drop("answer")


def spoken_files(rows: DataFrame, text: str, speak: Provider) -> DataFrame:
    """rows (seg_idx, ...) with `audio_path`: the numbered file that speak() made, empty where it failed or there is nothing to say."""
    got = asked(rows, text, speak, 1, wait=0)
    return got.withColumn("audio_path", audio_path(F.col("seg_idx").cast("int"), F.col("error").isNull() & (F.coalesce(F.col(text), F.lit("")) != ""))).drop("answer", "error")


def remembered(spark: SparkSession, rows: DataFrame, request: str, name: str, call: Provider, memory: str, **parameters) -> DataFrame:
    """rows with `answer` and `error`, from the memory table at path `memory`; only requests it lacks are sent, each once."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(name), F.lit(repr(sorted(parameters.items()))), F.coalesce(F.col(request), F.lit(""))), 256)
    schema = "key string, answer string, error string"
    known = spark.read.schema(schema).parquet(memory) if _exists(spark, memory) else spark.createDataFrame([], schema)
    wanted = rows.select(key.alias("key"), F.coalesce(F.col(request), F.lit("")).alias("request")).dropDuplicates(["key"])
    new = wanted.join(known.where("error IS NULL").select("key"), "key", "left_anti")
    asked(new, "request", call).select("key", "answer", "error").write.mode("append").parquet(memory)
    all_ = spark.read.schema(schema).parquet(memory)
    best = all_.groupBy("key").agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "answer", "error")).alias("b")).select("key", "b.answer", "b.error")
    return rows.withColumn("key", key).join(best, "key", "left").drop("key")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# providers that need no network

def echo(requests: list[str]) -> list[str]:
    """Fusion's rule of last resort: the transcript as it is."""
    return requests


def silent(requests: list[str]) -> list[str]:
    """Recognition that sees nothing."""
    return [""] * len(requests)


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A bag of words as a vector: each word adds +1 or -1 at a place of its MD5."""
    v = [0.0] * size
    for w in text.lower().split():
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:8], 16) % size] += 1.0 if int(h[8], 16) >= 8 else -1.0
    return v
