"""Queries that call models, by providers that answer by rule."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import latex, replies
from ..operators import align, media, providers, runs, sentences
from ..sources.relations import FRAMES_SQL, SEGMENTS_SQL, frames, segments, table


def _marked(requests: list[str]) -> list[str]:
    return [f"seen: {r}" for r in requests]


def _mute(requests: list[str]) -> list[str]:
    """Speech that fails for texts without an e in the first ten characters."""
    for r in requests:
        if "e" not in r[:10]:
            raise ValueError("mute")
    return requests


@query("""SELECT event_id, least(event_id % 7 + 1, 5) AS attempts, CASE WHEN event_id % 7 < 5 THEN 'done' ELSE '' END AS answer, CAST(pow(2, least(event_id % 7, 4)) - 1 AS DOUBLE) AS waited FROM events""")
def provider_retries(spark, sf_dir):
    """Calls that fail a fixed number of times: attempts, answer and seconds waited between them."""
    rows = table(spark, sf_dir, "events").select("event_id")

    def run(batches):
        for f in batches:
            out = []
            for n in f["event_id"]:
                tries, slept = [], []

                def call(requests):
                    tries.append(1)
                    if len(tries) <= n % 7:
                        raise RuntimeError("rate_limit")
                    return ["done"]

                got, _ = providers.retried(call, ["x"], sleep=slept.append)
                out.append((n, len(tries), got[0] or "", float(sum(slept))))
            yield pd.DataFrame(out, columns=["event_id", "attempts", "answer", "waited"])

    return rows.mapInPandas(run, "event_id long, attempts long, answer string, waited double")


@query(f"""WITH {FRAMES_SQL} SELECT run_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'seen: ' || event_type END AS text, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM frames""")
def frame_recognition(spark, sf_dir):
    """Only frames that aren't skipped are sent; skipped ones have an empty text."""
    f = frames(spark, sf_dir).select("run_id", "event_id", (F.col("event_id") % 3 != 0).alias("kept"), F.col("event_type").alias("request"))
    return media.recognised(f, _marked, size=16).select("run_id", "event_id", "text", "confidence")


@query(f"""WITH {SEGMENTS_SQL}, b AS (SELECT run_id, seg_idx // 4 AS batch_id, string_agg('{{"id":' || seg_idx || ',"transcript":' || to_json(text) || ',"board_latex":' || CASE WHEN seg_idx % 2 = 0 THEN '["x_1"]' ELSE '[]' END || '}}', ',' ORDER BY seg_idx) AS x FROM segments GROUP BY ALL)
SELECT run_id, batch_id, '[' || x || ']' AS request FROM b""")
def fusion_requests(spark, sf_dir):
    """The JSON that is sent for each batch of segments."""
    s = segments(spark, sf_dir).select("run_id", "seg_idx", F.col("text").alias("transcript"), F.when(F.col("seg_idx") % 2 == 0, "x_1").alias("board"))
    return sentences.batches(s).select("run_id", "batch_id", replies.request(F.col("items")).alias("request"))


@query(f"WITH {SEGMENTS_SQL} SELECT run_id, seg_idx, {latex.latex_to_text_sql('text')} AS fused FROM segments")
def fused_segments(spark, sf_dir):
    """Batches sent to a model that answers with the transcripts, its replies repaired and joined to their segments."""
    s = segments(spark, sf_dir)
    asks = sentences.batches(s.select("run_id", "seg_idx", F.col("text").alias("transcript"), F.lit("").alias("board"))).select("run_id", "batch_id", replies.request(F.col("items")).alias("request"))

    def fuse(requests):
        return [r.replace('"transcript"', '"fused"') for r in requests]

    got = replies.repaired(providers.asked(asks, "request", fuse, 1).select("run_id", "batch_id", F.col("answer").alias("content")))
    return align.attach(s.select("run_id", "seg_idx"), got.select("run_id", "id", "fused", F.col("batch_id").alias("at")))


_SPLIT = r"list_filter(regexp_split_to_array(lower(doc), '\s+'), lambda x: x <> '')"


@query(rf"""WITH {SEGMENTS_SQL}, d AS (SELECT run_id, seg_idx, text || CASE WHEN seg_idx % 2 = 0 THEN ' | board: ' || upper(substr(text, 1, 1)) ELSE '' END AS doc FROM segments),
w AS (SELECT run_id, seg_idx, md5(unnest({_SPLIT})) AS h FROM d),
p AS (SELECT run_id, seg_idx, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS place, sum(CASE WHEN substr(h, 9, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL)
SELECT run_id, seg_idx, place, CAST(v AS DOUBLE) AS v FROM p WHERE v <> 0""")
def embedded_documents(spark, sf_dir):
    """Search documents and their vectors, one row for each place that isn't 0."""
    s = segments(spark, sf_dir).select("run_id", "seg_idx", F.col("text").alias("fused_text"), F.when(F.col("seg_idx") % 2 == 0, F.upper(F.substring("text", 1, 1))).otherwise("").alias("board_text"))
    e = media.embedded(s).select("run_id", "seg_idx", F.posexplode("embedding").alias("place", "v"))
    return e.where("v <> 0").withColumn("place", F.col("place").cast("long"))


@query("SELECT conv_id, turn, 'seen: ' || coalesce(text, '') AS answer FROM conversations WHERE role = 'user'")
def chat_answers(spark, sf_dir):
    """Questions answered one by one, without the transcript."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return providers.asked(c, "text", _marked, 1).select("conv_id", "turn", "answer")


@query(rf"""WITH {SEGMENTS_SQL}, w AS (SELECT run_id, string_agg(regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY seg_idx) AS doc FROM segments GROUP BY run_id),
l AS (SELECT run_id, '[' || language || '] ' || doc AS doc, language FROM w, (SELECT unnest(['English', 'German']) AS language) WHERE run_id % 2 = 0 OR language = 'English')
SELECT run_id, language, len(list_filter(regexp_split_to_array(doc, '\s+'), lambda x: x <> '')) AS words, md5(regexp_replace(doc, '\s+', '', 'g')) AS spoken FROM l""")
def podcast_audio(spark, sf_dir):
    """Transcripts translated, cut into chunks, spoken and joined, in the languages of each run; all words are spoken."""
    s = segments(spark, sf_dir)
    wanted = s.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 2 == 0, "English, German,").otherwise(" ,").alias("languages"))
    p = media.podcasts(s, wanted, width=3200, speak=lambda xs: [x + "\n" for x in xs])
    return p.select("run_id", "language", F.size(F.filter(F.split("audio", r"\s+"), lambda x: x != "")).cast("long").alias("words"), F.md5(F.regexp_replace("audio", r"\s+", "")).alias("spoken"))


@query(f"WITH {SEGMENTS_SQL} SELECT run_id, seg_idx, CASE WHEN contains(substr(text, 1, 10), 'e') THEN printf('segment_%03d.mp3', seg_idx + 1) ELSE '' END AS audio_path FROM segments")
def spoken_segments(spark, sf_dir):
    """A numbered file for each segment that could be spoken."""
    return providers.spoken_files(segments(spark, sf_dir), "text", _mute).select("run_id", "seg_idx", "audio_path")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Anna Deep' WHEN 1 THEN 'DEEP Bass' WHEN 2 THEN 'anna' ELSE '' END AS voice FROM events")
def voice_choice(spark, sf_dir):
    n = F.col("event_id") % 4
    names = F.array(F.lit("Carl"), F.lit("Anna Deep"), F.lit("DEEP Bass"), F.lit("anna"))
    some = F.when(n == 0, names).when(n == 1, F.slice(names, 3, 2)).otherwise(F.slice(names, 4, 1))
    wanted = F.when(n == 2, "ANNA").otherwise("deep")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(runs.voice(some, wanted), F.lit("")).alias("voice"))


@query("SELECT page_id, CASE WHEN contains(substr(url, 1, 10), 'e') THEN url ELSE '' END AS audio FROM pages")
def extracted_audio(spark, sf_dir):
    """The sound of each video, empty where the extraction failed."""
    return providers.extracted(table(spark, sf_dir, "pages").select("page_id", "url"), "url", _mute).select("page_id", "audio")
