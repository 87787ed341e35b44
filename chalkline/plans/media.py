"""Queries on frames, signatures, vectors and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from ..catalog import query
from ..functions import signatures as sig, text as t
from ..operators import folds, runs, search
from ..sources import files
from ..sources.relations import FRAMES_SQL, frames, table

_STRIDE = """SELECT run_id, printf('frame_%04d', n + 1) AS frame_id, frame_number, frame_number / fps - start_time AS "timestamp", frame_number / fps AS absolute_timestamp
FROM (SELECT *, unnest(range(CAST(floor(start_time * fps) AS BIGINT), total_frames + 1, CAST(greatest(1, floor(fps * 3.0)) AS BIGINT))) AS frame_number,
             unnest(range(0, len(range(CAST(floor(start_time * fps) AS BIGINT), total_frames + 1, CAST(greatest(1, floor(fps * 3.0)) AS BIGINT))))) AS n
      FROM (SELECT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, count(*) * 100 AS total_frames, (user_id % 3)::DOUBLE AS start_time FROM events GROUP BY user_id))
WHERE frame_number <= total_frames"""


@query(_STRIDE)
def frame_stride_sample(spark, sf_dir):
    return sampled_frames(spark, sf_dir).drop("path")


def sampled_frames(spark, sf_dir):
    """A recording for each user, sampled every three seconds."""
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.count(F.lit(1)) * 100).alias("total_frames"))
    v = v.select("run_id", "total_frames", F.when(F.col("run_id") % 2 == 0, 25.0).otherwise(30.0).alias("fps"), (F.col("run_id") % 3).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"))
    return files.sampled(v, 3.0)


_VECTORS = """v AS (SELECT label AS run_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"""
_COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-10))"


@query(f"""WITH RECURSIVE {_VECTORS}, f AS (
  SELECT run_id, n, vec_id, e AS last, n AS last_n, true AS kept FROM v WHERE n = 1
  UNION ALL
  SELECT v.run_id, v.n, v.vec_id, CASE WHEN k THEN v.e ELSE f.last END, CASE WHEN k THEN v.n ELSE f.last_n END, k
  FROM (SELECT f.run_id AS rid, f.n AS fn, f.last, f.last_n, v.n AS vn, {_COS.format('f.last', 'v.e')} < 0.0 OR 3.0 * (v.n - f.last_n) >= 9.0 AS k FROM f JOIN v ON v.run_id = f.run_id AND v.n = f.n + 1) f
  JOIN v ON v.run_id = f.rid AND v.n = f.vn)
SELECT run_id, vec_id, kept FROM f""")
def vector_keep_fold(spark, sf_dir):
    """Vectors as signatures: kept if unlike the last kept one, or nine seconds after it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("time", F.row_number().over(Window.partitionBy("run_id").orderBy("vec_id")) * 3.0)
    def keep(last, row):
        a, b = last["e"], row["e"]
        return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-10) < 0.0 or row["time"] - last["time"] >= 9.0

    out = folds.keep_fold(e, ["time", "vec_id"], ["e"], keep)
    return out.select("run_id", "vec_id", "kept")


@query("""WITH RECURSIVE v AS (SELECT user_id AS run_id, event_id, value, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (
  SELECT run_id, n, event_id, value AS last, s AS last_s, true AS kept FROM v WHERE n = 1
  UNION ALL
  SELECT v.run_id, v.n, v.event_id, CASE WHEN abs(v.value - f.last) > 25 OR v.s - f.last_s >= 21600 THEN v.value ELSE f.last END,
         CASE WHEN abs(v.value - f.last) > 25 OR v.s - f.last_s >= 21600 THEN v.s ELSE f.last_s END, abs(v.value - f.last) > 25 OR v.s - f.last_s >= 21600
  FROM f JOIN v ON v.run_id = f.run_id AND v.n = f.n + 1)
SELECT run_id, event_id, kept FROM f""")
def value_keep_fold(spark, sf_dir):
    """Events: recognised if the value moved by more than 25 since the last recognised one, or six hours passed; others are skipped but stay in the result."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = frames(spark, sf_dir).select("run_id", "event_id", "value", s.alias("s"))
    out = folds.keep_fold(e, ["s", "event_id"], ["value"], lambda last, row: abs(row["value"] - last["value"]) > 25 or row["s"] - last["s"] >= 21600)
    return out.select("run_id", "event_id", "kept")


_THUMBS = """g AS (SELECT label AS run_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n,
       list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) * {scale} + 1) * 127.5) AS BIGINT)) AS p FROM embeddings)"""
_BINS = "list_transform(range(0, 32), lambda b: CAST(len(list_filter({0}, lambda v: v // 8 = b)) AS DOUBLE))"
_CORR = """(CASE WHEN len({a}) * list_dot_product({a}, {a}) - list_sum({a}) * list_sum({a}) <= 0 OR len({b}) * list_dot_product({b}, {b}) - list_sum({b}) * list_sum({b}) <= 0
  THEN (CASE WHEN len({a}) * list_dot_product({a}, {a}) - list_sum({a}) * list_sum({a}) <= 0 AND len({b}) * list_dot_product({b}, {b}) - list_sum({b}) * list_sum({b}) <= 0 THEN 1.0 ELSE 0.0 END)
  ELSE (len({a}) * list_dot_product({a}, {b}) - list_sum({a}) * list_sum({b}))
    / sqrt((len({a}) * list_dot_product({a}, {a}) - list_sum({a}) * list_sum({a})) * (len({b}) * list_dot_product({b}, {b}) - list_sum({b}) * list_sum({b}))) END)"""
_APART = "list_transform(list_zip({0}, {1}), lambda z: abs(z[1] - z[2]))"


def _thumbs(spark, sf_dir, scale):
    """Vectors of a label as the frames of a recording, three seconds apart, with a thumbnail of 64 values."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), "vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") * scale + 1) * 127.5).cast("int")).alias("thumb"))
    return e.withColumn("timestamp", F.row_number().over(Window.partitionBy("run_id").orderBy("vec_id")) * F.lit(1.5))


@query(f"""WITH RECURSIVE {_THUMBS.format(scale=1.0)}, v AS (SELECT *, 1.5 * n AS t, {_BINS.format('p')} AS h FROM g), f AS (
  SELECT run_id, n, vec_id, h AS lh, p AS lp, t AS lt, true AS kept FROM v WHERE n = 1
  UNION ALL
  SELECT run_id, n, vec_id, CASE WHEN k THEN h ELSE lh END, CASE WHEN k THEN p ELSE lp END, CASE WHEN k THEN t ELSE lt END, k
  FROM (SELECT v.*, f.lh, f.lp, f.lt, ({_CORR.format(a='f.lh', b='v.h')} < 0.85 AND list_sum({_APART.format('f.lp', 'v.p')}) / 64.0 / 255.0 > 0.05) OR v.t - f.lt >= 5.0 AS k
        FROM f JOIN v ON v.run_id = f.run_id AND v.n = f.n + 1))
SELECT run_id, vec_id, kept FROM f""")
def frame_keep_fold(spark, sf_dir):
    """Frames kept by histogram correlation and mean difference to the last kept one, or after a gap."""
    frames_ = _thumbs(spark, sf_dir, 1.0).withColumn("hist", sig.histogram(F.col("thumb")))
    return folds.keep_frames(frames_).select("run_id", "vec_id", "kept")


_CHANNELS = ", ".join(_BINS.format(f"p[{lo}:{hi}]") for lo, hi in ((1, 21), (22, 42), (43, 64)))


@query(f"""WITH RECURSIVE {_THUMBS.format(scale=0.22)}, v AS (SELECT *, [{_CHANNELS}] AS h FROM g), f AS (
  SELECT run_id, n, vec_id, h AS lh, p AS lp, true AS kept, 0.0::DOUBLE AS s, 1.0::DOUBLE AS c FROM v WHERE n = 1
  UNION ALL
  SELECT run_id, n, vec_id, CASE WHEN NOT (s >= 0.88 AND c < 0.003) THEN h ELSE lh END, CASE WHEN NOT (s >= 0.88 AND c < 0.003) THEN p ELSE lp END, NOT (s >= 0.88 AND c < 0.003), s, c
  FROM (SELECT v.*, f.lh, f.lp, least(1.0, greatest(0.0, (({' + '.join(_CORR.format(a=f'f.lh[{i}]', b=f'v.h[{i}]') for i in (1, 2, 3))}) / 3 + 1) / 2)) AS s,
               len(list_filter({_APART.format('f.lp', 'v.p')}, lambda d: d > 15)) / 64.0::DOUBLE AS c
        FROM f JOIN v ON v.run_id = f.run_id AND v.n = f.n + 1))
SELECT run_id, vec_id, kept, CASE WHEN kept THEN 'vision' ELSE printf('skipped_similar_frame (sim=%.3f, change=%.4f)', s, c) END AS method FROM f""")
def ocr_skip_fold(spark, sf_dir):
    """Frames that recognition may skip, since the last recognised one looks the same, with the reason."""
    t = F.col("thumb")
    rgb = F.array(*[sig.histogram(F.slice(t, lo, n)) for lo, n in ((1, 21), (22, 21), (43, 22))])
    out = folds.skip_frames(_thumbs(spark, sf_dir, 0.22).withColumn("hist_rgb", rgb))
    return out.select("run_id", "vec_id", "kept", folds.skip_method(F.col("kept"), F.col("similarity"), F.col("change_ratio")).alias("method"))


_PIXELS = "list_transform(embedding, lambda x: CAST(floor((x + 1) * 127.5) AS INTEGER))"


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("p"))


_PIX = "p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS p FROM embeddings)"
_HIST = "list_transform(range(0, 32), lambda b: CAST(len(list_filter(p, lambda v: v // 8 = b)) AS DOUBLE))"


@query(f"WITH {_PIX} SELECT vec_id, array_to_string(list_transform({_HIST}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS hist FROM p")
def histogram32(spark, sf_dir):
    return _pixels(spark, sf_dir).select("vec_id", F.array_join(F.transform(sig.histogram(F.col("p")), lambda x: x.cast("int").cast("string")), ",").alias("hist"))


def _pairs(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


_PAIRS = f"{_PIX}, q AS (SELECT a.vec_id, a.p AS p, b.p AS q FROM p a JOIN p b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH {_PAIRS}, h AS (SELECT vec_id, {_HIST} AS a, {_HIST.replace('list_filter(p', 'list_filter(q')} AS b FROM q),
u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM h) SELECT vec_id, round(corr(x, y), 6) AS correlation FROM u GROUP BY vec_id""")
def hist_correlation(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", sig.histogram(F.col("p")).alias("a"), sig.histogram(F.col("q")).alias("b")).select("vec_id", F.round(sig.correlation(F.col("a"), F.col("b")), 6).alias("correlation"))


@query(f"WITH {_PAIRS}, u AS (SELECT vec_id, unnest(p) AS x, unnest(q) AS y FROM q) SELECT vec_id, round(avg(abs(x - y)) / 255.0, 6) AS difference FROM u GROUP BY vec_id")
def mean_abs_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(sig.mean_difference(F.col("p"), F.col("q")), 6).alias("difference"))


@query(f"WITH {_PAIRS}, u AS (SELECT vec_id, unnest(p) AS x, unnest(q) AS y FROM q) SELECT vec_id, round(avg(CASE WHEN abs(x - y) > 15 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM u GROUP BY vec_id")
def pixel_change_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(sig.changed_ratio(F.col("p"), F.col("q")), 6).alias("ratio"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id, {_COS.format('q.e', 'e.e')} AS score FROM e q JOIN e ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.30)
SELECT query, vec_id, round(score, 6) AS score FROM r WHERE r <= 5""")
def semantic_search_topk(spark, sf_dir):
    """For every twentieth vector the five most like it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k_each(e, e.where("vec_id % 20 = 0"), "vec_id").withColumn("score", F.round("score", 6))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS q FROM e WHERE vec_id = 0)
SELECT vec_id, round({_COS.format('e', 'q')}, 6) AS score FROM e, q WHERE {_COS.format('e', 'q')} >= 0.30 ORDER BY {_COS.format('e', 'q')} DESC, vec_id LIMIT 5""")
def search_one(spark, sf_dir):
    """The five vectors most like one vector, as a question asks."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").select("embedding").first()  # one vector
    return search.top_k(e, list(asked[0]) if asked else [], order="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\\.[^./]+$')) IN ('.html', '.mp4')")
def video_scan(spark, sf_dir):
    """Pages by the suffix of their address, as files are scanned."""
    return table(spark, sf_dir, "pages").where(t.suffix(F.col("url")).isin(".html", ".mp4")).select("page_id", "url")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://site1.example/') THEN '/files/' || substr(url, 23) ELSE '' END AS file_url FROM pages")
def frame_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.frame_url(F.col("url"), "https://site1.example").alias("file_url"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'math' WHEN 'view' THEN 'text' ELSE 'default' END AS preset FROM events")
def preprocess_route(spark, sf_dir):
    """The image preset that suits what a board shows."""
    from ..operators.providers import preset

    shown = F.when(F.col("event_type") == "click", "fraction").when(F.col("event_type") == "view", "bullets").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", preset(shown).alias("preset"))


@query("SELECT vec_id, unnest(['original', 'math_optimized', 'text_optimized', 'minimal', 'aggressive']) AS variant FROM embeddings")
def preprocess_variants(spark, sf_dir):
    from ..operators.providers import VARIANTS

    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))


@query(f"WITH {FRAMES_SQL} SELECT run_id, arg_max(event_type, frame_idx) AS status, count(*) AS changes FROM frames GROUP BY run_id")
def run_status_latest(spark, sf_dir):
    e = frames(spark, sf_dir).select("run_id", F.col("frame_idx").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"))
    return runs.latest_state(e).select("run_id", "status", "changes")


_LOG = """log AS (SELECT 'success' AS status, CAST(event_id AS VARCHAR) AS video, 'out/' || user_id AS output_dir, '' AS error FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'failed', CAST(event_id AS VARCHAR), '', 'lost' FROM events WHERE event_type = 'error')"""


def experiment_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    good = e.where("event_type <> 'error'").select(F.col("event_id").cast("string").alias("video"), F.concat(F.lit("out/"), F.col("user_id").cast("string")).alias("output_dir"))
    bad = e.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("video"), F.lit("lost").alias("error"))
    return runs.experiments(good, bad)


@query(f"WITH {_LOG} SELECT * FROM log")
def experiment_union(spark, sf_dir):
    return experiment_log(spark, sf_dir).select("status", "video", F.coalesce("output_dir", F.lit("")).alias("output_dir"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"WITH {_LOG} SELECT status, count(*) AS n FROM log GROUP BY status")
def experiment_tally(spark, sf_dir):
    return runs.tally(experiment_log(spark, sf_dir))
