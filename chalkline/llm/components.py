"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import drop, written


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(id, root) of every id on an edge (a, b), where root is the least id of its component; and the table it lies in.

    Each round is two joins with per-id minima, combined on the map side; edges
    never gather in one place. Rounds end when nothing changes any more, and
    each is a table of the shared folder, so the lineage stays short.
    """
    spark = edges.sparkSession
    state, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = written(small, "components")
        drop(spark, path)
        state, path = new, new_path
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    roots = state.select(F.col("v").alias("id")).distinct().join(state.select(F.col("u").alias("id")), "id", "left_anti")
    return state.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root"))), path
