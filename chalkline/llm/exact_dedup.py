"""Exact dedup as a stateful stream.

The documents are read as a stream. Its state is keyed by the SHA-256 of the
normalised text, lies on disk (RocksDB), never expires, and keeps for each
digest the number of rows, the stable identifier of the row that stays and the
locator of its content (file and row in the file). The state is an aggregate,
so each task first folds its own rows of a digest into one: a text with
billions of copies costs one state row per task. New files can be added by
running the stream again on the same checkpoint.

A hit (a digest of two rows or more) isn't trusted: the bytes of the texts of
each hit are compared, and texts that differ in spite of equal digests are put
into groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import drop, fresh, session, with_group, written

#: Characters that don't count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _rank() -> Column:
    """Orders rows of one text: most code points, then the smallest doc_id (null is the largest)."""
    return F.struct(F.col("n_points"), (-F.col("doc_id")).alias("neg_id"), F.col("file"), F.col("row"))


def update_state(spark: SparkSession, path: str, schema, state: str, out: str, digest=sha256) -> None:
    """Streams the files at path that the checkpoint `state` hasn't seen into the state, and writes changed keys to out."""
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since path may be one file
    keyed = stream.select(
        digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_points"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    kept = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank()).alias("keeper"))

    def emit(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/run={batch:08d}")

    with session(spark, spark__sql__streaming__stateStore__providerClass=PROVIDER,
                 spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
                 spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # else 4 MB and more of empty disk a partition
                 spark__sql__streaming__noDataMicroBatches__enabled="false"):
        query = (kept.writeStream.outputMode("update").option("checkpointLocation", state)
                 .trigger(availableNow=True).foreachBatch(emit).start())
        query.awaitTermination()


def exact_dedup(spark: SparkSession, path: str, digest=sha256) -> DataFrame:
    """One row for each row of the documents at path: which row of its text stays.

    Texts are equal when they are identical without the characters of BLANKS.
    Of equal texts the row with the most code points stays, then the smallest
    doc_id. Null texts count as empty, and all empty texts are equal. Rows that
    repeat a doc_id and a text are told apart by nothing and share their fate;
    a null doc_id comes after all others. An empty table gives no rows. Other
    columns of the table are not read.

    digest: text column -> key column; for tests that force collisions.
    """
    documents = spark.read.parquet(path)
    schema = documents.select("doc_id", "text").schema
    state, log = fresh(spark, "exact-state"), fresh(spark, "exact-log")
    update_state(spark, path, schema, state, log, digest)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    empty = "digest string, group_size long, keeper struct<n_points:int,neg_id:long,file:string,row:long>, batch int"
    try:
        seen = spark.read.schema(empty).parquet(f"{log}/*")
    except Exception as e:  # a stream without rows writes no files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], empty)
    # a digest changed by several runs: its last state
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "keeper")).alias("s")).select("digest", "s.group_size", (-F.col("s.keeper.neg_id")).alias("keep_id"))
    last, _ = written(last, "exact-last")
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_points")).withColumn("digest", digest(F.col("norm")))

    apart = _collided(keyed)
    if apart is None:
        out = with_group(keyed.select("doc_id", "digest"), last, "digest", "group_size", "doc_id")
    else:  # (digest, text) is the key wherever a digest has several texts
        groups = apart.select(F.col("digest").alias("d"), F.col("norm").alias("n"), F.col("group_size").alias("own_size"), F.col("keep_id").alias("own_keep"))
        out = keyed.join(last, "digest", "left").join(groups, (F.col("digest") == F.col("d")) & (F.col("norm") == F.col("n")), "left")
        out = out.select("doc_id", sha256(F.col("norm")).alias("digest"), F.when(F.col("d").isNull(), F.col("keep_id")).otherwise(F.col("own_keep")).alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _collided(keyed: DataFrame) -> DataFrame | None:
    """Compares the bytes of all texts of each hit. None, or the groups of the digests whose texts differ.

    Each task first folds its own rows of a digest to their least and greatest
    text, so a huge group sends two texts a task; equal ends mean equal bytes
    throughout.
    """
    ends = keyed.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    wrong = ends.where("a <> b").select("digest")
    wrong, path = written(wrong, "exact-collisions")
    if wrong.isEmpty():
        drop(keyed.sparkSession, path)
        return None
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id")))
    return (keyed.join(wrong, "digest").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), best.alias("s"))
            .select("digest", "norm", "group_size", (-F.col("s.neg_id")).alias("keep_id")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, max(length(t)) AS most FROM d GROUP BY n),
k AS (SELECT g.n, any_value(g.group_size) AS group_size, min(d.doc_id) AS keep_id FROM g JOIN d ON d.n = g.n AND length(d.t) = g.most GROUP BY g.n)
SELECT d.doc_id, k.keep_id, CAST(k.group_size AS BIGINT) AS group_size, d.doc_id = k.keep_id AS kept, sha256(d.n) AS text_sha256
FROM d JOIN k ON d.n = k.n
"""
