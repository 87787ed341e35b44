"""Tables and lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: For null ids while rows are joined; SQL joins would lose them.
NO_ID = -(2**63)


#: Tables that queries may still read; they go when the program ends.
_LEFT: set[str] = set()


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended before
            drop(spark, *list(_LEFT))


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chalkline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared(spark)}/chalkline/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def session(spark: SparkSession, **settings: str):
    """Runs the block with these settings ("__" stands for "."), then puts the old ones back."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def swept(spark: SparkSession):
    """The shuffles of queries in this block are removed as soon as each has ended."""
    return session(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table of the shared folder: lost executors cost no more than a read. Also its path, for drop()."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with swept(spark):
        df.write.parquet(path)
    _LEFT.add(path)
    return spark.read.schema(df.schema).parquet(path), path


#: A key is hot if more than one row in HOT has it; there are fewer than HOT such keys.
HOT = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """rows (key, ...) with the columns of groups (key, size, ...), which has a row for each key; keys that groups lacks get nulls.

    The groups of hot keys, fewer than HOT by their definition, are broadcast,
    so a key with a third of all rows never meets in one task; rows of hot keys
    pass the join by hash under a key made of `spread`.
    """
    kind = {k: t for k, t in groups.dtypes}
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT > total)
    own = [c for c in groups.columns if c != key]
    out = rows.join(F.broadcast(hot.select(F.col(key).alias("_h"), *[F.col(c).alias(f"_h_{c}") for c in own])), F.col(key) == F.col("_h"), "left")
    out = out.withColumn("_k", F.when(F.col("_h").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col(spread).cast("string"), F.lit("")))))
    rest = groups.where(F.col(size) * HOT <= total).select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in own])
    return out.join(rest, "_k", "left").select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_r_{c}").cast(kind[c]).alias(c) for c in own])


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables of written() that nothing reads any more; their shuffles went when they were written."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _LEFT.discard(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
