"""Session helpers shared by every operator: lineage cuts, sizing and hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own; on a cluster a missing
    setting is an error, because executors could not see a driver-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="promptloom-")
    return _OWN_DIRS[app]


def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may already be gone
            pass
    _WRITTEN.clear()


atexit.register(_drop_written)


def materialize(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    Unlike an RDD checkpoint the copy is columnar and compressed, so later stages still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/promptloom/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession, floor: int = 4) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they identify a text without shuffling it."""
    salted = F.concat_ws("\u0001", F.lit("k"), *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(salted).alias("k2")]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], *, how: str = "inner", share: int = 200) -> DataFrame:
    """Join where ``left`` may have hot keys and ``right`` holds few rows per key.

    Keys above 1/``share`` of the left rows are hot; at most ``share`` of them can exist, so their list is
    small whatever the input. Hot left rows spread over salts taken from a hash of the row (a retried task
    gives the same salts) and only hot right rows are replicated. Null keys never match. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    spark = left.sparkSession
    total = left.count()
    limit = max(1, total // share)
    if total <= limit:
        return left.join(right, keys, how)
    counts = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > limit).collect()
    if not hot:
        return left.join(right, keys, how)
    width = shuffle_width(spark)
    table = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], left.select(*keys).schema).withColumn("_salts", F.lit(width))
    tagged_left = left.join(F.broadcast(table), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))).drop("_salts")
    tagged_right = right.join(F.broadcast(table), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return tagged_left.join(tagged_right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores when the input has fewer splits than cores, for steps heavy on CPU.

    Larger inputs already have enough splits and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() < cores else df
