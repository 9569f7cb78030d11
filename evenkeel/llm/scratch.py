"""Shared scratch space: the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows in an Arrow batch of the session, for stages that send whole texts to Python: Spark's
    default of 10,000 keeps several times the memory outside the heap, on both sides, for nothing."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def scratch_root(spark: SparkSession) -> str:
    """The session's shared folder.  Where it is unset a local folder is made, for a local master only."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in shared scratch and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The same, bucketed and sorted by ``keys``: one sorted file a bucket, so that joins on the keys move the
    other side only.  The catalog's entry is dropped once the table can be read; its files stay."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  # resolved before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return out
