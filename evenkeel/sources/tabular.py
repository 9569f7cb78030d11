"""Sources and sinks with contracts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json"}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; where it is unset a local one, for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Compute once: write as Parquet in scratch space and read back, for a table that is used several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by extension; an unknown one or a missing path is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for .{kind}")
    if kind == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(FORMATS[kind]).options(**options).load(path)


def load_declared_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only the declared columns, with the declared types; bad lines, missing or doubled headers are errors."""
    header = spark.read.option("header", False).csv(path).first()
    names = [x for x in (header or []) if x is not None]
    wanted = schema.fieldNames()
    if len(set(names)) < len(names):
        raise ValueError("a header name comes twice")
    if missing := [c for c in wanted if c not in names]:
        raise ValueError(f"missing columns: {missing}")
    types = {f.name: f for f in schema.fields}
    full = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.schema(full).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path).select(*wanted)


def write_parquet_guarded(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write; keep equal content as it is and refuse to replace other content unless ``force``.  True if written."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if exists and not force:
        old = spark.read.parquet(path)
        same = old.columns == df.columns and old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty()
        if not same:
            raise ValueError(f"{path} holds other content")
        return False
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)
    return True


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An aggregate table as one CSV or JSON file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
