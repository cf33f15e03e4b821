"""Cutting lineage with a written table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished write are not needed again; without this they wait for the driver's garbage collector.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: one evaluation, and executor loss cannot change it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/heldout-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote, once nothing reads them any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 100_000, mb: int = 64) -> DataFrame:
    """Written table, hinted for broadcast only when its counted rows and its bytes allow; otherwise a plain join side."""
    table = durable(df)
    if table.count() > rows:
        return table
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.written_to)
    size = path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if size <= mb << 20 else table
