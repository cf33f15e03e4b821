"""Sinks: deterministic ledgers and hash-bound stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ledger(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines with fields in name order and lines in text order."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")
    df.select(line).orderBy("value").write.option("compression", "gzip").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header, emptyValue="")


def stage_table(spark: SparkSession, root: str, binding: str, build) -> DataFrame:
    """The table of this binding hash: read if it was completed before, else built and written once."""
    path = f"{root.rstrip('/')}/binding_sha={binding}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
