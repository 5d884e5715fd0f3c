"""Fields from and to Spark's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriframe.plans.frame import Field


def read_field(spark: SparkSession, path: str, dims: list[str], value: str, format: str = "parquet", **options) -> Field:
    """Reads only the columns a field needs; parquet, orc, csv, json or any other Spark format."""
    df = spark.read.format(format).options(**options).load(path).select(*dims, value)
    return Field(df, tuple(dims), value)


def write_measures(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
