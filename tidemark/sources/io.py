"""Scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_csv(spark: SparkSession, paths: list[str], schema: str | None = None, encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV files with headers, columns reconciled by name; `file` names the source. Without a schema every column is text."""
    reader = spark.read.option("header", True).option("encoding", encoding).options(**options)
    if schema:
        return reader.schema(schema).csv(sorted(paths)).withColumn("file", F.col("_metadata.file_path"))
    by_header: dict[tuple, list[str]] = {}
    for p in sorted(paths):
        by_header.setdefault(tuple(reader.csv(p).columns), []).append(p)
    out = None
    for files in by_header.values():
        df = reader.csv(files).withColumn("file", F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_layer(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One stage's table, replaced whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_ledger(df: DataFrame, path: str, tag: str = "replication") -> None:
    """Replaces the rows of the tags in df and keeps those of other tags."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tag).parquet(path)


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, rows, columns, size, status) of the expected tables; size in bytes of their files.

    Only a path that does not exist is MISSING; other faults, such as one of permission or format, are raised.
    """
    out = []
    for name, path in sorted(paths.items()):
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out.append((name, None, None, None, "MISSING"))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        size = files.agg(F.sum("length")).first()[0]
        out.append((name, df.count(), len(df.columns), size, "OK"))
    return spark.createDataFrame(out, "name string, rows long, columns int, size long, status string")
