"""CSV tables in and out, with a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, under a declared schema; a row that doesn't fit is an error, not a null."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, escape='"', multiLine=True).csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as a folder of CSV files with headers; returns the manifest name, n_rows, columns, also written.

    Files are written by the tasks that hold the rows. Counts are of the files, read once more.
    """
    spark, written = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.options(header=True, escape='"', emptyValue='""').mode("overwrite").csv(f"{folder}/{name}")
        n = read_csv(spark, f"{folder}/{name}", ", ".join(f"`{c}` string" for c in df.columns)).count()
        written.append((name, n, ";".join(df.columns)))
    manifest = spark.createDataFrame(written, "name string, n_rows long, columns string")
    manifest.coalesce(1).write.option("header", True).mode("overwrite").csv(f"{folder}/manifest")
    return manifest
