"""Sinks for results and the registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions.dates import run_stamp

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',          # a quote inside a field is doubled
    "emptyValue": "",
    "nullValue": "",
    "encoding": "UTF-8",
    # blanks around a value belong to it
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def output_rows(ranked: DataFrame) -> DataFrame:
    """The published columns in their order; absent or null values become empty."""
    present = set(ranked.columns)
    columns: list[Column] = []
    for name in fv.OUTPUT_COLUMNS:
        if name == "score":
            columns.append(F.col(name).cast("int").alias(name))
        else:
            value = F.coalesce(F.col(name), F.lit("")) if name in present else F.lit("")
            columns.append(value.alias(name))
    return ranked.select(*columns)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header.  Part files follow the order of ``df``."""
    df.write.options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Reads what ``write_csv`` wrote; empty fields come back as ''."""
    options = {**CSV_OPTIONS, "multiLine": "true"}
    df = spark.read.schema(schema).options(**options).csv(path)
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in strings})


def write_results(ranked: DataFrame, folder: str, as_of: datetime, file_format: str = "csv") -> str:
    """Writes ``jobs_<run stamp>`` below ``folder``: csv or parquet."""
    path = f"{folder.rstrip('/')}/jobs_{run_stamp(as_of)}.{file_format}"
    rows = output_rows(ranked)
    if file_format == "csv":
        return write_csv(rows, path)
    rows.write.parquet(path)
    return path


def write_registry(registry: DataFrame, path: str) -> str:
    """A full snapshot of the registry, in position order."""
    registry.orderBy("ats", "position").write.mode("overwrite").parquet(path)
    return path
