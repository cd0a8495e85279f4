"""Readers for landed inputs.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold import schema as sc

LANDED_SCHEMAS = {
    "sources": sc.SOURCES_SCHEMA,
    "raw_docs": sc.RAW_DOCS_SCHEMA,
    "board_a": sc.PAYLOADS_SCHEMA,
    "board_b": sc.PAYLOADS_SCHEMA,
    "board_c": sc.CAPTURED_SCHEMA,
    "host_probes": sc.HOST_PROBES_SCHEMA,
    "pages": sc.PAGES_SCHEMA,
    "candidates": sc.CANDIDATES_SCHEMA,
    "probes": sc.PROBES_SCHEMA,
    "registry": sc.REGISTRY_SCHEMA,
    "categories": sc.CATEGORIES_SCHEMA,
    "company_rules": sc.COMPANY_RULES_SCHEMA,
    "company_attrs": sc.COMPANY_ATTRS_SCHEMA,
}


def read_landed(spark: SparkSession, table: str, path: str, file_format: str = "parquet") -> DataFrame:
    """A landed table by its name; Parquet, ORC or JSON lines."""
    return spark.read.format(file_format).schema(LANDED_SCHEMAS[table]).load(path)


def read_list_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``raw_docs``: folder = source, file order in it = doc_no.

    Layout ``<path>/source=<name>/doc_no=<n>/<file>``; partition columns let a
    run read a single source without listing the others' contents.
    """
    texts = spark.read.text(path, wholetext=True)
    return texts.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_no").cast("bigint").alias("doc_no"),
        F.col("value").alias("content"),
    )


def read_list_files(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """List documents of the same layout with what is wrong with them: source, doc_no, content, problem.

    Files that are not UTF-8 are read as Latin-1; empty ones are not listed.  Larger files than ``most_bytes`` are
    never opened: they have null content, and ``problem`` says so.
    """
    files = spark.read.format("binaryFile").load(path)
    own = [F.col("source").cast("string").alias("source"), F.col("doc_no").cast("bigint").alias("doc_no")]
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    read = files.filter(F.col("length") <= most_bytes).select(
        *own, F.when(valid, text).otherwise(F.decode("content", "ISO-8859-1")).alias("content"),
        F.when(~valid, "not UTF-8").alias("problem"))
    left_out = files.filter(F.col("length") > most_bytes).select(
        *own, F.lit(None).cast("string").alias("content"), F.format_string("%d bytes", "length").alias("problem"))
    return read.unionByName(left_out)


def default_sources(spark: SparkSession) -> DataFrame:
    """The configured list sources, in order of precedence."""
    rows = [(name, "list", fmt, "", "", rank) for rank, (name, fmt) in enumerate(fv.LIST_SOURCES)]
    return sc.local_table(spark, rows, sc.SOURCES_SCHEMA)


def default_registry(spark: SparkSession) -> DataFrame:
    """The registered boards, in order."""
    rows = [(*board, position) for position, board in enumerate(fv.REGISTERED_BOARDS)]
    return sc.local_table(spark, rows, sc.REGISTRY_SCHEMA)


def empty_landed(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], LANDED_SCHEMAS[table])
