"""Counts and the score histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.schema import local_table

LABEL_WIDTH, COUNT_WIDTH = 22, 3


def stage_counts(df: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """Rows per value of ``by``, and rows meeting each named condition."""
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *counts)


def total_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.agg(F.count("*").alias("n_rows"), *counts)


def bucket_number(score: Column, buckets: Sequence[tuple] = fv.SCORE_BUCKETS) -> Column:
    """Number of a score's bucket: 0 exactly, else the first upper end not exceeded."""
    first, *others = buckets
    chain = F.when(score == first[2], first[0])
    for number, _, upper in others:
        chain = chain.otherwise(F.lit(number)) if upper is None else chain.when(score <= upper, number)
    return chain


def score_histogram(df: DataFrame, score: str = "score", buckets: Sequence[tuple] = fv.SCORE_BUCKETS,
                    rows_per_block: int = 1) -> DataFrame:
    """bucket, label, cnt, line for every bucket, also empty ones.

    Scores are counted first (a handful of rows), then laid beside the fixed
    buckets.  A block of a bar stands for ``rows_per_block`` rows,
    begun ones included.
    """
    counts = df.groupBy(bucket_number(F.col(score), buckets).alias("bucket")).agg(F.count("*").alias("cnt"))
    frame = local_table(df.sparkSession, [(n, label) for n, label, _ in buckets], "bucket INT, label STRING")
    joined = frame.join(F.broadcast(counts), "bucket", "left").select(   # at most one row per bucket
        "bucket", "label", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )
    length = F.ceil(F.col("cnt") / rows_per_block)
    # padding never cuts: a count wider than its column pushes the bar right
    number = F.col("cnt").cast("string")
    padded = F.lpad(number, F.greatest(F.char_length(number), F.lit(COUNT_WIDTH)), F.lit(" "))
    line = F.concat(
        F.rpad("label", LABEL_WIDTH, " "), F.lit(": "), padded, F.lit("  "),
        F.repeat(F.lit("█"), length.cast("int")),
    )
    return joined.withColumn("line", line)


def status_counts(registry: DataFrame) -> DataFrame:
    """Rows of each status per board kind."""
    return registry.groupBy("ats").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "fixed", "failed", "skipped")]
    )
