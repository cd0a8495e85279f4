"""Exclusion of stale and off-stack rows, and the output gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.config import SearchConfig
from rankfold.functions.dates import is_stale
from rankfold.functions.text import has_signal
from rankfold.schema import compute_once


def exclusion(stale: Column, description: Column, signal: Column) -> Column:
    """(flag, reason) struct of an excluded row, else null.  Stale wins.

    An empty description is never off-stack.
    """
    def record(flag: str, reason: str) -> Column:
        return F.struct(F.lit(flag).alias("flag"), F.lit(reason).alias("reason"))

    return F.when(stale, record(fv.STALE_FLAG, fv.STALE_REASON)).when(
        (description != "") & ~signal, record(fv.OFF_STACK_FLAG, fv.OFF_STACK_REASON)
    )


def with_exclusion(df: DataFrame, as_of: datetime, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Adds ``exclusion``; to be used after descriptions are filled."""
    return compute_once(df, exclusion=exclusion(
        is_stale(F.col("posted"), as_of, config.stale_days),
        F.col("description"),
        has_signal(F.col("role"), F.col("description"), config.signal_words),
    ))


def excluded_rows(df: DataFrame) -> DataFrame:
    """Excluded rows with their fixed score record."""
    return df.filter("exclusion IS NOT NULL").select(
        *[c for c in df.columns if c != "exclusion"],
        F.lit(0).alias("score"), F.lit("EXCLUDED").alias("verdict"),
        F.col("exclusion.flag").alias("flag"), F.col("exclusion.reason").alias("reason"),
    )


def passes_gate(score: Column, verdict: Column, min_score: int = fv.MIN_SCORE) -> Column:
    return (score >= min_score) & (verdict != "EXCLUDED")
