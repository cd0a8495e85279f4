"""Sharding by sampled splitters: shards of nearly equal bytes.

Keys are sampled with a chance proportional to their row's size, quantiles of
the sample become range boundaries, rows are range-partitioned by key, and
ranges that turn out overfull are sampled again and subdivided.  The many small
ranges are then dealt to the shards, largest first to the emptiest shard, so a
shard is a set of whole key ranges and holds nearly the same number of bytes.

The key is a hash of the text followed by a hash of the id: copies of a text
stand side by side and mostly share a range, yet a text that fills whole shards
is still divided (by id).  Where rows equal in text and id, or without an id,
overfill a range, their key is taken from their place in the table instead of
the id (at most one such key per range, so their list is bounded).  Only the key, the size and a checksum of a row are
sorted; the driver sees the bounded sample and one total per range.

Defined results: null text has size 8 and a null checksum; null ids share
a place in the order; repeated rows each get a slot; a row larger than a shard's share
makes a range of its own; an empty table gives an empty table.  Extra columns
are left out: join by id, or use ``range_of`` on your own frame.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.schema import local_table
from rankfold.session import cut_lineage

#: Ranges per shard before subdivision, and sampled keys per range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 16
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0
#: Rounds of subdivision; each divides an overfull range about ``FINER`` times finer than needed.
ROUNDS, FINER = 6, 2
#: Low bits of the key that come from the id.
ID_BITS = 23


@dataclass(frozen=True)
class Splitters:
    """Sorted keys; range i holds keys from splitter i-1 (included) up to splitter i."""

    keys: tuple[int, ...] = ()

    def ranges(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.keys, dtype="int64"), key, side="right")


def shard_key(text: Column, doc_id: Column) -> Column:
    low = (1 << ID_BITS) - 1
    of_text = F.xxhash64(text).bitwiseAND(F.lit(~low))
    return of_text.bitwiseOR(F.xxhash64(doc_id.cast("string"), F.lit("id")).bitwiseAND(F.lit(low)))


def by_place(key: Column, row: Column) -> Column:
    """``key`` with the low bits from the row's number instead of the id."""
    low = (1 << ID_BITS) - 1
    return key.bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(row, F.lit("row")).bitwiseAND(F.lit(low)))


def range_of(key: Column, splitters: Splitters) -> Column:
    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(splitters.ranges(keys.to_numpy(dtype="int64"))).astype("int32")

    return find(key)


def _uniform(key: Column, row: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, row, F.lit(seed)), 11) / F.lit(float(1 << 53))


def weighted_sample(rows: DataFrame, rates: dict[int, float], splitters: Splitters, seed: int) -> list[tuple[int, float]]:
    """(key, bytes it stands for) of sampled rows; a row of range r is drawn with chance size * rates[r].

    A column row, if there is one, tells rows of one key apart.
    """
    limit = max(rates) + 1

    @F.pandas_udf("double")
    def rate(keys: pd.Series) -> pd.Series:
        by_range = np.zeros(limit)
        for r, value in rates.items():
            by_range[r] = value
        found = splitters.ranges(keys.to_numpy(dtype="int64"))
        return pd.Series(np.where(found < limit, by_range[np.minimum(found, limit - 1)], 0.0))

    row = F.col("row") if "row" in rows.columns else F.lit(0)
    drawn = rows.select("key", "size", row.alias("row"), rate("key").alias("rate"))
    drawn = drawn.filter(_uniform(F.col("key"), F.col("row"), seed) < F.col("size") * F.col("rate"))
    return sorted((r["key"], max(float(r["size"]), 1 / r["rate"])) for r in drawn.collect())


def quantiles(sample: list[tuple[int, float]], step: float) -> list[int]:
    """Keys at every ``step`` bytes of a weighted sample sorted by key."""
    found, filled = [], 0.0
    for key, weight in sample:
        if filled >= step:
            found.append(key)
            filled = 0.0
        filled += weight
    return sorted(set(found))


def range_totals(rows: DataFrame, splitters: Splitters) -> list:
    """Bytes, rows and first and last key of every range that has rows."""
    return (rows.groupBy(range_of(F.col("key"), splitters).alias("range"))
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("first"),
                 F.max("key").alias("last")).collect())


def find_splitters(rows: DataFrame, total: int, ranges: int) -> tuple[Splitters, list]:
    """Splitters of ``ranges`` ranges or more, none overfull that has two keys, and the totals of the ranges."""
    share = total / ranges
    first = weighted_sample(rows, {0: ranges * SAMPLES_PER_RANGE / total}, Splitters(), 0)
    splitters = Splitters(tuple(quantiles(first, share)))
    totals = range_totals(rows, splitters)
    for round_number in range(1, ROUNDS + 1):
        overfull = [t for t in totals if t["bytes"] > OVERFULL * share and t["first"] < t["last"]]
        if not overfull:
            break
        rates = {t["range"]: FINER * SAMPLES_PER_RANGE / share for t in overfull}
        finer = weighted_sample(rows, rates, splitters, round_number)
        # the last key begins a range of its own, so a range of two keys is always divided
        keys = {*splitters.keys, *quantiles(finer, share / FINER), *(t["last"] for t in overfull)}
        splitters = Splitters(tuple(sorted(keys)))
        totals = range_totals(rows, splitters)
    return splitters, totals


def deal(totals: list, shards: int) -> dict[int, int]:
    """Shard of each range: ranges by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    found = {}
    for t in sorted(totals, key=lambda t: (-t["bytes"], t["range"])):
        filled, s = heapq.heappop(heap)
        found[t["range"]] = s
        heapq.heappush(heap, (filled + t["bytes"], s))
    return found


def shard_documents(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard and slot (gapless from 0 in a shard) of every row."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    rows = cut_lineage(df.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        shard_key(F.col(text), F.col(doc_id)).alias("key"), F.monotonically_increasing_id().alias("row"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    splitters, totals = find_splitters(rows, total, ranges) if total else (Splitters(), [])
    crowded = [t["first"] for t in totals
               if t["first"] == t["last"] and t["rows"] > 1 and t["bytes"] > OVERFULL * total / ranges]
    if crowded:   # fewer than there are ranges
        apart = F.when(F.col("key").isin(crowded), by_place(F.col("key"), F.col("row"))).otherwise(F.col("key"))
        rows = rows.withColumn("key", apart)
        splitters, totals = find_splitters(rows, total, ranges)
    shard_of, filled, places = deal(totals, shards), dict.fromkeys(range(shards), 0), []
    for t in sorted(totals, key=lambda t: t["range"]):
        places.append((t["range"], shard_of[t["range"]], filled[shard_of[t["range"]]]))
        filled[shard_of[t["range"]]] += t["rows"]
    # one row per range: bounded by the number of ranges, whatever the number of documents
    dealt = F.broadcast(local_table(df.sparkSession, places, "range INT, shard INT, before BIGINT"))
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    placed = rows.withColumn("range", range_of(F.col("key"), splitters))
    placed = placed.withColumn("place", F.row_number().over(order) - 1).join(dealt, "range")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
