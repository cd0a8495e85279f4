"""Order-dependent operators: keep-first, priority cap, rank, first match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.schema import ORDER_COLUMNS
from rankfold.session import cut_lineage


def keep_first(df: DataFrame, key: str = "url", order: Sequence[str] = ORDER_COLUMNS,
               empty: str = "collapse") -> DataFrame:
    """One row per key: the first in source order.

    ``row_number() = 1`` gets a map-side group limit, so every task sends at
    most one row per key to the shuffle and a hot key (all rows without a link
    share '') stays cheap.  ``empty='keep_all'`` leaves rows with an empty or null key.
    """
    if empty == "keep_all":
        blank = F.coalesce(F.col(key), F.lit("")) == ""
        return keep_first(df.filter(~blank), key, order).unionByName(df.filter(blank))
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


#: Keys that one task may sort for a cap; larger caps are found by range.
SORTED_AT_ONCE = 100_000


def cap_by_priority(df: DataFrame, first: Column, limit: int | None,
                    order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """Rows with ``first`` true lead, otherwise in order; keep ``limit`` of them.

    Adds ``priority`` (0 leads).  Only the key columns go through the top-k; the
    chosen keys then pick the full rows, by whatever join their number allows.
    So no task ever gathers ``limit`` wide rows from every other.  The keys of a
    ``limit`` beyond ``SORTED_AT_ONCE`` are ranked by ranges and filtered: no task
    sees more of them than a partition.
    """
    ranked = df.withColumn("priority", F.when(first, 0).otherwise(1))
    if limit is None:
        return ranked
    keys = ranked.select("priority", *order)
    if limit <= SORTED_AT_ONCE:
        keys = keys.orderBy("priority", *order).limit(limit)
    else:
        keys = rank_rows(keys, ["priority", *order], name="_rank").filter(F.col("_rank") <= limit)
    keys = keys.select(*order)
    return ranked.join(keys, list(order), "left_semi")


def rank_rows(df: DataFrame, by: Sequence[Column | str], limit: int | None = None, name: str = "rank") -> DataFrame:
    """The rows with their rank as a column; only the top ``limit`` if given.

    The rows are range-sorted and saved with their place in their partition;
    the counts of the partitions, one row each, give every partition its offset.
    No task sees more than a partition.
    """
    ordered = df.orderBy(*by)
    if limit is not None:
        return ordered.limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*by)))
    # the id holds the partition in its high bits and the place in it in the low 33 bits
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")   # one row per partition
    return ranked.withColumn(name, (F.col("_before") + place + 1).cast("int")).select(*df.columns, name)


def lowest_ok_host(host_probes: DataFrame, hosts: tuple[int, int] = (1, 5)) -> DataFrame:
    """Per tenant the lowest host number that resolved, of the numbers first to last of ``hosts``.

    Tenants without one vanish.
    """
    return host_probes.filter(F.col("ok") & F.col("n").between(*hosts)).groupBy("tenant").agg(F.min("n").alias("host_no"))


def first_success(tries: DataFrame, keys: Sequence[str], position: str, success: Column,
                  values: Sequence[str]) -> DataFrame:
    """Per key the successful try with the lowest position, its values null if none.

    One aggregation with map-side combine, whatever the number of tries.
    """
    best = F.min(F.when(success, F.struct(position, *values)))
    return (
        tries.groupBy(*keys).agg(best.alias("_best"))
        .select(*keys, F.col(f"_best.{position}").alias(position),
                *[F.col(f"_best.{v}").alias(v) for v in values])
    )
