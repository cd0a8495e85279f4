"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share all words of the corpus; a target stops at ``MOST`` times its source's
words, and the excess is shared again by weight (closed form: sources by rising
cap per weight, the first one that stays below its cap sets the level).

Curriculum: each source has a weight schedule over training time 0..1, given by
knots.  Its integral is the source's cumulative demand; a document that stands
at some part of its source's taken words gets the time at which the demand
reaches that part.  Documents are range-sorted by their first position.

Words of a source are counted off in the order of the ids' MD5.  Prefix sums run
in two levels, (source, bucket of the MD5) and then within the bucket, so a
source with a third of all rows is spread over all tasks.  Everything is
DataFrame functions.

Defined results: null or empty text has size 0 and takes 0 words; null ids share
one place in the order; repeated rows count as rows; a source without words has
target 0; an empty table gives an empty table.  ``keep`` names the columns that
pass through; clashing names are taken over by the results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A source, and a document, is taken so many times at most.
MOST = 3
#: A document with over this part (1/LARGE) of its source's words is decided before the others.
LARGE = 256
#: Weight schedules by class of weight: knots (time, rate), linear in between.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: place (from 0), weight class, words, target."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("place", place).withColumn("class", F.col("place") % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1)
    sizes = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    sizes = sizes.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    filled = (sizes.withColumn("total", F.sum("source_size").over(everything).cast("double"))
              .withColumn("index", F.row_number().over(order))
              .withColumn("left", F.col("total") - F.coalesce(before, F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))))
    below = F.col("left") * F.col("weight") < F.col("cap") * F.col("open")
    level = F.min(F.when(below, F.struct("index", "left", "open"))).over(everything)
    filled = filled.withColumn("level", level)
    shared = F.col("level.left") * F.col("weight") / F.col("level.open")
    capped = F.col("level").isNull() | (F.col("index") < F.col("level.index"))
    return filled.select("source", "place", "class", "source_size", F.when(capped, F.col("cap")).otherwise(shared).alias("target"))


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, length, rate at start, slope, integral before) of a schedule scaled to integral 1."""
    area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
    found, done = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        found.append((t0, t1 - t0, r0 / area, (r1 - r0) / area / (t1 - t0), done))
        done += (t1 - t0) * (r0 + r1) / 2 / area
    return found


def time_of(part: Column, schedule_class: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The time at which a class's cumulative demand reaches ``part`` of its whole."""
    names = ("start", "length", "rate", "slope", "before")
    table = F.array(*[
        F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in segments(knots)])
        for knots in schedules
    ])

    def of(segment: Column) -> Column:
        rest = F.greatest(part - segment["before"], F.lit(0.0))
        root = F.sqrt(F.greatest(segment["rate"] * segment["rate"] + 2.0 * segment["slope"] * rest, F.lit(0.0)))
        spent = segment["rate"] + root
        return segment["start"] + F.least(F.when(spent > 0, 2.0 * rest / spent).otherwise(F.lit(0.0)), segment["length"])

    own = F.element_at(table, schedule_class + 1)
    return F.element_at(F.transform(F.filter(own, lambda s: s["before"] <= part), of), -1)


#: Columns that a mix adds.
RESULTS = ("size", "source_size", "target", "copies", "taken", "positions")


def mix(df: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id", text: str = "text",
        source: str = "source", schedules: Sequence = SCHEDULES, saved: bool = True, ordered: bool = True) -> DataFrame:
    """``keep`` and size, source_size, target, copies, taken, positions (one per copy), in order of first position.

    Columns of ``keep`` that are named like a result are replaced by it.

    ``saved`` writes the counted rows once; without it the words are counted once
    per pass, which spares the disk where ``keep`` holds the texts.  Without
    ``ordered`` the rows come unsorted, for ``training_order``, which sorts copies.

    Every document of a source is taken the whole number of times that the target
    allows; the rest of the target is filled by documents that get one copy more.
    The few that hold over 1/``LARGE`` of the source's words are decided first, the
    largest first, and the others, in the order of their keys, make up for what is
    due then, so the words taken come near the target.
    """
    kept = [F.col(c) for c in keep if c.lower() not in RESULTS]
    sized = df.select(
        F.struct(*kept).alias("kept"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), order_key(F.col(doc_id)).alias("key"),
    )
    sized = cut_lineage(sized) if saved else sized
    targets = source_targets(sized).withColumnRenamed("source", "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("large", F.col("size") * LARGE > F.col("source_size"))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("item", F.concat_ws("-", "key", "size"))

    def decide(done: Column, item: Column) -> Column:
        due = done["due"] + item["size"] * item["part"]
        more = (item["part"] > 0) & (due >= item["size"] / 2.0)
        return F.struct(F.when(more, due - item["size"]).otherwise(due).alias("due"),
                        F.when(more, F.array_append(done["chosen"], item["item"])).otherwise(done["chosen"]).alias("chosen"),
                        F.when(more, done["taken"] + item["size"]).otherwise(done["taken"]).alias("taken"))

    divisible = (F.col("source_size") > 0) & (F.col("whole") < MOST)   # a source without words takes nothing
    part = F.when(divisible, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0))
    large = rows.filter("large").groupBy("place", "key", "item").agg(
        F.sum("size").cast("double").alias("size"), F.first(part).alias("part"))
    # fewer than LARGE items of a source: largest first, each taken if that brings the words taken nearer to the line
    large = large.groupBy("place").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("size")).alias("order"), "item", "size", "part"))).alias("items"))
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<string>").alias("chosen"), F.lit(0.0).alias("taken"))
    large = large.select("place", F.aggregate("items", start, decide).alias("d")).select(
        "place", F.col("d.due").alias("due"), F.col("d.chosen").alias("chosen"))
    due = large.select("place", "due")
    key_bucket = F.conv(F.substring("item", 1, 3), 16, 10).cast("int")
    chosen = large.select("place", F.explode("chosen").alias("item"))
    chosen = chosen.groupBy("place", key_bucket.alias("bucket")).agg(F.collect_set("item").alias("chosen"))

    buckets = rows.groupBy("place", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.when(F.col("large"), F.col("size")).otherwise(0)).alias("of_large"))
    along = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("place")
    buckets = buckets.select(
        "place", "bucket", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("b_all"),
        F.coalesce(F.sum("of_large").over(along), F.lit(0)).alias("b_large"),
        F.sum(F.col("words") - F.col("of_large")).over(everything).alias("small_words"))
    buckets = buckets.join(due, "place", "left").join(chosen, ["place", "bucket"], "left")
    within = (Window.partitionBy("place", "bucket").orderBy("key", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    own_large = F.when(F.col("large"), F.col("size")).otherwise(0)
    rows = rows.join(buckets, ["place", "bucket"])
    rows = rows.withColumn("ahead", F.col("b_all") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    stands = F.col("ahead") - F.col("b_large") - F.coalesce(F.sum(own_large).over(within), F.lit(0))
    line = F.col("small_words") * part + F.coalesce(F.col("due"), F.lit(0.0))
    more = F.when(F.col("large"), F.array_contains("chosen", F.col("item"))).otherwise(
        (F.col("whole") < MOST) & ((2 * stands + F.col("size")).cast("double") < 2.0 * line))
    rows = rows.withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("int"))

    def position(copy: Column) -> Column:
        scale = F.when(copy < F.col("whole"), F.lit(1.0)).otherwise(F.col("rest") / F.col("source_size"))
        done = (copy * F.col("source_size")).cast("double") + (F.col("ahead").cast("double") + F.col("size") / 2.0) * scale
        return time_of(F.least(done / F.col("target"), F.lit(1.0)), F.col("class"), schedules)

    none = F.array().cast("array<double>")
    placed = (F.col("copies") > 0) & (F.col("target") > 0)
    positions = F.when(placed, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(none)
    rows = rows.select("kept.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                       positions.alias("positions"), F.col("key").alias("_key"))
    if ordered:
        rows = rows.orderBy(F.get(F.col("positions"), F.lit(0)).asc_nulls_last(), "_key")
    return rows.drop("_key")


def training_order(mixed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per taken copy, range-sorted by its position."""
    copies = mixed.select(*keep, F.explode("positions").alias("position"))
    return copies.orderBy("position")


def sql(table: str = "documents") -> str:
    """The same mix as SQL over ``table``, for checking."""
    weight = f"list_extract([{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}], class + 1)"
    made = ", ".join(
        "[" + ", ".join(f"{{'start': {a!r}::DOUBLE, 'length': {b!r}::DOUBLE, 'rate': {c!r}::DOUBLE, 'slope': {d!r}::DOUBLE, "
                        f"'before': {e!r}::DOUBLE}}" for a, b, c, d, e in segments(knots)) + "]" for knots in SCHEDULES)
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM {table}),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
       FROM sized GROUP BY source),
s2 AS (SELECT *, place % {len(WEIGHTS)} AS class FROM s1),
s3 AS (SELECT *, {weight} AS weight, {float(MOST)}::DOUBLE * source_size AS cap FROM s2),
s4 AS (SELECT *, sum(source_size) OVER ()::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         row_number() OVER (ORDER BY cap / weight, place) AS idx FROM s3),
lv AS (SELECT idx AS first_open, left_ AS l, open AS o FROM s4 WHERE left_ * weight < cap * open ORDER BY idx LIMIT 1),
targets AS (SELECT source, place, class, source_size,
    CASE WHEN first_open IS NULL OR idx < first_open THEN cap ELSE l * weight / o END AS target FROM s4 LEFT JOIN lv ON true),
r AS (SELECT z.doc_id, z.size, z.key, t.*, z.size * {LARGE} > t.source_size AS large,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS whole
      FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 AND whole < {MOST} THEN (target - whole * source_size) / source_size
        ELSE 0.0::DOUBLE END AS part_ FROM r),
items AS (SELECT place, key || '-' || size AS item, sum(size)::DOUBLE AS s, any_value(part_) AS p,
        row_number() OVER (PARTITION BY place ORDER BY -sum(size), key || '-' || size) AS n
      FROM w WHERE large GROUP BY place, key || '-' || size),
walk AS (
  WITH RECURSIVE step(place, n, due, more) AS (
    SELECT DISTINCT place, 0::BIGINT, 0.0::DOUBLE, false FROM items
    UNION ALL
    SELECT i.place, i.n, CASE WHEN i.p > 0 AND step.due + i.s * i.p >= i.s / 2.0::DOUBLE THEN step.due + i.s * i.p - i.s
           ELSE step.due + i.s * i.p END, i.p > 0 AND step.due + i.s * i.p >= i.s / 2.0::DOUBLE
    FROM step JOIN items i ON i.place = step.place AND i.n = step.n + 1)
  SELECT * FROM step),
due AS (SELECT place, arg_max(due, n) AS due FROM walk GROUP BY place),
chosen AS (SELECT i.place, i.item FROM items i JOIN walk ON walk.place = i.place AND walk.n = i.n WHERE walk.more),
u AS (SELECT w.*, chosen.item IS NOT NULL AS large_more, coalesce(due.due, 0.0::DOUBLE) AS due,
        coalesce(sum(w.size) FILTER (NOT large) OVER (PARTITION BY w.place), 0) AS small_words,
        coalesce(sum(w.size) OVER (PARTITION BY w.place ORDER BY key, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
        coalesce(sum(w.size) OVER (PARTITION BY w.place, large ORDER BY key, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stands
      FROM w LEFT JOIN due ON due.place = w.place
        LEFT JOIN chosen ON chosen.place = w.place AND w.large AND chosen.item = w.key || '-' || w.size),
c AS (SELECT *, whole + coalesce(CASE WHEN large THEN large_more
        ELSE whole < {MOST} AND (2 * stands + size)::DOUBLE < 2.0::DOUBLE * (small_words * part_ + due) END, false)::INT AS copies FROM u),
f AS (SELECT *, list_extract([{made}], class + 1) AS own, least((ahead::DOUBLE + size / 2.0::DOUBLE)
        * CASE WHEN whole > 0 THEN 1.0::DOUBLE ELSE rest / source_size END / target, 1.0::DOUBLE) AS part FROM c),
g AS (SELECT *, list_extract(list_filter(own, lambda s: s.before <= part), -1) AS seg FROM f),
h AS (SELECT *, greatest(part - seg.before, 0.0::DOUBLE) AS rest_part FROM g),
i AS (SELECT *, seg.rate + sqrt(greatest(seg.rate * seg.rate + 2.0::DOUBLE * seg.slope * rest_part, 0.0::DOUBLE)) AS spent FROM h)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 AND target > 0 THEN
    round(seg.start + least(CASE WHEN spent > 0 THEN 2.0::DOUBLE * rest_part / spent ELSE 0.0::DOUBLE END, seg.length), 6) END AS first_position
FROM i"""
