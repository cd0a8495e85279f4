"""Date operators over orders and events; ``as_of`` is fixed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rankfold.functions import dates as dt
from rankfold.operators.exclusions import exclusion
from rankfold.functions.text import has_signal
from rankfold.plans.table_queries.common import spread_table, table

TODAY = datetime(1998, 6, 15, 12)
AS_OF = datetime(2024, 1, 31)
SIGNAL = ("click", "purchase")


def _stamp(column: str):
    return F.replace(F.col(column).cast("string"), F.lit(" "), F.lit("T"))


def _orders(spark, sf):
    """Orders with a ``posted`` text whose format depends on status and priority."""
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    number = F.day("o_orderdate").cast("string")
    month = F.element_at(
        F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.month("o_orderdate")
    )
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    posted = (
        F.when((priority == "1") & (status == "F"), F.concat(number, F.lit("d")))
        .when((priority == "1") & (status == "O"), F.concat(number, F.lit("h ago")))
        .when(priority == "1", F.concat(number, F.lit("mo")))
        .when((priority == "2") & (status == "F"), F.concat(month, F.lit(" "), number))
        .when((priority == "2") & (status == "O"), F.concat(F.lit(" "), F.lower(month), F.lit(" "), number))
        .when(priority == "2", F.concat(number, F.lit(" "), month))
        .when((priority == "3") & (status == "F"), day)
        .when((priority == "3") & (status == "O"), F.replace(day, F.lit("-"), F.lit("")))
        .when(priority == "3", F.concat(day, F.lit("T23:30:00-04:00")))
        .when((priority == "4") & (status == "F"), F.lit("0d"))
        .when((priority == "4") & (status == "O"), F.lit("New"))
        .when(priority == "4", F.lit(""))
        .when(status == "F", F.substring(day, 1, 7))
        .when(status == "O", F.concat(day, F.lit("T25:00")))
        .otherwise(F.concat(day, F.lit(" 08:15:30.25Z")))
    )
    orders = spread_table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return orders.select("o_orderkey", posted.alias("posted"))


def posted_today(spark, sf):
    return _orders(spark, sf).select("o_orderkey", "posted", dt.posted_today(F.col("posted"), TODAY).alias("is_today"))


def today_filter(spark, sf):
    """Rows before and after the today filter."""
    today = dt.posted_today(F.col("posted"), TODAY)
    return _orders(spark, sf).agg(F.count("*").alias("n_before"), F.count_if(today).alias("n_after"))


def _events(spark, sf):
    kind = F.col("event_type")
    stamp = _stamp("ts")
    posted = (
        F.when(kind == "view", stamp).when(kind == "click", F.concat(stamp, F.lit("Z")))
        .when(kind == "purchase", F.concat(stamp, F.lit("+02:00")))
        .when(kind == "signup", F.concat(F.lit(" "), stamp)).otherwise(F.lit("45d"))
    )
    events = spread_table(spark, sf, "events", "event_id", "ts", "event_type", "props")
    return events.select("event_id", "event_type", "props", posted.alias("posted"))


def stale_filter(spark, sf):
    posted = F.col("posted")
    return _events(spark, sf).select(
        "event_id", dt.is_stale(posted, AS_OF, 29).alias("stale_29"), dt.is_stale(posted, AS_OF, 5).alias("stale_5"),
        dt.is_stale(posted, AS_OF).alias("stale_30"),
    )


def exclusion_reason(spark, sf):
    description = F.when(F.col("event_type") == "signup", "").otherwise(F.concat_ws(" ", "event_type", "props"))
    out = exclusion(
        dt.is_stale(F.col("posted"), AS_OF, 20), description, has_signal(F.lit(""), description, SIGNAL)
    )
    return _events(spark, sf).select("event_id", out.alias("x")).select(
        "event_id", F.coalesce("x.flag", F.lit("")).alias("flag"), F.coalesce("x.reason", F.lit("")).alias("reason")
    )


def epoch_ms_to_iso(spark, sf):
    micros = dt.stamp_micros(F.col("ts"))
    millis = F.when(F.col("event_type") == "error", 0).otherwise(F.floor(micros / 1000)).cast("bigint")
    return table(spark, sf, "events").select("event_id", dt.epoch_ms_to_iso(millis).alias("iso"))


QUERIES = {
    "posted_today": posted_today,
    "today_filter": today_filter,
    "stale_filter": stale_filter,
    "exclusion_reason": exclusion_reason,
    "epoch_ms_to_iso": epoch_ms_to_iso,
}

_POSTED = """
    SELECT o_orderkey, o_orderdate, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s,
           CASE substr(o_orderpriority, 1, 1) || o_orderstatus
             WHEN '1F' THEN day(o_orderdate) || 'd' WHEN '1O' THEN day(o_orderdate) || 'h ago'
             WHEN '1P' THEN day(o_orderdate) || 'mo'
             WHEN '2F' THEN strftime(o_orderdate, '%b ') || day(o_orderdate)
             WHEN '2O' THEN ' ' || lower(strftime(o_orderdate, '%b ')) || day(o_orderdate)
             WHEN '2P' THEN day(o_orderdate) || strftime(o_orderdate, ' %b')
             WHEN '3F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '3O' THEN strftime(o_orderdate, '%Y%m%d')
             WHEN '3P' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-04:00'
             WHEN '4F' THEN '0d' WHEN '4O' THEN 'New' WHEN '4P' THEN ''
             WHEN '5F' THEN strftime(o_orderdate, '%Y-%m') WHEN '5O' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T25:00'
             ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 08:15:30.25Z' END AS posted,
           CASE WHEN substr(o_orderpriority, 1, 1) || o_orderstatus IN ('1O', '4F', '4O') THEN TRUE
                WHEN substr(o_orderpriority, 1, 1) || o_orderstatus IN ('2F', '2O')
                  THEN month(o_orderdate) = 6 AND day(o_orderdate) = 15
                WHEN substr(o_orderpriority, 1, 1) || o_orderstatus IN ('3F', '3O', '3P', '5P')
                  THEN CAST(o_orderdate AS DATE) = DATE '1998-06-15'
                ELSE FALSE END AS is_today
    FROM orders"""

_AGE = """
    SELECT event_id, event_type, props, CASE event_type
             WHEN 'view' THEN date_diff('microsecond', ts, TIMESTAMP '2024-01-31')
             WHEN 'click' THEN date_diff('microsecond', ts, TIMESTAMP '2024-01-31')
             WHEN 'purchase' THEN date_diff('microsecond', ts - INTERVAL 2 HOUR, TIMESTAMP '2024-01-31')
             ELSE 0 END AS age FROM events"""
_DAY = 86_400_000_000

ORACLES = {
    "posted_today": f"SELECT o_orderkey, posted, is_today FROM ({_POSTED})",
    "today_filter": f"SELECT count(*) AS n_before, count(*) FILTER (WHERE is_today) AS n_after FROM ({_POSTED})",
    "stale_filter": f"""
        SELECT event_id, age >= 30 * {_DAY} AS stale_29, age >= 6 * {_DAY} AS stale_5,
               age >= 31 * {_DAY} AS stale_30 FROM ({_AGE})""",
    "exclusion_reason": f"""
        SELECT event_id,
               CASE WHEN age >= 21 * {_DAY} THEN 'stale_posting'
                    WHEN event_type IN ('view', 'error') THEN 'wrong_stack' ELSE '' END AS flag,
               CASE WHEN age >= 21 * {_DAY} THEN 'Posting is older than 30 days'
                    WHEN event_type IN ('view', 'error') THEN 'No C#/.NET stack found in job description'
                    ELSE '' END AS reason FROM ({_AGE})""",
    "epoch_ms_to_iso": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN ''
            WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '000+00:00'
            END AS iso FROM events""",
}
