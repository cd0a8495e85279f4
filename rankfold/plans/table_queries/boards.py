"""Board payload scans; each row of a given table becomes one landed payload."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.config import SearchConfig
from rankfold.functions.json import json_value, with_json
from rankfold.plans.table_queries.common import spread_table, table
from rankfold.sources import boards

CONFIG = SearchConfig(
    seniority_words=("old",), other_role_words=("red",), wanted_role_words=("gear", "bolt", "rod"),
)
_PASSES = """NOT contains(p_name, 'old') AND NOT contains(p_name, 'red')
    AND (contains(p_name, 'gear') OR contains(p_name, 'bolt') OR contains(p_name, 'rod'))"""


def _key(column: str):
    return F.col(column).cast("string")


def _payload(column):
    return F.to_json(column)


def board_a_payloads(spark, sf):
    """Two jobs per payload: one complete with escaped HTML, one with most fields absent."""
    full = F.struct(
        F.col("p_name").alias("title"),
        F.concat(F.lit("&lt;p&gt;size &amp;amp; type&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;&lt;b&gt;"),
                 _key("p_size"), F.lit("&lt;/b&gt;&lt;nav&gt;menu&lt;/nav&gt;")).alias("content"),
        F.col("p_brand").alias("company_name"), F.struct(F.col("p_type").alias("name")).alias("location"),
        F.concat(F.lit("https://a.example/"), _key("p_partkey")).alias("absolute_url"),
        F.lit("2024-01-31T00:00:00Z").alias("updated_at"),
    )
    bare = full.withField("content", F.lit(None).cast("string")).withField(
        "company_name", F.lit(None).cast("string")).withField("absolute_url", F.lit(None).cast("string"))
    bare = bare.withField("location", F.lit(None).cast("struct<name:string>"))
    return spread_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
        F.concat(F.lit("slug"), _key("p_partkey")).alias("slug"), F.col("p_partkey").alias("board_rank"),
        _payload(F.struct(F.array(full, bare).alias("jobs"))).alias("payload"),
    )

def board_a_scan(spark, sf):
    return boards.board_a_postings(board_a_payloads(spark, sf), 10, CONFIG)


def board_b_payloads(spark, sf):
    """Bare arrays for some rows, ``data`` objects for the others; plain or HTML text."""
    job = F.struct(
        F.col("p_name").alias("text"),
        F.struct(F.col("p_type").alias("location")).alias("categories"),
        F.when(F.col("p_size") > 25, F.lit(1704067207179)).otherwise(F.lit(0)).cast("bigint").alias("createdAt"),
        F.when(F.col("p_type") == "PROMO", F.lit("")).otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("descriptionPlain"),
        F.concat(F.lit("<div>html</div><div>"), "p_name", F.lit("</div>")).alias("description"),
        F.concat(F.lit("https://b.example/"), _key("p_partkey")).alias("hostedUrl"),
    )
    bare = _payload(F.array(job))
    wrapped = _payload(F.struct(F.array(job).alias("data")))
    return spread_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
        F.concat(F.lit("point-click"), _key("p_partkey")).alias("slug"), F.col("p_partkey").alias("board_rank"),
        F.when(F.col("p_size") > 10, bare).otherwise(wrapped).alias("payload"),
    )

def board_b_scan(spark, sf):
    return boards.board_b_postings(board_b_payloads(spark, sf), 11, CONFIG)


def board_c_inputs(spark, sf):
    """Two captured payloads per tenant; hosts from line items of the same number."""
    job = F.struct(
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 5, F.concat(F.lit("role/"), _key("p_partkey"))).alias("externalPath"),
        F.col("p_type").alias("locationsText"),
    )
    part = spread_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
        F.concat(F.lit("tenant"), _key("p_partkey")).alias("tenant"), F.lit("external").alias("board"),
        F.col("p_partkey").alias("board_rank"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"),
        _payload(F.struct(F.array(job, job).alias("jobPostings"))).alias("payload"),
    )
    hosts = table(spark, sf, "lineitem").select(
        F.concat(F.lit("tenant"), _key("l_partkey")).alias("tenant"), F.col("l_linenumber").alias("n"),
        (F.col("l_returnflag") == "R").alias("ok"),
    )
    return part, hosts


def board_c_scan(spark, sf):
    found = boards.board_c_postings(*board_c_inputs(spark, sf), 12, CONFIG)
    return found.select("company", "role", "location", "url", "board_rank", "item_pos", "posted", "description")


def json_field_extract(spark, sf):
    events = with_json(table(spark, sf, "events").select("event_id", "props"), F.col("props"))
    return events.select(
        "event_id", F.coalesce(json_value(F.col("_json"), ".k", "int"), F.lit(0)).alias("k"),
        F.coalesce(json_value(F.col("_json"), ".absent", "string"), F.lit("none")).alias("absent"),
    )


def json_bad_payload(spark, sf):
    """Error pages, broken JSON and wrong shapes vanish; both good shapes stay."""
    kind = F.col("event_type")
    payload = (
        F.when(kind == "error", F.concat(F.lit("<html>"), "props"))
        .when(kind == "signup", F.replace(F.col("props"), F.lit("}"), F.lit("")))
        .when(kind == "view", F.concat(F.lit('{"data": ['), "props", F.lit("]}")))
        .when(kind == "click", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
        .otherwise(F.col("props"))
    )
    payloads = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    items = boards.list_items(payloads, "ARRAY<STRUCT<k: INT>>")
    return items.select("event_id", F.col("item_pos").alias("pos"), F.col("job.k").alias("k"))


QUERIES = {
    "board_a_scan": board_a_scan,
    "board_b_scan": board_b_scan,
    "board_c_scan": board_c_scan,
    "json_field_extract": json_field_extract,
    "json_bad_payload": json_bad_payload,
}

ORACLES = {
    "board_a_scan": f"""
        SELECT CASE pos WHEN 0 THEN p_brand ELSE 'slug' || p_partkey END AS company, p_name AS role,
               CASE pos WHEN 0 THEN p_type ELSE '' END AS location,
               CASE pos WHEN 0 THEN 'https://a.example/' || p_partkey ELSE '' END AS url,
               '2024-01-31T00:00:00Z' AS posted,
               CASE pos WHEN 0 THEN 'size & type' || chr(10) || p_size ELSE '' END AS description,
               'greenhouse' AS source, 10 AS source_rank, p_partkey AS board_rank,
               CAST(pos AS BIGINT) AS item_pos
        FROM part, (VALUES (0), (1)) AS v(pos) WHERE {_PASSES}""",
    "board_b_scan": f"""
        SELECT 'Point-Click' || p_partkey AS company, p_name AS role, p_type AS location,
               'https://b.example/' || p_partkey AS url,
               CASE WHEN p_size > 25 THEN '2024-01-01T00:00:07.179000+00:00' ELSE '' END AS posted,
               CASE WHEN p_type = 'PROMO' THEN 'html' || chr(10) || p_name ELSE p_brand || ' ' || p_type END AS description,
               'lever' AS source, 11 AS source_rank, p_partkey AS board_rank, CAST(0 AS BIGINT) AS item_pos
        FROM part WHERE {_PASSES}""",
    "board_c_scan": f"""
        WITH hosts AS (SELECT l_partkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 5 GROUP BY l_partkey)
        SELECT 'Tenant' || p_partkey AS company, p_name AS role, p_type AS location,
               CASE WHEN p_size > 5 THEN 'https://tenant' || p_partkey || '.wd' || n
                    || '.myworkdayjobs.com/external/job/role/' || p_partkey ELSE '' END AS url,
               p_partkey AS board_rank, CAST(item_pos AS BIGINT) AS item_pos,
               '' AS posted, '' AS description
        FROM part JOIN hosts ON l_partkey = p_partkey,
             (VALUES (0), (1), (4294967296), (4294967297)) AS v(item_pos) WHERE {_PASSES}""",
    "json_field_extract": """
        SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, 'none' AS absent
        FROM events""",
    "json_bad_payload": """
        SELECT event_id, pos, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events, (VALUES (0), (1)) AS v(pos)
        WHERE event_type = 'click' OR (event_type = 'view' AND pos = 0)""",
}
