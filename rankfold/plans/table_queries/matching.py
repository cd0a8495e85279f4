"""Membership, keyword-table and residual joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import matching as mt
from rankfold.operators.registry import category_report as report
from rankfold.plans.table_queries.common import quoted, spread_table, table
from rankfold.schema import each_item

SEGMENTS = ("building", "household", "furniture")


def membership_flag(spark, sf):
    """Customer segments against a short list, nations against a table."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    members = nation.join(region.filter("r_name IN ('ASIA', 'EUROPE')"), nation.n_regionkey == region.r_regionkey)
    customers = table(spark, sf, "customer").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    flagged = mt.flag_members(customers, "n_name", members.select(F.col("n_name").alias("member")), "member", "in_region")
    return flagged.select("c_custkey", mt.target_flag(F.col("c_mktsegment"), SEGMENTS).alias("is_target"), "in_region")


def keyword_semi_join(spark, sf):
    """Documents naming any word that part names are made of."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return mt.keyword_semi_join(spread_table(spark, sf, "documents", "doc_id", "text"), "text", words, "word").select("doc_id")


def keyword_table_join(spark, sf):
    """Parts whose name holds any word of the documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    words = each_item(spread_table(spark, sf, "documents", "text"), [], found, "pos", "word").select("word")
    parts = spread_table(spark, sf, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return mt.keyword_semi_join(parts, "label", words, "word").select("p_partkey", "label")


def _companies(spark, sf):
    """Suppliers, and customers behind them."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("company"), F.col("s_suppkey").alias("company_pos"))
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("company"), (F.col("c_custkey") + 10**9).alias("company_pos"))
    return suppliers.unionByName(customers)


def _categories(spark, sf):
    """Suppliers of all lines, by return flag."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        flag.alias("category"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("category_rank"),
        F.format_string("Supplier#%09d", "l_suppkey").alias("company"),
    )


def category_report(spark, sf):
    return report(_companies(spark, sf), _categories(spark, sf))


def anti_join_residual(spark, sf):
    listed = _categories(spark, sf).select(F.col("company").alias("listed"))
    return mt.residual(_companies(spark, sf), "company", listed, "listed").select("company", "company_pos")


QUERIES = {
    "membership_flag": membership_flag,
    "keyword_semi_join": keyword_semi_join,
    "keyword_table_join": keyword_table_join,
    "category_report": category_report,
    "anti_join_residual": anti_join_residual,
}

_LISTED = """
    SELECT DISTINCT l_returnflag AS category, s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

ORACLES = {
    "membership_flag": f"""
        SELECT c_custkey, lower(c_mktsegment) IN ({quoted(SEGMENTS)}) AS is_target,
               r_name IN ('ASIA', 'EUROPE') AS in_region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "keyword_semi_join": """
        WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
        SELECT doc_id FROM documents
        WHERE EXISTS (SELECT 1 FROM words WHERE word <> '' AND contains(lower(text), word))""",
    "keyword_table_join": """
        WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents),
        labels_ AS (SELECT DISTINCT p_name || ' ' || p_type AS label FROM part),
        hit AS (SELECT label FROM labels_ WHERE EXISTS (SELECT 1 FROM words WHERE contains(lower(label), word)))
        SELECT p_partkey, label FROM part JOIN hit ON label = p_name || ' ' || p_type""",
    "category_report": f"""
        SELECT category, CASE category WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS category_rank,
               s_suppkey AS company_pos, s_name AS company FROM ({_LISTED})""",
    "anti_join_residual": f"""
        SELECT s_name AS company, s_suppkey AS company_pos FROM supplier
        WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_LISTED}))
        UNION ALL SELECT c_name, c_custkey + 1000000000 FROM customer""",
}
