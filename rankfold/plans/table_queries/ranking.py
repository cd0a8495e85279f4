"""Order-dependent operators and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions.text import has_signal
from rankfold.operators import ranking as rk, reports
from rankfold.plans.table_queries.common import sql_contains_any, table
from rankfold.session import scratch_path
from rankfold.sources.sinks import read_csv, write_csv

WORDS = ("trash", "idiot", "worthless")
CAP = 200
BAR = 50


def dedup_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return rk.keep_first(docs, "digest", ["doc_id"]).select("doc_id", "source")


def dedup_hot_key(spark, sf):
    """Few keys with a large share of the rows each; rows without a key are kept."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 6000, "").otherwise(F.col("lang")).alias("url"))
    collapsed = rk.keep_first(docs, "url", ["doc_id"]).select("doc_id", "url", F.lit("collapse").alias("mode"))
    kept = rk.keep_first(docs, "url", ["doc_id"], empty="keep_all").select("doc_id", "url", F.lit("keep_all").alias("mode"))
    return collapsed.unionByName(kept)


def priority_sort_cap(spark, sf):
    docs = table(spark, sf, "documents")
    signal = has_signal(F.lit(""), F.col("text"), WORDS)
    capped = rk.cap_by_priority(docs, signal, CAP, ["doc_id"])
    return rk.rank_rows(capped.select("doc_id", "priority"), ["priority", "doc_id"], CAP)


def first_success_per_group(spark, sf):
    """Per order the first returned line: 'ok' on line 1, 'fixed' later, else 'failed'."""
    tries = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    best = rk.first_success(tries, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "R", ["l_partkey"])
    status = F.when(F.col("l_linenumber") == 1, "ok").when(F.col("l_linenumber") > 1, "fixed").otherwise("failed")
    return best.select("l_orderkey", status.alias("status"), "l_linenumber", "l_partkey")


def lowest_ok_host(spark, sf):
    probes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tenant"), F.col("l_linenumber").alias("n"), (F.col("l_linestatus") == "O").alias("ok"))
    return rk.lowest_ok_host(probes)


def score_histogram(spark, sf):
    scored = table(spark, sf, "part").select((F.col("p_size") * 20 - 40).alias("score"))
    return reports.score_histogram(scored, rows_per_block=BAR)


def csv_sink_roundtrip(spark, sf):
    """Customers with quotes, commas, blanks and line ends, written as CSV and read back."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('", '), "c_mktsegment").alias("quoted"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat(F.lit(" a\n"), F.col("c_nationkey").cast("string"), F.lit("\\ "))).alias("note"),
    )
    return read_csv(spark, write_csv(rows, scratch_path(spark, "csv")), rows.schema)


QUERIES = {
    "dedup_keep_first": dedup_keep_first,
    "dedup_hot_key": dedup_hot_key,
    "priority_sort_cap": priority_sort_cap,
    "first_success_per_group": first_success_per_group,
    "lowest_ok_host": lowest_ok_host,
    "score_histogram": score_histogram,
    "csv_sink_roundtrip": csv_sink_roundtrip,
}

ORACLES = {
    "dedup_keep_first": """
        SELECT doc_id, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "dedup_hot_key": """
        WITH d AS (SELECT doc_id, CASE WHEN n_chars > 6000 THEN '' ELSE lang END AS url FROM documents),
        firsts AS (SELECT url, min(doc_id) AS doc_id FROM d GROUP BY url)
        SELECT doc_id, url, 'collapse' AS mode FROM firsts
        UNION ALL SELECT doc_id, url, 'keep_all' FROM firsts WHERE url <> ''
        UNION ALL SELECT doc_id, url, 'keep_all' FROM d WHERE url = ''""",
    "priority_sort_cap": f"""
        WITH p AS (SELECT doc_id, CASE WHEN {sql_contains_any('lower(text)', WORDS)} THEN 0 ELSE 1 END AS priority FROM documents)
        SELECT doc_id, priority, CAST(row_number() OVER (ORDER BY priority, doc_id) AS INTEGER) AS rank FROM p
        ORDER BY priority, doc_id LIMIT {CAP}""",
    "first_success_per_group": """
        WITH b AS (
            SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS l_linenumber,
                   (min({'n': l_linenumber, 'p': l_partkey}) FILTER (WHERE l_returnflag = 'R')).p AS l_partkey
            FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'ok' WHEN l_linenumber > 1 THEN 'fixed' ELSE 'failed' END AS status,
               l_linenumber, l_partkey FROM b""",
    "lowest_ok_host": """
        SELECT l_orderkey AS tenant, min(l_linenumber) AS host_no FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber BETWEEN 1 AND 5 GROUP BY l_orderkey""",
    "score_histogram": f"""
        WITH s AS (SELECT p_size * 20 - 40 AS score FROM part),
        b(bucket, label, lo, hi) AS (VALUES (0, '0 (error/excluded)', 0, 0), (1, '1–30', -1000000, 30), (2, '31–40', 31, 40),
            (3, '41–50', 41, 50), (4, '51–65', 51, 65), (5, '66–79', 66, 79), (6, '80+', 80, 1000000)),
        c AS (SELECT bucket, label, count(score) AS cnt FROM b LEFT JOIN s
              ON score BETWEEN lo AND hi AND (bucket = 0) = (score = 0) GROUP BY bucket, label)
        SELECT bucket, label, cnt,
               rpad(label, 22, ' ') || ': ' || CASE WHEN length(cnt::VARCHAR) >= 3 THEN cnt::VARCHAR ELSE lpad(cnt::VARCHAR, 3, ' ') END
               || '  ' || repeat('█', CAST(ceil(cnt / {BAR}) AS BIGINT)) AS line
        FROM c""",
    "csv_sink_roundtrip": """
        SELECT c_custkey, '"' || c_name || '", ' || c_mktsegment AS quoted,
               CASE WHEN c_acctbal < 0 THEN '' ELSE ' a' || chr(10) || c_nationkey || '\\ ' END AS note FROM customer""",
}
