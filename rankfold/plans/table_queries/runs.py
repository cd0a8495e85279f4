"""Whole runs through the real entry points, over lists, boards and pages made from the given tables."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from rankfold import config as cf, fixed_values as fv
from rankfold.config import CompanyRule, Rule, SearchConfig
from rankfold.plans import search
from rankfold.plans.table_queries import boards, listing, rules
from rankfold.plans.table_queries.common import sql_contains_any, sql_has_word, sql_visible_text, table
from rankfold.session import scratch_path
from rankfold.sources.sinks import read_csv, write_results

AS_OF = datetime(2024, 1, 31, 12)
SIGNAL = ("gear", "ertion", "nation")
RUBRIC, PROFILE = "Rate the job for {profile}.", "an engineer"
SHELL_PAGE = '<div id="root"></div>'
SHORT_MARKUP = 2000

CONFIG = SearchConfig(
    seniority_words=("old",), other_role_words=("red",), wanted_role_words=("gear", "bolt", "rod"),
    signal_words=SIGNAL, target_companies=("brand#1", "customer#000000002"), stale_days=29,
    rules=(
        Rule("blue", cf.DISQUALIFY, "title", "word", ("blue",), flag="blue"),
        Rule("promo", cf.FLAG, "location", "exact", ("promo",), flag="check place"),
        Rule("gear", cf.POINTS, "title", "substring", ("gear",), 30),
        Rule("co", cf.POINTS, "title", "word", ("co",), 25),
        Rule("text", cf.POINTS, "description", "substring", ("tion",), 12),
    ),
    company_rules=(CompanyRule("brand#3", None, 40, "known"), CompanyRule("brand#4", "bolt", 0, "never")),
    salary_limit=10**15, technologies=(), wanted_languages=("zzzz",), rival_languages=("yyyy",),
)


def _inputs(spark, sf) -> search.Inputs:
    docs, sources = listing.list_inputs(spark, sf)
    captured, hosts = boards.board_c_inputs(spark, sf)
    short = F.length("html") <= SHORT_MARKUP
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("https://apply.example/"), F.col("page_id").cast("string"), F.lit("?a=1&b=2")).alias("url"),
        F.when(short, F.lit(SHELL_PAGE)).otherwise(F.col("html")).alias("html"),
        F.when(short, F.col("html")).otherwise(F.lit("")).alias("rendered_html"),
    )
    return search.Inputs(
        sources=sources, raw_docs=docs, board_a=boards.board_a_payloads(spark, sf), board_b=boards.board_b_payloads(spark, sf),
        board_c=captured, host_probes=hosts, pages=pages)


def search_run(spark, sf):
    """Every row of a run over lists, three kinds of boards and pages, with its outcome."""
    scored = search.run_search(_inputs(spark, sf), AS_OF, CONFIG).scored
    return scored.select(
        "source", "source_rank", "board_rank", "item_pos", "company", "role", "url", "posted", "priority", "score", "verdict",
        "flag", "target", "reason", F.md5("description").alias("digest"))


def search_run_counts(spark, sf):
    """The counts that a run of today's postings reports."""
    return search.run_search(_inputs(spark, sf), AS_OF, CONFIG.with_(today_only=True)).run_counts


def search_run_sources(spark, sf):
    """Rows found per source, before keep-first."""
    return search.run_search(_inputs(spark, sf), AS_OF, CONFIG, save_stages=False).source_counts


def results_sink(spark, sf):
    """The published columns of a run's results, written under the run's stamp and read back."""
    stages = search.run_search(_inputs(spark, sf), AS_OF, CONFIG)
    path = write_results(stages.results, scratch_path(spark, "results"), AS_OF)
    return read_csv(spark, path, search.output_table(stages).schema).withColumn("file", F.element_at(F.split(F.lit(path), "/"), -1))


def _answer(prompts: pd.Series) -> pd.Series:
    """Stands for a model: its score follows from the length of the prompt."""
    return prompts.map(lambda p: f'{{"score": {len(p) % 101}, "verdict": "GOOD_FIT"}}')


def model_prompt_run(spark, sf):
    """Documents scored by a model that sees the rubric with the profile, then the posting."""
    scored = search.model_scorer(_answer, RUBRIC, PROFILE)(rules._document_rows(spark, sf))
    return scored.select("doc_id", "score", "verdict", "flag")


QUERIES = {
    "search_run": search_run,
    "search_run_counts": search_run_counts,
    "search_run_sources": search_run_sources,
    "results_sink": results_sink,
    "model_prompt_run": model_prompt_run,
}

_ROWS = f"""
    postings AS (
        SELECT source, source_rank, board_rank, item_pos, company, role, location, url, posted, '' AS description
        FROM ({listing.ORACLES['list_scan']})
        UNION ALL SELECT source, {search.BOARD_A_RANK}, board_rank, item_pos, company, role, location, url, posted, description
        FROM ({boards.ORACLES['board_a_scan']})
        UNION ALL SELECT source, {search.BOARD_B_RANK}, board_rank, item_pos, company, role, location, url, posted, description
        FROM ({boards.ORACLES['board_b_scan']})
        UNION ALL SELECT '{fv.BOARD_C}', {search.BOARD_C_RANK}, board_rank, item_pos, company, role, location, url, posted, description
        FROM ({boards.ORACLES['board_c_scan']})),
    firsts AS (SELECT *, {sql_contains_any("lower(role || ' ' || description)", SIGNAL)} AS has_signal FROM postings
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY source_rank, board_rank, item_pos) = 1)"""
_OUTCOMES = f"""
    WITH {_ROWS},
    texts AS (SELECT 'https://apply.example/' || page_id || '?a=1&b=2' AS url, {sql_visible_text('html')} AS page_text FROM pages),
    filled AS (SELECT f.* REPLACE (CASE WHEN description <> '' THEN description ELSE coalesce(page_text, '') END AS description)
        FROM firsts f LEFT JOIN texts USING (url)),
    facts AS (SELECT *, CASE WHEN has_signal THEN 0 ELSE 1 END AS priority, lower(company) AS firm,
            posted LIKE '2024-01-01%' AS stale,
            description <> '' AND NOT {sql_contains_any("lower(role || ' ' || description)", SIGNAL)} AS off,
            {sql_has_word('lower(role)', ['blue'])} AS blue, lower(location) = 'promo' AS promo,
            30 + CASE WHEN contains(lower(role), 'gear') THEN 30 ELSE 0 END + CASE WHEN {sql_has_word('lower(role)', ['co'])} THEN 25 ELSE 0 END
               + CASE WHEN contains(lower(description), 'tion') THEN 12 ELSE 0 END AS total,
            CASE WHEN lower(company) = 'brand#3' THEN 40
                 WHEN lower(company) = 'brand#4' AND contains(lower(role), 'bolt') THEN 0 ELSE 100 END AS cap FROM filled),
    judged AS (SELECT *, blue OR cap = 0 AS out_, CASE WHEN blue OR cap = 0 THEN 0 ELSE least(total, cap) END AS points FROM facts),
    outcomes AS (SELECT source, source_rank, board_rank, item_pos, company, role, location, url, posted, priority, md5(description) AS digest,
            CASE WHEN stale OR off THEN 0 ELSE points END AS score,
            CASE WHEN stale OR off OR out_ THEN 'EXCLUDED' WHEN cap < 100 OR promo THEN 'FLAGGED' WHEN points >= 80 THEN 'STRONG_FIT'
                 WHEN points >= 66 THEN 'GOOD_FIT' WHEN points >= 51 THEN 'NEAR_MISS' ELSE 'EXCLUDED' END AS verdict,
            CASE WHEN stale THEN '{fv.STALE_FLAG}' WHEN off THEN '{fv.OFF_STACK_FLAG}' WHEN blue THEN 'blue' WHEN cap = 40 THEN 'known'
                 WHEN cap = 0 THEN 'never' WHEN promo THEN 'check place' ELSE '' END AS flag,
            CASE WHEN stale OR off THEN '' WHEN firm IN ('brand#1', 'customer#000000002') THEN '{fv.TARGET_MARK}' ELSE '' END AS target,
            CASE WHEN stale THEN '{fv.STALE_REASON}' WHEN off THEN '{fv.OFF_STACK_REASON}' WHEN blue THEN 'disqualified: blue'
                 WHEN out_ THEN 'disqualified: company' WHEN cap < total THEN 'capped at ' || cap ELSE 'rule points: ' || total END AS reason
        FROM judged)"""
_PROMPT = (
    f"'{RUBRIC.replace('{profile}', PROFILE)}' || chr(10) || chr(10) || 'Job to evaluate:' || chr(10) || 'Title: ' || source || chr(10)"
    f" || 'Company: ' || lang || chr(10) || 'Location: ' || source || chr(10) || 'Description: ' ||"
    f" CASE WHEN text = '' THEN '{fv.NO_DESCRIPTION_TEXT}' ELSE text END"
)

ORACLES = {
    "search_run": f"""{_OUTCOMES}
        SELECT source, source_rank, board_rank, item_pos, company, role, url, posted, priority, score, verdict, flag, target, reason, digest
        FROM outcomes""",
    "search_run_counts": f"""
        WITH {_ROWS}, today AS (SELECT * FROM firsts WHERE posted = '0d' OR posted LIKE '2024-01-31%')
        SELECT (SELECT count(*) FROM postings) AS n_found, (SELECT count(*) FROM firsts) AS n_unique, count(*) AS n_recent,
               count(*) FILTER (WHERE has_signal) AS n_signal, count(*) AS n_to_process FROM today""",
    "search_run_sources": f"WITH {_ROWS} SELECT source, count(*) AS n_rows FROM postings GROUP BY source",
    "results_sink": f"""{_OUTCOMES}
        SELECT score, verdict, flag, target, company, role, location, posted, reason, source, url, 'jobs_20240131_120000.csv' AS file
        FROM outcomes WHERE score >= 51 AND verdict <> 'EXCLUDED'""",
    "model_prompt_run": f"""
        SELECT doc_id, CAST(length({_PROMPT}) % 101 AS INTEGER) AS score, 'GOOD_FIT' AS verdict, '' AS flag FROM documents""",
}
