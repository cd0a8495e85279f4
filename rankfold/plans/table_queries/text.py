"""Text operators over documents, pages, parts, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions import replies, text as tx
from rankfold.functions.html import html_to_text
from rankfold.plans.table_queries.common import quoted, sql_contains_any, sql_visible_text, spread_table, table
from rankfold.schema import each_item

LINK = r"""href=["']?(/[^"'> ]+)"""
PREFERRED, AVOIDED, LAST = ("blog.", "//m."), ("github.com", "spam-farm"), ("spam-farm",)
WORDS = ("trash", "idiot", "worthless")
SHELL = ('class="ad"', "<footer")
THIN_CHARS = 3000


def extract_urls(spark, sf):
    text = F.concat("html", F.lit(" [page]("), "url", F.lit(")"))
    return each_item(spread_table(spark, sf, "pages", "page_id", "url", "html"), ["page_id"], tx.extract_urls(text, href=LINK), "pos", "link")


def pick_tiered_url(spark, sf):
    mirror = F.concat(F.lit("https://github.com/p/"), F.col("page_id").cast("string"))
    pages = table(spark, sf, "pages")

    def pick(*urls):
        return tx.pick_url(F.array(*urls).cast("array<string>"), PREFERRED, AVOIDED, LAST)

    return pages.select(
        "page_id", pick(mirror, "url").alias("of_two"), pick("url", mirror).alias("of_two_reversed"),
        pick(mirror).alias("of_one"), pick().alias("of_none"),
    )


def clean_text(spark, sf):
    pages = spread_table(spark, sf, "pages", "page_id", "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw"))
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
        F.concat(F.lit(" **["), "source", F.lit("](https://x.example)** :new: "), "text").alias("raw"),
    )
    return pages.unionByName(docs).select("kind", "id", tx.clean_cell(F.col("raw")).alias("cleaned")).select(
        "kind", "id", F.char_length("cleaned").alias("n_chars"), F.md5("cleaned").alias("digest")
    )


_CLEAN_SQL = "raw"
for _pattern, _new in fv.CELL_CLEANING:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{_pattern}', '{_new.replace('$', chr(92))}', 'g')"


def html_to_text_query(spark, sf):
    text = spread_table(spark, sf, "pages", "page_id", "html").select("page_id", html_to_text(F.col("html")).alias("body"))
    return text.select("page_id", F.char_length("body").alias("n_chars"), F.md5("body").alias("digest"))


def thin_page_flag(spark, sf):
    text = spread_table(spark, sf, "pages", "page_id", "html").select("page_id", "html", html_to_text(F.col("html")).alias("body"))
    return text.select(
        "page_id", tx.looks_like_shell(F.col("html"), SHELL).alias("is_shell"),
        tx.is_thin_page(F.col("body"), F.col("html"), THIN_CHARS, SHELL).alias("is_thin"),
    )


def title_case(spark, sf):
    raw = F.lower(F.concat_ws("-", "p_brand", "p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", tx.title_case(raw).alias("title"))


def prompt_assembly(spark, sf):
    conv = table(spark, sf, "conversations")
    said = F.when(F.col("role") == "assistant", "").otherwise(F.col("text"))
    prompt = replies.scoring_prompt(
        F.col("role"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")),
        F.concat(F.lit("turn "), F.col("turn").cast("string")), said,
    )
    return conv.select(
        "conv_id", "turn", prompt.alias("prompt"),
        replies.fill_profile(F.concat(F.lit("<{profile}> "), "role"), F.col("text")).alias("filled"),
    )


def parse_scorer_reply(spark, sf):
    labels = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    score = F.pmod("n_chars", F.lit(101)).cast("string")
    reply = (
        F.when(F.col("toxic") == 1, F.concat(F.lit('{"score": '), score, F.lit(', "verdict": "NEAR_')))
        .when(F.col("lang") == "en", F.concat(
            F.lit('```json\n{"score": '), score, F.lit(', "reason": "'), "source",
            F.lit('", "verdict": "GOOD_FIT", "flag": null}\n```')))
        .when(F.col("lang") == "de", F.concat(
            F.lit('Sure: {"score": "'), score, F.lit('", "verdict": "NEAR_MISS", "flag": "null"} done')))
        .when(F.col("lang") == "fr", F.concat(
            F.lit('{"score": '), score, F.lit('.7, "reason": "'), "source", F.lit('", "flag": "'), "lang", F.lit('"}')))
        .when(F.col("quality") == 1, F.lit('{"score": null, "verdict": "GOOD_FIT"}'))
        .otherwise(F.lit('{"verdict": "GOOD_FIT"}'))
    )
    parsed = replies.with_reply(labels, reply, "r")
    return parsed.select("doc_id", "r.score", "r.reason", "r.verdict", "r.flag")


def keyword_any(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text")
    return docs.select("doc_id", tx.has_signal(F.col("source"), F.col("text"), WORDS).alias("has_word"))


def title_class_gate(spark, sf):
    gate = tx.title_class(F.col("p_name"), ("old",), ("red",), ("gear", "bolt"))
    return table(spark, sf, "part").select("p_partkey", "p_name", gate.alias("passes")).filter("passes")


QUERIES = {
    "extract_urls": extract_urls,
    "pick_tiered_url": pick_tiered_url,
    "clean_text": clean_text,
    "html_to_text": html_to_text_query,
    "thin_page_flag": thin_page_flag,
    "title_case": title_case,
    "prompt_assembly": prompt_assembly,
    "parse_scorer_reply": parse_scorer_reply,
    "keyword_any": keyword_any,
    "title_class_gate": title_class_gate,
}

_TWO_URLS = f"""
    CASE WHEN {sql_contains_any('url', PREFERRED)} THEN url
         WHEN NOT {sql_contains_any('url', AVOIDED)} THEN url
         WHEN {sql_contains_any('url', LAST)} THEN url
         ELSE """

ORACLES = {
    "extract_urls": f"""
        WITH links AS (
            SELECT page_id, list_concat(
                regexp_extract_all(html || ' [page](' || url || ')', '{LINK.replace("'", "''")}', 1),
                regexp_extract_all(html || ' [page](' || url || ')', '{fv.MARKDOWN_LINK_PATTERN}', 1)) AS found
            FROM pages)
        SELECT page_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos, unnest(found) AS link FROM links""",
    "pick_tiered_url": f"""
        SELECT page_id, {_TWO_URLS} url END AS of_two,
               {_TWO_URLS} 'https://github.com/p/' || page_id END AS of_two_reversed,
               'https://github.com/p/' || page_id AS of_one, '' AS of_none
        FROM pages""",
    "clean_text": f"""
        WITH raws AS (
            SELECT 'page' AS kind, page_id AS id, html AS raw FROM pages
            UNION ALL SELECT 'doc', doc_id, ' **[' || source || '](https://x.example)** :new: ' || text FROM documents),
        cleaned AS (SELECT kind, id, regexp_replace({_CLEAN_SQL}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]+$', '', 'g') AS cleaned FROM raws)
        SELECT kind, id, CAST(length(cleaned) AS INTEGER) AS n_chars, md5(cleaned) AS digest FROM cleaned""",
    "html_to_text": f"""
        WITH t AS (SELECT page_id, {sql_visible_text('html')} AS body FROM pages)
        SELECT page_id, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS digest FROM t""",
    "thin_page_flag": f"""
        WITH t AS (SELECT page_id, html, {sql_visible_text('html')} AS body FROM pages)
        SELECT page_id, {sql_contains_any('html', SHELL)} AS is_shell,
               length(body) < {THIN_CHARS} AND {sql_contains_any('html', SHELL)} AS is_thin FROM t""",
    "title_case": r"""
        WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_brand || '-' || p_name || '-' || p_type), '[a-z]+|[^a-z]+') AS runs FROM part)
        SELECT p_partkey, array_to_string(list_transform(runs, lambda r: upper(r[1]) || r[2:]), '') AS title FROM w""",
    "prompt_assembly": f"""
        SELECT conv_id, turn,
               'Job to evaluate:' || chr(10) || 'Title: ' || role || chr(10) || 'Company: conversation ' || conv_id
               || chr(10) || 'Location: turn ' || turn || chr(10) || 'Description: '
               || CASE WHEN role = 'assistant' OR text = '' THEN '{fv.NO_DESCRIPTION_TEXT}' ELSE text END AS prompt,
               '<' || text || '> ' || role AS filled
        FROM conversations""",
    "parse_scorer_reply": f"""
        WITH r AS (
            SELECT doc_id, source, lang, CAST(n_chars % 101 AS INTEGER) AS s, quality,
                   toxic = 1 OR (lang NOT IN ('en', 'de', 'fr') AND quality = 1) AS bad
            FROM documents LEFT JOIN labels USING (doc_id))
        SELECT doc_id,
               CASE WHEN bad OR lang NOT IN ('en', 'de', 'fr') THEN 0 ELSE s END AS score,
               CASE WHEN bad THEN '{fv.REPLY_ERROR_REASON}' WHEN lang IN ('en', 'fr') THEN source ELSE '' END AS reason,
               CASE WHEN bad THEN 'EXCLUDED' WHEN lang = 'de' THEN 'NEAR_MISS' WHEN lang = 'fr' THEN ''
                    ELSE 'GOOD_FIT' END AS verdict,
               CASE WHEN bad THEN '{fv.REPLY_ERROR_FLAG}' WHEN lang = 'fr' THEN 'fr' ELSE '' END AS flag
        FROM r""",
    "keyword_any": f"""
        SELECT doc_id, {sql_contains_any("lower(source || ' ' || text)", WORDS)} AS has_word FROM documents""",
    "title_class_gate": """
        SELECT p_partkey, p_name, TRUE AS passes FROM part
        WHERE NOT contains(p_name, 'old') AND NOT contains(p_name, 'red')
          AND (contains(p_name, 'gear') OR contains(p_name, 'bolt'))""",
}
