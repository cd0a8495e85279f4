"""The shipped rules and places, rule tables, and lists read from files, over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rankfold import config as cf, fixed_values as fv
from rankfold.config import SearchConfig
from rankfold.operators import matching as mt, places, rule_tables as rt, rules as rl
from rankfold.plans.table_queries.common import quoted, sql_contains_any, sql_visible_text, spread_table, table
from rankfold.schema import COMPANY_ATTRS_SCHEMA
from rankfold.session import scratch_path
from rankfold.sources.landed import read_list_files
from rankfold.sources.lists import html_postings

CONFIG = SearchConfig()
PHRASES = (
    "C# and .NET on Azure Functions, with Redis. Salary $90,000.", f"We need {fv.CLEARANCE_PHRASES[0]}.", f"A {fv.PLACEMENT_PHRASES[0]} role.",
    f"Note: {fv.NO_SPONSORSHIP_PHRASES[0]}!", "Angular is required. Java or C#. Build Java services.", "Strong experience in Terraform; ASP.NET Core v1.5 is a plus.",
    "On-site work, 5+ years, REST API in healthcare.", "Remote, C#, microservices, CI/CD, CQRS. Pays $680K.", "Nothing of note",
    "Customer Service and MS Office. Lambda, LLM integration, entry-level.", "java python ruby php scala kotlin swift perl react vue django flask spring "
    "rails kafka spark hadoop redis docker ansible jenkins tableau",
)
ROLES = ("Software Engineer", "Sr. Software Engineer", f"{fv.WRONG_ROLE_PHRASES[0].title()} II", "Backend Developer", "Junior Software Developer")
LOCATIONS = ("Austin, TX", "Paris, TX", "Berlin, Germany", "Remote", " Remote in UK", "New York, NY 10001", "")
COMPANIES = (fv.DEFENSE_CONTRACTORS[0].title(), fv.FALSE_POSITIVES[0][0].upper(), fv.FALSE_POSITIVES[-1][0])
PER_FILE, CUT = 500, 200


def _pick(values, key, step: int = 1):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(key / step) % len(values) + 1).cast("int"))


def _shipped_rows(spark, sf):
    """Documents with a phrase of the rubric behind their text, and titles, places and companies it knows."""
    doc = F.col("doc_id")
    return spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.when(doc % 4 == 0, _pick(COMPANIES, doc, 4)).otherwise(F.concat(F.lit("NATION_"), (doc % 25).cast("string"))).alias("company"),
        _pick(ROLES, doc, 3).alias("role"), _pick(LOCATIONS, doc, 2).alias("location"),
        F.concat("text", F.lit(" "), _pick(PHRASES, doc)).alias("description"))


def _attrs(spark, sf):
    """Nations as companies: some unknown, some no technology firms, some large, small or sponsoring."""
    key = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(
        F.lower("n_name").alias("company_lower"), F.when(key % 5 == 0, "large").when(key % 5 == 1, "small").alias("size_class"),
        (key % 6 != 2).alias("is_tech"), (key % 4 == 3).alias("is_sponsor"), (key % 7 != 5).alias("is_known"))
    return rows.select(*[c.split(" ")[0] for c in COMPANY_ATTRS_SCHEMA.split(", ")])


def default_rule_score(spark, sf):
    """The whole shipped rubric."""
    scored = rl.score_by_rules(_shipped_rows(spark, sf), CONFIG, company_attrs=_attrs(spark, sf))
    return scored.select("doc_id", "score", "verdict", "flag", "reason")


def rule_table_hits(spark, sf):
    """Every word of the benchmark as a rule, by its letters of one kind or another, over whole documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    word, size = F.col("keyword"), F.length("keyword")
    words = table(spark, sf, "benchmark").select(F.explode(found).alias("keyword")).distinct()
    rules = words.select(
        word.alias("rule_id"), size.alias("rule_order"),
        _pick((cf.DISQUALIFY, cf.CAP, cf.POINTS, cf.FLAG), F.ascii(F.substring(word, 2, 1))).alias("kind"), F.lit("description").alias("scope"),
        F.when(size % 2 == 0, "substring").otherwise("word").alias("match"), "keyword", size.alias("value"), F.upper(word).alias("flag"),
        F.array(F.concat(word, F.lit("e"))).alias("unless"))
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", *[F.lit("").alias(c) for c in ("company", "role", "location")], F.col("text").alias("description"))
    hits = rt.with_rule_hits(rl.with_rule_text(docs, CONFIG.with_(rules=(), technologies=(), rival_languages=())), rules, CONFIG)
    folds = rt.folded(F.col(rt.HITS))
    return hits.select("doc_id", F.size(rt.HITS).alias("n_hits"), folds["points"].alias("points"),
                       *[F.coalesce(folds[n], F.lit("")).alias(n) for n in ("out", "out_flag", "note", "cap_flag")],
                       F.coalesce(folds["cap"], F.lit(-1)).alias("cap"))


def foreign_places(spark, sf):
    """Customers' places, spelled in seven ways."""
    key = F.col("c_custkey")
    country = _pick(("Germany", "India", "Mexico", "Jordan", "Northern Ireland", "New Zealand", "United States"), key, 7)
    city = _pick(("Paris", "Berlin", "Ithaca", "Tel Aviv", "São Paulo"), key, 3)
    spelled = F.element_at(F.array(
        F.concat(city, F.lit(", "), country), F.concat(city, F.lit(", TX")), F.concat(F.lit("Remote - "), country), F.concat(city, F.lit(" , NY 10001 ")),
        F.concat(F.lit("Santa Fe, New Mexico ("), F.col("c_mktsegment"), F.lit(")")), F.concat(country, F.lit(" or U.S.")), F.upper(city)),
        (key % 7 + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", spelled.alias("location"))
    return places.with_foreign(rows).select("c_custkey", "location", F.coalesce("place", F.lit("")).alias("place"), "is_foreign")


def list_files(spark, sf):
    """HTML lists without end tags, written as files of many rows, read back and parsed."""
    row = F.concat(F.lit("<tr><td><b>"), "c_name", F.lit("</b><td>"), F.lower("c_mktsegment"), F.lit(" &amp; co<td><p>nation "), F.col("c_nationkey").cast("string"),
                   F.lit('<td><a href="https://apply.example/'), F.col("c_custkey").cast("string"), F.lit('">Apply</a><td>'), F.col("c_nationkey").cast("string"), F.lit("d"))
    rows = table(spark, sf, "customer").select(F.expr(f"c_custkey DIV {PER_FILE}").alias("doc_no"), F.struct("c_custkey", row.alias("row")).alias("r"))
    files = rows.groupBy("doc_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "\n").alias("content"))
    path = scratch_path(spark, "lists")
    files.select(F.concat(F.lit("<table><tr><th>Company<th>Role<tbody>"), "content", F.lit("</table>")).alias("value"), F.lit("tables").alias("source"),
                 "doc_no").write.partitionBy("source", "doc_no").text(path)
    return html_postings(read_list_files(spark, path), keep=("source", "doc_no"))


def description_cut(spark, sf):
    """Pages' visible texts under a limit of characters."""
    pages = table(spark, sf, "pages").select("url", "html", F.lit("").alias("rendered_html"))
    return mt.page_text(pages, SearchConfig(description_chars=CUT))


QUERIES = {
    "default_rule_score": default_rule_score,
    "rule_table_hits": rule_table_hits,
    "foreign_places": foreign_places,
    "list_files": list_files,
    "description_cut": description_cut,
}


# ---- SQL

def _sql_pick(values, key: str, step: int = 1) -> str:
    return f"([{quoted(values)}])[({key} // {step}) % {len(values)} + 1]"


def _has_word(column: str, words) -> str:
    phrases = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return f"regexp_matches({column}, {quoted([f'(^|[^a-z0-9])(?:{phrases})($|[^a-z0-9])'])})"


_SENTENCES = r"regexp_split_to_array(regexp_replace(body, '\.+(\s|$)', chr(10) || '\1', 'g'), '[!?;\n]+')"


def _some(test: str) -> str:
    return f"len(list_filter({_SENTENCES}, lambda s: {test})) > 0"


def _sql_hit(rule: cf.Rule) -> str:
    column = {"title": "title", "description": "body", "location": "place", "both": "(title || chr(10) || body)"}[rule.scope]
    if rule.match == "required":
        hit = _some(f"{sql_contains_any('s', rule.keywords)} AND {sql_contains_any('s', CONFIG.required_cues)} "
                    f"AND NOT {sql_contains_any('s', CONFIG.optional_cues)}")
    elif rule.match == "absent":
        hit = f"{column} <> '' AND NOT {sql_contains_any(column, rule.keywords)}"
    elif rule.match == "exact":
        hit = f"{column} IN ({quoted(rule.keywords)})"
    elif rule.match == "regex":
        hit = " OR ".join(f"regexp_matches({column}, {quoted([w])})" for w in rule.keywords)
    else:
        hit = _has_word(column, rule.keywords) if rule.match == "word" else sql_contains_any(column, rule.keywords)
    if rule.unless:
        hit = f"({hit}) AND NOT {sql_contains_any(column, rule.unless)}"
    if rule.unless_pattern:
        hit = f"({hit}) AND NOT regexp_matches({column}, {quoted([rule.unless_pattern])})"
    return f"({hit})"


def _default_sql() -> str:
    rules = cf.default_rules()
    out = [r for r in rules if r.kind == cf.DISQUALIFY]
    points = " + ".join(f"CASE WHEN {_sql_hit(r)} THEN {r.value} ELSE 0 END" for r in rules if r.kind == cf.POINTS)
    note = next(r for r in rules if r.kind == cf.FLAG)
    never = " OR ".join(f"firm = {quoted([c])}" + (f" AND contains(title, {quoted([t])})" if t else "") for c, t in fv.FALSE_POSITIVES)
    wanted, rival = sql_contains_any("s", CONFIG.wanted_languages), _has_word("s", CONFIG.rival_languages)
    amount = "CAST(regexp_replace(a, '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN a LIKE '%k' THEN 1e3 WHEN a LIKE '%m' THEN 1e6 ELSE 1 END"
    return f"""
    WITH docs AS (SELECT doc_id, text || ' ' || {_sql_pick(PHRASES, 'doc_id')} AS description,
            CASE WHEN doc_id % 4 = 0 THEN {_sql_pick(COMPANIES, 'doc_id', 4)} ELSE 'NATION_' || doc_id % 25 END AS company,
            {_sql_pick(ROLES, 'doc_id', 3)} AS role, {_sql_pick(LOCATIONS, 'doc_id', 2)} AS location FROM documents),
    texts AS (SELECT doc_id, lower(description) AS body, lower(role) AS title, lower(trim(location)) AS place, lower(company) AS firm FROM docs),
    facts AS (SELECT t.*, coalesce(n.n_nationkey % 5 = 0, FALSE) AS large, coalesce(n.n_nationkey % 5 = 1, FALSE) AS small,
            coalesce(n.n_nationkey % 4 = 3, FALSE) AS sponsor, coalesce(n.n_nationkey % 6 = 2, FALSE) AS no_tech,
            coalesce(n.n_nationkey % 7 = 5, FALSE) AS unknown,
            CASE {' '.join(f"WHEN {_sql_hit(r)} THEN {quoted([r.rule_id])}" for r in out)} ELSE '' END AS rule_id,
            {_sql_hit(note)} AS noted, {points} AS points,
            len(list_filter(regexp_extract_all(body, '\\$ ?[0-9][0-9,]*(?:\\.[0-9]+)?(?:[km]\\b)?'), lambda a: {amount} > {CONFIG.salary_limit})) > 0 AS salary,
            len(list_distinct(list_intersect(regexp_split_to_array(body, '[^a-z0-9]+'), [{quoted(CONFIG.technologies)}]))) >= {CONFIG.technology_limit} AS many,
            {sql_contains_any('title', CONFIG.engineering_title_words)} AND {sql_contains_any('body', CONFIG.office_skill_words)} AS mismatch,
            ({never}) AS never, firm IN ({quoted(fv.DEFENSE_CONTRACTORS)}) AS contractor,
            {_some(wanted + ' AND ' + rival)} AND {_some(rival + ' AND NOT ' + wanted)} AND NOT ({_some(wanted + ' AND NOT ' + rival)}) AS cosmetic
        FROM texts t LEFT JOIN nation n ON lower(n.n_name) = t.firm),
    sums AS (SELECT *, rule_id <> '' OR never AS out_,
            30 + points - CASE WHEN cosmetic AND NOT large THEN 20 ELSE 0 END + CASE WHEN sponsor THEN 5 ELSE 0 END - CASE WHEN small THEN 5 ELSE 0 END AS total,
            least(CASE WHEN contractor THEN 50 ELSE 100 END, CASE WHEN salary OR many OR mismatch OR unknown OR no_tech THEN 40 ELSE 100 END) AS cap,
            CASE WHEN never THEN 'known false positive' WHEN contractor THEN {quoted([fv.DEFENSE_FLAG])} WHEN salary THEN 'implausible salary'
                 WHEN many THEN 'unfocused technology list' WHEN mismatch THEN 'title and skills do not match' WHEN unknown THEN 'unknown company'
                 WHEN no_tech THEN 'non-tech organisation' ELSE '' END AS cap_flag FROM facts)
    SELECT doc_id, CAST(CASE WHEN out_ THEN 0 ELSE greatest(0, least(total, cap)) END AS INTEGER) AS score,
        CASE WHEN out_ THEN 'EXCLUDED' WHEN cap_flag <> '' OR noted THEN 'FLAGGED' WHEN least(total, cap) >= 80 THEN 'STRONG_FIT'
             WHEN least(total, cap) >= 66 THEN 'GOOD_FIT' WHEN least(total, cap) >= 51 THEN 'NEAR_MISS' ELSE 'EXCLUDED' END AS verdict,
        CASE {' '.join(f"WHEN rule_id = {quoted([r.rule_id])} THEN {quoted([r.flag])}" for r in out)} WHEN cap_flag <> '' THEN cap_flag
             WHEN noted THEN {quoted([note.flag])} ELSE '' END AS flag,
        CASE WHEN rule_id <> '' THEN 'disqualified: ' || rule_id WHEN out_ THEN 'disqualified: company' WHEN cap < total THEN 'capped at ' || cap
             ELSE 'rule points: ' || total END AS reason FROM sums"""


_KEY_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark"

ORACLES = {
    "default_rule_score": _default_sql(),
    "rule_table_hits": f"""
        WITH rules AS (SELECT word, length(word) AS size, ([{quoted((cf.DISQUALIFY, cf.CAP, cf.POINTS, cf.FLAG))}])[ascii(substr(word, 2, 1)) % 4 + 1] AS kind FROM ({_KEY_WORDS})),
        docs AS (SELECT doc_id, lower(text) AS body FROM documents),
        met AS (SELECT * FROM docs JOIN rules ON contains(body, word) AND NOT contains(body, word || 'e')),
        hits AS (SELECT * FROM met WHERE size % 2 = 0 OR regexp_matches(body, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])'))
        SELECT doc_id, CAST(count(word) AS INTEGER) AS n_hits, CAST(coalesce(sum(size) FILTER (WHERE kind = 'points'), 0) AS INTEGER) AS points,
               coalesce(arg_min(word, (size, word)) FILTER (WHERE kind = 'disqualify'), '') AS out,
               coalesce(upper(arg_min(word, (size, word)) FILTER (WHERE kind = 'disqualify')), '') AS out_flag,
               coalesce(upper(arg_min(word, (size, word)) FILTER (WHERE kind = 'flag')), '') AS note,
               coalesce(upper(arg_min(word, (size, word)) FILTER (WHERE kind = 'cap')), '') AS cap_flag,
               CAST(coalesce(min(size) FILTER (WHERE kind = 'cap'), -1) AS INTEGER) AS cap
        FROM docs LEFT JOIN hits USING (doc_id) GROUP BY doc_id""",
    "foreign_places": """
        WITH parts AS (SELECT c_custkey, c_mktsegment, c_custkey % 7 AS way,
            (['Germany', 'India', 'Mexico', 'Jordan', 'Northern Ireland', 'New Zealand', 'United States'])[(c_custkey // 7) % 7 + 1] AS country,
            (['Paris', 'Berlin', 'Ithaca', 'Tel Aviv', 'São Paulo'])[(c_custkey // 3) % 5 + 1] AS city FROM customer),
        known AS (SELECT *, CASE WHEN country = 'United States' THEN '' ELSE lower(country) END AS abroad,
            CASE WHEN city IN ('Paris', 'Berlin', 'Tel Aviv') THEN lower(city) ELSE '' END AS town FROM parts)
        SELECT c_custkey,
            CASE way WHEN 0 THEN city || ', ' || country WHEN 1 THEN city || ', TX' WHEN 2 THEN 'Remote - ' || country WHEN 3 THEN city || ' , NY 10001 '
                     WHEN 4 THEN 'Santa Fe, New Mexico (' || c_mktsegment || ')' WHEN 5 THEN country || ' or U.S.' ELSE upper(city) END AS location,
            CASE WHEN way = 0 THEN CASE WHEN town <> '' THEN town ELSE abroad END WHEN way IN (1, 3, 6) THEN town WHEN way IN (2, 5) THEN abroad ELSE '' END AS place,
            CASE WHEN way = 0 THEN (town <> '' OR abroad <> '') AND country <> 'United States' WHEN way = 2 THEN abroad <> '' WHEN way = 6 THEN town <> '' ELSE FALSE END AS is_foreign
        FROM known""",
    "list_files": f"""
        SELECT 'tables' AS source, CAST(c_custkey // {PER_FILE} AS BIGINT) AS doc_no,
               row_number() OVER (PARTITION BY c_custkey // {PER_FILE} ORDER BY c_custkey) AS item_pos, c_name AS company,
               lower(c_mktsegment) || ' & co' AS role, 'nation ' || c_nationkey AS location, 'https://apply.example/' || c_custkey AS url,
               c_nationkey || 'd' AS posted FROM customer""",
    "description_cut": f"SELECT url, left({sql_visible_text('html')}, {CUT}) AS page_text FROM pages",
}
