"""The scoring rubric as data-driven rules over a postings table.

Order of precedence: disqualifier or company cap 0, then caps, then the weighted
sum, clamped to 0..100.  All rules become Column expressions of one narrow
projection; company facts come in by an equality join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold import schema as sc
from rankfold.config import CompanyRule, Rule, SearchConfig
from rankfold.functions import text as tx
from rankfold.schema import text_or_empty
from rankfold.session import cut_lineage

MONEY_PATTERN = r"\$ ?[0-9][0-9,]*(?:\.[0-9]+)?(?:[km]\b)?"
# a dot ends a sentence only before a blank or the end: not in ".net", "node.js" or "v1.5"
SENTENCE_END = r"[!?;\n]+|\.+(?=\s|$)"
# "Go" is a language beside commas, slashes, brackets or in a list; elsewhere it is a verb
GO_IN_LIST = r"Go\b(?<=(?:[,/(] ?|\bor |\band |\bin |\bwith )Go)(?= ?[,/)]|\.?(?:\s*$|\s+[A-Z])| or\b| and\b| developer| engineer)"
GO_NAME = "golang"


def _names_go(config: SearchConfig) -> bool:
    words = [*config.technologies, *config.wanted_languages, *config.rival_languages, *(w for r in config.rules for w in (*r.keywords, *r.unless))]
    return any(GO_NAME in w for w in words)


def with_rule_text(df: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Lower-cased text columns, computed once and shared by all rules.

    Texts are searched for the language "Go" only where a setting names it and a text holds the letters.
    """
    body = text_or_empty(F.col("description"))
    if _names_go(config):
        body = F.when(F.contains(body, F.lit("Go")), F.regexp_replace(body, GO_IN_LIST, GO_NAME)).otherwise(body)
    lowered = df.withColumns({
        "_title": F.lower(text_or_empty(F.col("role"))),
        "_body": F.lower(body),
        "_place": F.lower(tx.strip_space(text_or_empty(F.col("location")))),
        "_firm": F.lower(text_or_empty(F.col("company"))),
    })
    return lowered.withColumn("_both", F.concat_ws("\n", "_title", "_body"))


SCOPE = {"title": "_title", "description": "_body", "location": "_place", "company": "_firm", "both": "_both"}


def _required(column: Column, words: Sequence[str], config: SearchConfig) -> Column:
    """Some sentence names a word as required and not as optional."""
    return F.exists(
        F.split(column, SENTENCE_END),
        lambda s: tx.contains_any(s, words)
        & tx.contains_any(s, config.required_cues)
        & ~tx.contains_any(s, config.optional_cues),
    )


def rule_hit(rule: Rule, config: SearchConfig) -> Column:
    """Whether a rule applies to a row that has the ``with_rule_text`` columns."""
    column = F.col(SCOPE[rule.scope])
    if rule.match == "required":
        # cheap test first: most texts never name the word
        hit = tx.contains_any(column, rule.keywords) & _required(column, rule.keywords, config)
    elif rule.match == "absent":
        hit = (column != "") & ~tx.contains_any(column, rule.keywords)
    else:
        hit = tx.matches_any(column, rule.keywords, rule.match)
    if rule.unless:
        hit = hit & ~tx.contains_any(column, rule.unless)
    if rule.unless_pattern:
        hit = hit & ~F.rlike(column, F.lit(rule.unless_pattern))
    return hit


def _of_kind(config: SearchConfig, kind: str) -> list[Rule]:
    return [r for r in config.rules if r.kind == kind]


def first_hit(rules: Sequence[Rule], config: SearchConfig, value) -> Column:
    """``value(rule)`` of the first rule that applies, else null."""
    if not rules:
        return F.lit(None).cast("string")
    chain = reduce(lambda c, r: c.when(rule_hit(r, config), F.lit(value(r))), rules, F)
    return chain.otherwise(F.lit(None))


def disqualifier(config: SearchConfig) -> Column:
    """rule_id of the first disqualifying rule, else null."""
    return first_hit(_of_kind(config, cf.DISQUALIFY), config, lambda r: r.rule_id)


def salary_outlier(body: Column, limit: int) -> Column:
    """Some dollar amount in the text is above ``limit``."""
    amounts = F.regexp_extract_all(body, F.lit(MONEY_PATTERN), F.lit(0))

    def dollars(amount: Column) -> Column:
        number = F.regexp_replace(amount, "[^0-9.]", "").cast("double")
        return number * F.when(amount.endswith("k"), 1e3).when(amount.endswith("m"), 1e6).otherwise(1.0)

    return F.contains(body, F.lit("$")) & F.exists(amounts, lambda a: dollars(a) > limit)


def technologies_named(body: Column, technologies: Sequence[str]) -> Column:
    """How many different technologies a text names.

    Names of one word are looked up in the text's set of words; names with
    signs in them need a pattern each.
    """
    plain = [t for t in technologies if re.fullmatch("[a-z0-9]+", t)]
    words = F.split(body, "[^a-z0-9]+")
    count = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in plain]).cast("array<string>")))
    others = [contains.cast("int") for contains in
              (tx.contains_word(body, [t]) for t in technologies if t not in plain)]
    return reduce(lambda a, b: a + b, others, count)


def screen_caps(config: SearchConfig) -> list[tuple[Column, int, str]]:
    """Plausibility screens: (condition, cap, flag)."""
    body, title = F.col("_body"), F.col("_title")
    screens = [
        (salary_outlier(body, config.salary_limit), config.screen_cap, "implausible salary"),
        (technologies_named(body, config.technologies) >= config.technology_limit,
         config.screen_cap, "unfocused technology list"),
        (tx.contains_any(title, config.engineering_title_words)
         & tx.contains_any(body, config.office_skill_words),
         config.screen_cap, "title and skills do not match"),
    ]
    screens += [(rule_hit(r, config), r.value, r.flag) for r in _of_kind(config, cf.CAP)]
    return screens


def is_cosmetic(config: SearchConfig) -> Column:
    """The wanted language only occurs in OR-lists while a rival one stands alone.

    Counted over sentences of one row: a wanted language in an OR-list counts in
    full unless every other mention of a language is a rival's.
    """
    body = F.col("_body")

    def kind(sentence: Column) -> Column:   # one bit per kind of sentence
        rival = tx.contains_word(sentence, config.rival_languages)
        return F.when(
            tx.contains_any(sentence, config.wanted_languages), F.when(rival, 8).otherwise(2)
        ).otherwise(F.when(rival, 4).otherwise(1))

    kinds = F.aggregate(F.split(body, SENTENCE_END), F.lit(0), lambda seen, s: seen.bitwiseOR(kind(s)))
    # both together (8) and a rival alone (4), never the wanted one alone (2)
    return F.when(
        tx.contains_any(body, config.wanted_languages) & tx.contains_any(body, config.rival_languages),
        kinds.isin(12, 13),
    ).otherwise(False)


def rule_points(config: SearchConfig) -> Column:
    """Signed sum of all points rules that apply."""
    parts = [F.when(rule_hit(r, config), r.value).otherwise(0) for r in _of_kind(config, cf.POINTS)]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def company_rule_table(df: DataFrame, rules: Sequence[CompanyRule]) -> DataFrame:
    rows = [(r.company, r.title_contains, r.cap, r.flag) for r in rules]
    return sc.local_table(df.sparkSession, rows, sc.COMPANY_RULES_SCHEMA)


#: Rules of a company that are held in one row; more are joined by what they look for in titles.
RULES_IN_A_ROW = 1000


def _one_per_company(company_attrs: DataFrame | None, folded: DataFrame) -> DataFrame:
    """``folded`` (one row per company) with the companies' attributes, saved."""
    kinds = {"size_class": "string", "is_tech": "boolean", "is_sponsor": "boolean", "is_known": "boolean"}
    if company_attrs is None:
        return cut_lineage(folded.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}))
    one_each = company_attrs.groupBy("company_lower").agg(*[F.max(c).alias(c) for c in kinds])
    return cut_lineage(folded.join(one_each, "company_lower", "full"))


def titled_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """_firm, _title, _titled: the best of the rules that look for something in a title, per company and title.

    What rules look for meets the distinct titles of their companies through
    ``keyword_pairs``, so a company may have any number of rules and of titles.
    """
    from rankfold.operators.matching import keyword_pairs

    wanted = cut_lineage(rules.filter("title_contains IS NOT NULL").select("company_lower", "title_contains", "cap", "flag").distinct())
    titles = df.select("_firm", "_title").distinct().join(wanted.select(F.col("company_lower").alias("_firm")).distinct(), "_firm", "left_semi")
    titles = cut_lineage(titles)
    words = wanted.select(F.col("title_contains").alias("_word")).filter("_word <> ''").distinct()
    met = keyword_pairs(titles.select("_title").distinct(), ["_title"], "_title", cut_lineage(words), "_word")
    met = met.unionByName(titles.select("_title", F.lit("").alias("_word")).distinct())   # an empty word is in every title
    hits = titles.join(met, "_title").join(
        wanted.select(F.col("company_lower").alias("_firm"), F.col("title_contains").alias("_word"), "cap", "flag"), ["_firm", "_word"])
    return cut_lineage(hits.groupBy("_firm", "_title").agg(F.min(F.struct("cap", "flag")).alias("_titled")))


def with_company_facts(df: DataFrame, config: SearchConfig, company_rules: DataFrame | None = None,
                       company_attrs: DataFrame | None = None, most: int = RULES_IN_A_ROW) -> DataFrame:
    """Adds company_cap, company_flag and the company's attributes.

    Rules and attributes are folded to one row per company, so the left join
    keeps the row count (of a company's rules the lowest matching cap wins).
    The folded table is saved: its size decides about broadcasting, and a
    shuffled join has an exchange on either side, so a company with a large part
    of the rows can be split at run time.  Where a company of a given table has
    more than ``most`` rules, those that look at titles are joined by title.
    """
    rules = company_rules if company_rules is not None else company_rule_table(df, config.company_rules)
    largest = 0 if company_rules is None else rules.groupBy("company_lower").count().agg(F.max("count")).first()[0] or 0
    rule = F.struct("cap", "flag", "title_contains")
    if largest <= most:
        folded = rules.groupBy("company_lower").agg(F.collect_set(rule).alias("_rules"))
    else:
        folded = rules.filter("title_contains IS NULL").groupBy("company_lower").agg(F.array(F.min(rule)).alias("_rules"))
    facts = _one_per_company(company_attrs, folded)
    joined = df.join(facts, df["_firm"] == facts["company_lower"], "left").drop("company_lower")
    best = F.array_min(F.transform(F.filter(
        "_rules", lambda r: r.title_contains.isNull() | F.contains(F.col("_title"), r.title_contains)
    ), lambda r: F.struct(r.cap.alias("cap"), r.flag.alias("flag"))))
    if largest > most:
        joined = joined.join(titled_rules(df, rules), ["_firm", "_title"], "left")
        best = F.array_min(F.array_compact(F.array(best, "_titled")))
    return joined.withColumn("_best", best).withColumns({
        "company_cap": F.col("_best.cap"), "company_flag": F.col("_best.flag"),
    }).drop("_rules", "_best", "_titled")


def band(score: Column) -> Column:
    """Verdict of a score."""
    return (
        F.when(score >= 80, "STRONG_FIT").when(score >= 66, "GOOD_FIT")
        .when(score >= 51, "NEAR_MISS").otherwise("EXCLUDED")
    )


def score_by_rules(df: DataFrame, config: SearchConfig = SearchConfig(),
                   company_rules: DataFrame | None = None,
                   company_attrs: DataFrame | None = None, rule_table: DataFrame | None = None) -> DataFrame:
    """Adds score, verdict, flag, reason.  The default scorer of a run.

    ``rule_table`` has further rules, any number of them (see ``rule_tables``); they come after the configured ones.
    """
    attr = lambda c: F.coalesce(c, F.lit(False))
    of_text = screen_caps(config)
    # every test of the texts runs once, before the company facts are joined; what follows,
    # and any filter on the score, only looks at its outcome
    hits = {f"_screen{i}": hit for i, (hit, _, _) in enumerate(of_text)}
    rows = with_rule_text(df, config)
    folded = _no_table_rules()
    if rule_table is not None:
        from rankfold.operators import rule_tables as rt

        rows, folded = rt.with_rule_hits(rows, rule_table, config), rt.folded(F.col(rt.HITS))
    rows = sc.compute_once(
        rows, **hits,
        _out=F.coalesce(disqualifier(config), folded["out"]),
        _note=F.coalesce(first_hit(_of_kind(config, cf.FLAG), config, lambda r: r.flag), folded["note"]),
        _base=F.lit(config.base_score) + rule_points(config) + folded["points"],
        _cosmetic=is_cosmetic(config),
        _table_cap=folded["cap"], _table_cap_flag=folded["cap_flag"], _table_out_flag=folded["out_flag"],
    ).drop("_body", "_both", "_place")
    rows = with_company_facts(rows, config, company_rules, company_attrs)
    of_company = [
        (F.coalesce(~F.col("is_known"), F.lit(False)), config.screen_cap, "unknown company"),
        (F.coalesce(~F.col("is_tech"), F.lit(False)), config.screen_cap, "non-tech organisation"),
    ]
    screens = of_text + of_company
    more = {f"_screen{len(of_text) + i}": hit for i, (hit, _, _) in enumerate(of_company)}
    hits = {**hits, **more}
    large = attr(F.col("size_class") == "large")
    rows = rows.withColumns(more).withColumn("_points", (
        F.col("_base") + F.when(F.col("_cosmetic") & ~large, config.cosmetic_points).otherwise(0)
        + F.when(attr(F.col("is_sponsor")), config.sponsor_points).otherwise(0)
        + F.when(attr(F.col("size_class") == "small"), config.small_company_points).otherwise(0)
    ))
    cap = F.least(
        F.coalesce("company_cap", F.lit(100)), F.coalesce("_table_cap", F.lit(100)),
        *[F.when(F.col(name), screen[1]).otherwise(100) for name, screen in zip(hits, screens)],
    )
    flags = [F.when(F.col(n), screen[2]) for n, screen in zip(hits, screens)]
    cap_flag = F.coalesce("company_flag", *flags[:len(of_text)], "_table_cap_flag", *flags[len(of_text):])
    out_flag = F.coalesce(*[
        F.when(F.col("_out") == r.rule_id, r.flag) for r in _of_kind(config, cf.DISQUALIFY)
    ], F.col("_table_out_flag"))
    rows = rows.withColumns({"_cap": cap, "_cap_flag": cap_flag, "_out_flag": out_flag})
    zero = F.col("_out").isNotNull() | (F.col("_cap") == 0)
    flagged = F.col("_cap_flag").isNotNull() | F.col("_note").isNotNull()
    score = F.when(zero, 0).otherwise(F.greatest(F.lit(0), F.least("_points", "_cap"))).cast("int")
    scored = rows.withColumn("score", score).withColumns({
        "verdict": F.when(zero, "EXCLUDED").when(flagged, "FLAGGED").otherwise(band(F.col("score"))),
        "flag": F.coalesce("_out_flag", "_cap_flag", "_note", F.lit("")),
        "reason": F.when(F.col("_out").isNotNull(), F.concat(F.lit("disqualified: "), "_out"))
        .when(zero, "disqualified: company")
        .when(F.col("_cap") < F.col("_points"), F.concat(F.lit("capped at "), F.col("_cap").cast("string")))
        .otherwise(F.concat(F.lit("rule points: "), F.col("_points").cast("string"))),
    })
    return scored.select(*df.columns, "score", "verdict", "flag", "reason")


def _no_table_rules() -> dict[str, Column]:
    """What a run without a rule table has in place of ``rule_tables.folded``."""
    none = F.lit(None)
    return {"out": none.cast("string"), "out_flag": none.cast("string"), "note": none.cast("string"), "points": F.lit(0),
            "cap": none.cast("int"), "cap_flag": none.cast("string")}


def load_rules(table: DataFrame, limit: int = 1000) -> tuple[Rule, ...]:
    """Rules of a table (see ``schema.RULES_SCHEMA``; unless and unless_pattern may be absent) as settings.

    Such rules become part of the plan, so their number is checked.  Rule tables
    of any length are given to ``score_by_rules`` as a table.
    """
    optional = [c for c in ("unless", "unless_pattern") if c in table.columns]
    columns = ("rule_order", "rule_id", "kind", "scope", "match", "keyword", "value", "flag", *optional)
    rows = table.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rule rows: give the table itself to score_by_rules")
    grouped: dict[tuple, list] = {}
    for row in sorted(rows, key=lambda r: (r["rule_order"], r["rule_id"], r["keyword"])):
        head = (row["rule_id"], row["kind"], row["scope"], row["match"], row["value"] or 0, row["flag"] or "")
        grouped.setdefault(head, []).append(row.asDict())
    return tuple(
        Rule(rule_id, kind, scope, match, tuple(r["keyword"] for r in same), value, flag,
             tuple(dict.fromkeys(w for r in same for w in r.get("unless") or ())),
             next((r["unless_pattern"] for r in same if r.get("unless_pattern")), ""))
        for (rule_id, kind, scope, match, value, flag), same in grouped.items()
    )
