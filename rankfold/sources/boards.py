"""Company boards: landed JSON payloads to posting rows.

The title gate runs on the extracted title, before any HTML is parsed.
A payload that does not parse yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold import schema as sc
from rankfold.config import SearchConfig
from rankfold.functions import text as tx
from rankfold.functions.dates import epoch_ms_to_iso
from rankfold.functions.html import html_to_text
from rankfold.functions.json import json_value, with_json, with_object
from rankfold.operators.ranking import lowest_ok_host
from rankfold.schema import canonical, each_item
from rankfold.session import cut_lineage


def _gate(title: Column, config: SearchConfig) -> Column:
    return tx.title_class(title, config.seniority_words, config.other_role_words, config.wanted_role_words)


def object_items(payloads: DataFrame, fields: str, array: str) -> DataFrame:
    """One row (item_pos, job) per item of the array under ``array`` of a JSON object."""
    kept = [c for c in payloads.columns if c != "payload"]
    parsed = with_object(payloads, F.col("payload"), fields)
    return each_item(parsed, kept, F.col("_object").getField(array), "item_pos", "job")


def list_items(payloads: DataFrame, array_type: str) -> DataFrame:
    """One row (item_pos, job) per item of a JSON array, bare or under ``data``; other shapes give none."""
    kept = [c for c in payloads.columns if c != "payload"]
    parsed = F.col("_json")
    items = F.coalesce(json_value(parsed, "", array_type), json_value(parsed, ".data", array_type))
    return each_item(with_json(payloads, F.col("payload")), kept, items, "item_pos", "job")


#: Column of markup that is still to become a description, and whether its entities are escaped.
MARKUP, ESCAPED = "markup", "markup_escaped"


def with_markup(postings: DataFrame, markup: Column | None = None, escaped: bool = False) -> DataFrame:
    """Postings with the two columns that ``described`` resolves; without markup they are null."""
    own = F.lit(None).cast("string") if markup is None else markup
    return postings.withColumns({MARKUP: own, ESCAPED: F.lit(escaped)})


def described(postings: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Descriptions from the markup of rows that have some; null markup never reaches the parser."""
    markup, escaped = F.col(MARKUP), F.col(ESCAPED)
    text = F.coalesce(html_to_text(F.when(escaped, markup), escaped=True), html_to_text(F.when(~escaped, markup)))
    whole = F.when(markup.isNotNull(), tx.cut(F.coalesce(text, F.lit("")), config.description_chars)).otherwise(F.col("description"))
    return postings.withColumn("description", whole).drop(MARKUP, ESCAPED)


def board_a_postings(payloads: DataFrame, source_rank: int, config: SearchConfig = SearchConfig(), late: bool = False) -> DataFrame:
    """Boards answering ``{jobs: [...]}`` with escaped HTML content.

    ``late`` leaves the markup to ``described``, so that rows which go before then are never parsed.
    """
    items = object_items(payloads.select("slug", "board_rank", "payload"), sc.BOARD_A_PAYLOAD, "jobs").filter(
        _gate(F.col("job.title"), config))
    rows = items.select(
        F.coalesce("job.company_name", "slug").alias("company"),
        F.col("job.title").alias("role"),
        F.col("job.location.name").alias("location"),
        F.col("job.absolute_url").alias("url"),
        F.col("job.updated_at").alias("posted"),
        F.lit("").alias("description"),
        F.lit(fv.BOARD_A).alias("source"),
        F.lit(source_rank).alias("source_rank"), "board_rank", "item_pos",
        F.coalesce(F.col("job.content"), F.lit("")).alias(MARKUP),
    )
    marked = with_markup(_canonical_with(rows), F.col(MARKUP), escaped=True)
    return marked if late else described(marked, config)


def _canonical_with(rows: DataFrame) -> DataFrame:
    """The posting schema with the markup beside it, in one projection."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in sc.TEXT_COLUMNS else F.col(c).cast(t).alias(c)
             for c, t in (*((c, "string") for c in sc.TEXT_COLUMNS), ("source_rank", "int"), ("board_rank", "bigint"), ("item_pos", "bigint"))]
    return rows.select(*texts, MARKUP)


def board_b_postings(payloads: DataFrame, source_rank: int, config: SearchConfig = SearchConfig(), late: bool = False) -> DataFrame:
    """Boards answering a bare array (or ``{data: [...]}``) with plain and HTML text; ``late`` as for the other kind."""
    items = list_items(payloads.select("slug", "board_rank", "payload"), sc.BOARD_B_POSTINGS).filter(
        _gate(F.col("job.text"), config))
    plain = F.coalesce(F.col("job.descriptionPlain"), F.lit(""))
    rows = items.select(
        F.coalesce(F.col("job.company"), tx.title_case(F.col("slug"))).alias("company"),
        F.col("job.text").alias("role"),
        F.col("job.categories.location").alias("location"),
        F.col("job.hostedUrl").alias("url"),
        epoch_ms_to_iso(F.col("job.createdAt")).alias("posted"),
        tx.cut(plain, config.description_chars).alias("description"),
        F.lit(fv.BOARD_B).alias("source"),
        F.lit(source_rank).alias("source_rank"), "board_rank", "item_pos",
        # only rows without plain text are parsed
        F.when(plain == "", F.coalesce(F.col("job.description"), F.lit(""))).alias(MARKUP),
    )
    marked = with_markup(_canonical_with(rows), F.col(MARKUP))
    return marked if late else described(marked, config)


def board_c_postings(captured: DataFrame, host_probes: DataFrame, source_rank: int,
                     config: SearchConfig = SearchConfig()) -> DataFrame:
    """Captured ``{jobPostings: [...]}`` answers; several per tenant, ordered by seq."""
    # saved: the join has an exchange on either side, so a tenant with many answers can be split;
    # answers of tenants without a host are not parsed
    hosts = cut_lineage(lowest_ok_host(host_probes))
    taken = captured.select("tenant", "board", "board_rank", "seq", "payload").join(hosts, "tenant")
    items = object_items(taken, sc.BOARD_C_PAYLOAD, "jobPostings").filter(_gate(F.col("job.title"), config))
    path = F.coalesce(F.col("job.externalPath"), F.lit(""))
    return canonical(items.select(
        tx.title_case(F.col("tenant")).alias("company"),
        F.col("job.title").alias("role"),
        F.col("job.locationsText").alias("location"),
        F.when(path == "", "").otherwise(
            F.format_string(fv.BOARD_C_LINK, "tenant", "host_no", "board", path)
        ).alias("url"),
        F.lit(fv.BOARD_C).alias("source"),
        F.lit(source_rank).alias("source_rank"), "board_rank",
        (F.shiftleft(F.col("seq").cast("bigint"), 32) + F.col("item_pos")).alias("item_pos"),
    ))


def board_a_count(parsed: Column, payload: Column) -> Column:
    """Number of jobs in a board's parsed answer; null when it is not an object."""
    is_object = json_value(parsed, "", "variant").isNotNull() & F.rlike(payload, F.lit(r"^\s*\{"))
    jobs = json_value(parsed, ".jobs", "array<variant>")
    return F.when(is_object, F.coalesce(F.size(jobs), F.lit(0)))


def board_b_count(parsed: Column) -> Column:
    """Number of postings when the parsed answer is a JSON array, else null."""
    items = json_value(parsed, "", "array<variant>")
    return F.when(items.isNotNull(), F.size(items))
