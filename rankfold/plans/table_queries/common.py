"""Helpers of the table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankfold.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows are costly to process, over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def quoted(words) -> str:
    """A SQL list of string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted([w])})" for w in words) + ")"


def sql_has_word(column: str, words) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])')"


# Visible text of the given pages in SQL: hidden elements and comments go, every
# tag splits text, lines are stripped and blank ones dropped.
# An entity may lack its semicolon (cut titles); '&' comes last, so nothing is resolved twice.
_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("amp", "&"))


def sql_visible_text(html: str) -> str:
    text = html
    for name in ("script", "style", "nav", "header", "footer", "aside"):
        text = f"regexp_replace({text}, '(?s)<{name}[ >].*?</{name}>', chr(10), 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', chr(10), 'g')"
    for entity, char in _ENTITIES:
        text = f"regexp_replace({text}, '&{entity}(?:;|($|[^a-zA-Z0-9;]))', '{char}\\1', 'g')"
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(160)))"
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"
