"""Scorer prompts and scorer replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions.json import json_value, with_json
from rankfold.schema import text_or_empty

REPLY_SCHEMA = "STRUCT<score: INT, reason: STRING, verdict: STRING, flag: STRING>"


def fill_profile(template: Column, profile: str | Column) -> Column:
    value = F.lit(profile) if isinstance(profile, str) else profile
    return F.replace(template, F.lit("{profile}"), value)


def scoring_prompt(role: Column, company: Column, location: Column, description: Column) -> Column:
    """The text a caller-supplied model scorer is asked to judge."""
    body = text_or_empty(description)
    return F.concat(
        F.lit("Job to evaluate:\nTitle: "), text_or_empty(role),
        F.lit("\nCompany: "), text_or_empty(company),
        F.lit("\nLocation: "), text_or_empty(location),
        F.lit("\nDescription: "),
        F.when(body == "", F.lit(fv.NO_DESCRIPTION_TEXT)).otherwise(body),
    )


def strip_code_fence(reply: Column) -> Column:
    opened = F.regexp_replace(reply, r"(?U)^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"(?U)\s*```$", "")


def with_reply(df: DataFrame, reply: Column, name: str = "reply_record") -> DataFrame:
    """Adds a (score, reason, verdict, flag) struct; anything unusable gives the error record.

    An absent score counts as 0, a null or non-integer text score is an error.
    Other null fields count as absent.
    """
    span = F.regexp_extract(strip_code_fence(text_or_empty(reply)), r"(?s)\{.*\}", 0)
    parsed = F.col("_json")

    def text_field(field: str) -> Column:
        return text_or_empty(json_value(parsed, f".{field}", "string"))

    no_score = json_value(parsed, ".score", "variant").isNull()
    is_object = json_value(parsed, "", "variant").isNotNull()
    score = F.when(no_score, 0).otherwise(json_value(parsed, ".score", "int"))
    flag = text_field("flag")
    good = F.struct(
        score.alias("score"), text_field("reason").alias("reason"),
        text_field("verdict").alias("verdict"),
        F.when(F.lower(flag) == "null", "").otherwise(flag).alias("flag"),
    )
    error = F.struct(
        F.lit(0).alias("score"), F.lit(fv.REPLY_ERROR_REASON).alias("reason"),
        F.lit("EXCLUDED").alias("verdict"), F.lit(fv.REPLY_ERROR_FLAG).alias("flag"),
    )
    record = F.when(is_object & score.isNotNull(), good).otherwise(error).cast(REPLY_SCHEMA)
    return with_json(df, span).withColumn(name, record).drop("_json")
