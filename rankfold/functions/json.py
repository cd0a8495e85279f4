"""JSON text as a whole.

Spark's JSON readers stop after the first value and ignore what follows it.
Wrapping the text in brackets makes anything but exactly one value detectable.
Parsing is a step of its own (``with_json``), so that reading several fields
from the result does not parse the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrapped(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def with_json(df: DataFrame, text: Column, name: str = "_json") -> DataFrame:
    """Adds the parsed text, null when it is not JSON; to be read with ``json_value``."""
    return df.withColumn(name, F.try_parse_json(_wrapped(text)))


def json_value(parsed: Column, path: str, data_type: str) -> Column:
    """A field ('' is the value itself); null unless the text was one JSON value."""
    single = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(parsed, f"$[0]{path}", data_type))


def with_object(df: DataFrame, text: Column, fields: str, name: str = "_object") -> DataFrame:
    """Adds a struct of the object's fields (DDL), null unless the text is one JSON value."""
    values = df.withColumn("_values", F.from_json(_wrapped(text), f"ARRAY<STRUCT<{fields}>>"))
    single = F.when(F.size("_values") == 1, F.get(F.col("_values"), F.lit(0)))
    return values.withColumn(name, single).drop("_values")
