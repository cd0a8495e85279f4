"""Places as data: words of a location meet a table of place names on equality.

A location's runs of up to as many words as the longest name are looked up; where
matches lie within a longer one, the longest counts ("New Mexico", not "Mexico").
Names of the home country and, at the end of a location, codes of its states
outweigh foreign names ("Paris, TX").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold import fixed_values as fv
from rankfold.functions.text import strip_space
from rankfold.schema import PLACES_SCHEMA, each_item, local_table, text_or_empty
from rankfold.session import cut_lineage

HOME_NAMES = ("us", "usa", "u.s", "u.s.a", "united states", "new mexico")
_WORDS = r"[\p{L}\p{N}]+"
#: A code after the last comma, a postal code may follow.
_ENDING = r",\s*(\p{L}+)(?:\s+[0-9]{5})?$"


def default_places(spark: SparkSession) -> DataFrame:
    """The rubric's foreign places, countries and cities, and the home country's names and state codes."""
    abroad = dict.fromkeys((*fv.FOREIGN_PLACES, *cf.COUNTRIES, *cf.CITIES))
    rows = [(n, True, False) for n in abroad] + [(n, False, False) for n in HOME_NAMES] + [(c, False, True) for c in cf.US_STATE_CODES]
    return local_table(spark, rows, PLACES_SCHEMA)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0))


def _named(places: DataFrame) -> DataFrame:
    """Names as words with one blank between them; a name given as both abroad and home is home."""
    names = places.select(F.array_join(words_of(F.col("name")), " ").alias("name"), "abroad", F.coalesce("ending", F.lit(False)).alias("ending"))
    return names.filter("name <> ''").groupBy("name", "ending").agg(F.bool_and("abroad").alias("abroad"))


def place_matches(locations: DataFrame, places: DataFrame) -> DataFrame:
    """location, at, size, name, abroad: names found in distinct locations, those within longer ones left out.

    ``at`` is null for the code at the end.
    """
    names = cut_lineage(_named(places))
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1   # words of a name: a bound of the table, not of the rows
    words = each_item(locations.withColumn("_words", words_of(F.col("location"))), ["location", "_words"],
                      F.sequence(F.lit(1), F.size("_words")), "_nth", "at").filter("size(_words) > 0")
    runs = words.select("location", "at", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(longest), F.size("_words") - F.col("at") + 1))).alias("size"), "_words")
    runs = runs.select("location", "at", "size", F.array_join(F.slice("_words", F.col("at"), F.col("size")), " ").alias("name"))
    met = runs.join(names.filter("NOT ending").drop("ending"), "name")
    # within a longer one: something that begins no later ends no earlier
    before = Window.partitionBy("location").orderBy("at", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_reached", F.max(F.col("at") + F.col("size")).over(before))
    met = met.filter("_reached IS NULL OR at + size > _reached").select("location", "at", "size", "name", "abroad")
    code = F.regexp_extract(F.lower(strip_space(F.col("location"))), _ENDING, 1)
    ends = locations.select("location", F.lit(None).cast("int").alias("at"), F.lit(1).alias("size"), code.alias("name"))
    return met.unionByName(ends.join(names.filter("ending").drop("ending"), "name").select("location", "at", "size", "name", "abroad"))


def with_foreign(df: DataFrame, places: DataFrame | None = None, location: str = "location") -> DataFrame:
    """Adds place (the first foreign name, or null) and is_foreign: a foreign name and none of the home country.

    Distinct locations are looked up; the outcome is saved, so its size decides how it is joined.
    """
    places = default_places(df.sparkSession) if places is None else places
    distinct = df.select(text_or_empty(F.col(location)).alias("location")).distinct()
    found = place_matches(distinct, places).groupBy("location").agg(
        F.min_by(F.when(F.col("abroad"), F.col("name")), F.when(F.col("abroad"), F.struct("at", "size"))).alias("place"),
        F.coalesce(F.bool_or(~F.col("abroad")), F.lit(False)).alias("_home"))
    found = cut_lineage(found.withColumnRenamed("location", "_location"))
    joined = df.join(found, text_or_empty(F.col(location)) == F.col("_location"), "left")
    return joined.withColumn("is_foreign", F.col("place").isNotNull() & ~F.coalesce("_home", F.lit(False))).select(*df.columns, "place", "is_foreign")
