"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with labelled
texts.  A text, in lower case like the dictionaries, is compressed against each
of them, window by window so that its own history does not hide what the
dictionary explains; the language with the smallest total wins, and a narrow
margin over the runner-up means rejection.

The dictionaries are fitted on a bounded sample (``TEXTS`` rows per language,
``SLICE`` characters of each); every text is classified whole.

Defined results: a text that is null or has no letter is ``und`` with score 0
and rejected; so is every text if nothing could be learned.  Ties go to the
language first in code point order.  Null ids and null languages teach nothing.
Repeated rows give repeated rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Rows per language that fill a dictionary, and characters taken of each.
TEXTS, SLICE = 400, 280
#: Shares of a language whose sample is drawn apart, so that no task sees more than this many samples.
SHARES = 16
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 112 * 1024
#: Bytes of a text compressed at once.
WINDOW = 1024
LEVEL = 6
#: Scale of the relative size differences that turn into a score.
TEMPERATURE = 0.02
#: A winner must be smaller than the runner-up by this part of its size.
MIN_MARGIN = 0.001


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        texts: int = TEXTS, characters: int = SLICE) -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample of the rows not held out.

    The sample is the ``texts`` rows of a language whose ids have the smallest
    hashes, so it is the same in every run; at most ``characters`` of each, from
    a place given by the hash.
    """
    rows = labelled.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    # first within shares of a language, however many tasks there are, then among what the shares have left
    own, whole = Window.partitionBy("l", "share").orderBy("h", "i"), Window.partitionBy("l").orderBy("h", "i")
    chosen = rows.select("i", "l", F.xxhash64(F.col("i").cast("string")).alias("h"), F.pmod(F.hash("i"), F.lit(SHARES)).alias("share"))
    for order in (own, whole):
        chosen = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= texts)
    chosen = chosen.select("i", "l", "h").distinct()
    # only the slice of a text that would be taken goes through the join
    h = F.xxhash64(F.col("i").cast("string"))
    room = F.greatest(F.length("t") - characters, F.lit(0)) + 1
    start = F.pmod(h, room.cast("long")).cast("int") + 1
    slices = rows.select("l", "i", F.substring("t", start, F.lit(characters)).alias("t"))
    sample = slices.join(chosen, ["i", "l"]).dropDuplicates(["l", "i"])
    found: dict[str, list[tuple]] = {}
    for row in sample.collect():
        found.setdefault(row["l"], []).append((row["h"], row["i"], row["t"]))
    return {name: "\n".join(t for _, _, t in sorted(found[name])).lower().encode()[-DICTIONARY_BYTES:]
            for name in sorted(found)}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, write_checksum=False, write_content_size=False, write_dict_id=False)
    made = []
    for _, content in dictionaries:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary))
    return made


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole of ``data`` in windows of nearly equal length."""
    count = max(1, -(-len(data) // size))
    return [data[len(data) * i // count:len(data) * (i + 1) // count] for i in range(count)]


def _classify(data: bytes, names: list[str], compressors: list) -> tuple[str, float, float]:
    pieces = windows(data)
    sizes = [sum(len(c.compress(piece)) for piece in pieces) for c in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = [s for i, s in enumerate(sizes) if i != best]
    margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
    score = 1 / (1 + sum(math.exp(-(s - sizes[best]) / sizes[best] / TEMPERATURE) for s in others))
    return names[best], score, margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
             min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """Adds lang_pred, score (0 to 1), margin and rejected; columns of these names are replaced."""
    known = tuple(sorted(dictionaries.items()))
    names = [name for name, _ in known]

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(known, level)
        for batch in batches:
            found = [(UNKNOWN, 0.0, 0.0) if t is None or not names else _classify(t.lower().encode(), names, compressors)
                     for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "margin"])

    readable = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    held = "_language" + "_" * max(map(len, df.columns))   # longer than any name of the table
    found = df.withColumn(held, predict(readable))
    for name in ("lang_pred", "score", "margin"):
        found = found.withColumn(name, F.col(f"{held}.{name}"))
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin)
    return found.withColumn("rejected", rejected).drop(held)
