"""The corpus pipeline: five stages over documents, each applied to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet in the shared folder and reads again for the next stage.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import language_id, mixing, sentencepiece_lattice, shared_passages, simhash, suffix_dedup
from rankfold.llm.queries import tokenizer_path
from rankfold.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the dictionaries are fitted on the labelled documents themselves."""
    found = language_id.identify(docs, language_id.fit(docs))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of SimHash fingerprints (four-word shingles, links of at most 4 bits): the smallest id's."""
    return simhash.keep_first_of_components(docs).select(*COLUMNS)


def without_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat: strings of 400 bytes, and runs of 50 words that another document has too.

    Documents that lose all of a text that was not empty go, blanks between what was cut included.
    """
    cut = suffix_dedup.remove_repeats(docs, keep=COLUMNS, passages=shared_passages.passage_spans)
    cut = cut.filter((F.col("n_removed") == 0) | F.rlike("kept_text", F.lit(r"[^\x20\x09-\x0D]")))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per copy, in the order of training."""
    mixed = mixing.mix(docs, keep=COLUMNS, saved=False, ordered=False)
    return mixing.training_order(mixed, COLUMNS).select(*COLUMNS)


def encoded_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of pieces, their ids, and whether they decode to the text."""
    vocabulary = sentencepiece_lattice.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    codec = sentencepiece_lattice.codec_for(docs, vocabulary)
    encoded = codec.encode(docs, decoded="decoded")
    whole = F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
                          (F.col("decoded") == whole).alias("round_trip"))


STAGES = [
    ("language_id", identified_language),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_long_repeats),
    ("source_mixing", mixed_sources),
    ("sentencepiece", encoded_texts),
]

#: Compression, SimHash and the lattice are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
