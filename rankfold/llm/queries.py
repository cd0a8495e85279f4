"""The operators of this subpackage over the given tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import (
    chat_format, language_id, merkle, mixing, packing, sentencepiece_lattice, shared_passages, sharding, simhash,
    spelling, spotsigs, suffix_dedup, token_counts, topk_search,
)
from rankfold.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    first = F.round(F.get(F.col("positions"), F.lit(0)), 6).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = sentencepiece_lattice.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    codec = sentencepiece_lattice.codec_for(documents, vocabulary)
    encoded = codec.encode(documents, decoded="decoded")
    whole = F.coalesce("text", F.lit(""))
    return encoded.select(
        "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == whole).alias("round_trip"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    dictionaries = language_id.fit(documents)
    found = language_id.identify(documents.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        "margin", "rejected")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = spotsigs.compare_neighbours(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("signatures"), F.col("edited_signatures"), F.col("next_signatures")
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", spotsigs.fingerprint(own).alias("fingerprint"),
        spotsigs.fingerprint(edited).alias("edited_fingerprint"),
        spotsigs.pruned_jaccard(own, edited).alias("near_edited"), spotsigs.pruned_jaccard(own, following).alias("near_next"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), sharing=shared_passages.sharing_texts)
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("f")).alias("fingerprint"), "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(documents, tokenizer_path("byte_bpe_50k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.manifest(_table(spark, sf_dir, "documents"))
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_sharding": op2_sharding,
    "op3_source_mixing": op3_source_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_spotsigs": op6_spotsigs,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_chat_format": op10_chat_format,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": topk_search.sql(),
    "op3_source_mixing": mixing.sql(),
    "op6_spotsigs": spotsigs.sql(),
    "op10_chat_format": chat_format.sql(),
    "op12_merkle": merkle.sql(),
    "op13_spelling": spelling.sql(),
}
