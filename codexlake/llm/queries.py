"""The pipeline operators as queries over the driver tables; ``sql`` has the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .sql import ORACLE_SQL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: the number of ids, their crc32, and whether the text came back."""
    from .sentencepieces import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode(docs, PIECES, decoded="decoded")
    # The model reads the mark itself as a blank.
    back = F.col("decoded") == F.translate(F.col("text"), "\u2581", " ")
    return rows.select(
        "doc_id", F.coalesce("ids_n", F.lit(0)).alias("n_pieces"), F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"),
        F.coalesce(back, F.col("text").isNull()).alias("round_trip"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents")
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_rejected")


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return rows.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencounts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    rows = scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line", "license", "reduction", "similarity", "exact", "inserted", "deleted")


def op10_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_toxicity_ftrl": op5_toxicity_ftrl,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pack_nnls": op10_pack_nnls,
}
