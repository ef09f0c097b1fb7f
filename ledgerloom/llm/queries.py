"""One query per operator of this package, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (bpe, chat, language, lines, mixing, pieces, projections, search, sharding, simhash,
                            token_files, trie, whitening)
from ledgerloom.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that repeat."""
    return lines.line_report(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back."""
    import public_tokenizers

    return token_files.token_file_report(spark, read(spark, sf_dir, "documents"),
                                         public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best piece segmentations of every document."""
    import public_tokenizers

    return pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations."""
    return chat.chat_report(spark, read(spark, sf_dir, "conversations"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors of every fiftieth."""
    rows = read(spark, sf_dir, "embeddings")
    return search.search(rows, F.col("vec_id") % 50 == 0)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return projections.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the ranks of a byte-level vocabulary, and what they decode to."""
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 whitened components of every vector."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op10_sharding": op10_sharding,
    "op9_sentencepiece": op9_sentencepiece,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op2_topk_search": search.ORACLE,
    "op3_embedding_near_dedup": projections.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op12_conversation_trie": trie.ORACLE,
}
