"""The corpus pipeline: five stages from raw documents to encoded text.

1. Language ID rejects documents that are in none of the learned languages.
2. Line dedup deletes later repeats of runs of lines, and documents of which no word stays.
3. SimHash near-dedup keeps one document of each group linked at similarity 0.8 of five-word shingles.
4. Mixing takes sources to their target weights: documents repeat or go, and a source's last one is cut.
5. SentencePiece encoding gives each document's ids, its next best segmentations, and checks that they decode.

Every stage works on all rows its predecessor kept. Stages 1 to 4 return the columns they were given; ``n_chars``,
where it is there, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language, lines, mixing, pieces, similar
from ledgerloom.llm.common import materialise

PIECE_MODEL = "piece_bpe_32k.model"
#: Units a worker remembers in the last stage; its process may still hold what earlier stages learned.
REMEMBERED = 500_000


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(lines.without_repeats(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(mixing.mixed_documents(docs))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), remembered=REMEMBERED)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage),
          ("mixing", mix_stage), ("sentencepiece", encode_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each but the last is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
