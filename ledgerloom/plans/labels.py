"""Label -> tag -> evaluate -> promote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import align, evaluate, labelling, tagging


def aligned_pages(tokens: DataFrame, txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aligned tokens and the alignment rate per page (``txns`` are label rows with ``page``)."""
    labels = txns.withColumnRenamed("page", "page_index")
    tagged = align.align_tokens(tokens, labels)
    counts = labels.groupBy("stem", "page_index").agg(F.count(F.lit(1)).alias("n_txns"))
    return tagged, tagging.alignment_rate(tagged, counts)


def alignment_summary(rates: DataFrame) -> DataFrame:
    return labelling.alignment_stats(rates)


def evaluation(tokens: DataFrame, truth: DataFrame, true: str = "true_tag", pred: str = "pred_tag") -> DataFrame:
    """Entity and transaction scores against their targets."""
    strict = tagging.decode_strict(tokens.withColumn("tag", F.col(pred)))
    scores = evaluate.transaction_scores(evaluate.match_counts(strict, truth))
    return evaluate.target_report(evaluate.entity_report(tokens, true, pred), scores)
