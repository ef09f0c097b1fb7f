"""Label coverage, review and alignment statistics (AGG11-AGG15, AGG17, JOI1, JOI11, WIN6, WIN10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scale import previous_value

PRICE_SEQUENTIAL = 0.003
PRICE_PARALLEL = 0.025


def labelling_progress(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled and total statements and pages (AGG11)."""
    def count(df: DataFrame, tag: str) -> DataFrame:
        per_stem = df.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
        return per_stem.agg(F.count(F.lit(1)).alias(f"{tag}_pdfs"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{tag}_pages"),
                            F.lit(1).alias("_one"))
    return count(labels, "labeled").join(F.broadcast(count(pages, "total")), "_one").drop("_one")


def review_stats(pages: DataFrame) -> DataFrame:
    """Review counts, mean alignment and pages below 90 % (AGG12)."""
    rate = F.coalesce("alignment_rate", F.lit(0.0))
    done = F.coalesce("reviewed", F.lit(False))
    return pages.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("reviewed"),
        F.count_if(done & (F.col("review_status") == "accepted")).alias("accepted"),
        F.count_if(done & (F.col("review_status") == "rejected")).alias("rejected"),
        F.count_if(~done).alias("unreviewed"), F.coalesce(F.avg(rate.cast("decimal(10,3)")).cast("double"), F.lit(0.0)).alias("avg_alignment"),
        F.count_if(rate < 90).alias("below_90")).withColumn("reviewed_pct", F.coalesce(F.try_divide(F.col("reviewed"), F.col("total")) * 100, F.lit(0.0)))


def alignment_stats(pages: DataFrame) -> DataFrame:
    """Aligned share per statement and overall (null stem) with the page mean and a warning (AGG13).

    ``pages``: ``stem, aligned, total, alignment_rate``.
    """
    rate = F.when(F.col("n_txns") > 0, F.bround(F.col("aligned") / F.col("n_txns") * 100, 1)).otherwise(0.0)
    return (pages.rollup("stem").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("aligned").alias("aligned"), F.sum("total").alias("n_txns"),
        F.bround(F.avg(F.col("alignment_rate").cast("decimal(10,3)")), 1).cast("double").alias("page_rate"))
        .withColumn("rate", rate).withColumn("warning", F.col("rate") < 90))


def labelling_run(pages: DataFrame, price: float = PRICE_SEQUENTIAL) -> DataFrame:
    """Work left, estimated cost, errors and transactions of a labelling run (AGG14)."""
    todo = F.count_if(~F.col("labelled"))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), todo.alias("to_label"), (todo * F.lit(price)).alias("est_cost"),
        F.count_if(F.col("labelled") & F.col("parse_error")).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("labelled"), F.col("n_txns"))), F.lit(0)).alias("transactions"))


def sample_coverage(sample: DataFrame) -> DataFrame:
    """Files and pages per bank and in total (null bank), with the banks covered (AGG15)."""
    per_bank = sample.groupBy("bank").agg(F.count(F.lit(1)).alias("pdfs"), F.sum("pages").alias("pages"))
    return per_bank.rollup("bank").agg(F.sum("pdfs").alias("pdfs"), F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("banks"))


def class_balance(samples: DataFrame) -> DataFrame:
    """Credit and debit counts and the positive weight of debits (AGG17)."""
    return samples.agg(F.count_if(F.col("type") == "credit").alias("credit"), F.count_if(F.col("type") == "debit").alias("debit")).withColumn(
        "pos_weight", F.col("credit") / F.greatest("debit", F.lit(1)))


def label_source(source: Column) -> Column:
    """Where a label came from; unnamed ones are from the vision labeller (JSN5)."""
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("claude"))


def words_with_labels(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages that have both a word file and a label file (JOI1)."""
    return words.join(labels, ["stem", "page_index"])


def page_for_labelling(pages: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Transactions to show per page: existing label, else model, else nothing (JOI11).

    ``labels`` and ``predictions``: ``stem, page_index, transactions``.
    """
    keys = ["stem", "page_index"]
    joined = (pages.select(*keys).join(labels.select(*keys, F.col("transactions").alias("_l")), keys, "left")
              .join(predictions.select(*keys, F.col("transactions").alias("_p")), keys, "left"))
    has_label = F.col("_l").isNotNull()
    source = F.when(has_label, "existing_label").when(F.size(F.coalesce("_p", F.array())) > 0, "model").otherwise("empty")
    return joined.select(*keys, F.coalesce("_l", "_p", F.array().cast(labels.schema["transactions"].dataType)).alias("transactions"), source.alias("source"))


def open_statements(stems: DataFrame, banks: DataFrame, labelled: DataFrame) -> DataFrame:
    """Statements without a label, with their bank."""
    todo = stems.join(labelled.select("stem").distinct(), "stem", "left_anti")
    return todo.join(banks, "stem", "left").withColumn("bank", F.coalesce("bank", F.lit("Unknown")))


def labelling_queue(stems: DataFrame, banks: DataFrame, labelled: DataFrame, limit: int | None = None) -> DataFrame:
    """Unlabelled statements, rarest bank first; ``limit`` shows only the head of the queue (WIN6)."""
    named = open_statements(stems, banks, labelled)
    counted = named.join(named.groupBy("bank").agg(F.count(F.lit(1)).alias("bank_count")), "bank").orderBy("bank_count", "stem")
    return counted.limit(limit) if limit else counted


def queue_totals(stems: DataFrame, banks: DataFrame, labelled: DataFrame) -> DataFrame:
    """Open statements per bank and in total (null bank) (WIN6)."""
    return open_statements(stems, banks, labelled).rollup("bank").agg(F.count(F.lit(1)).alias("open_statements"))


def next_unlabelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Next page without a label after each page of a statement (WIN10)."""
    keys = ["stem", "page_index"]
    marked = pages.select(*keys).join(labels.select(*keys, F.lit(True).alias("_done")), keys, "left")
    # Nearest later open page: the nearest earlier one when the order is turned around.
    turned = marked.withColumn("_open", F.when(F.col("_done").isNull(), F.col("page_index"))).withColumn(
        "_back", -F.col("page_index"))
    return previous_value(turned, ["stem"], "_back", "_open", "next_page").select(*keys, "next_page")
