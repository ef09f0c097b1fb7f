"""Feedback records, logs, readiness and parser comparison (AGG8-AGG10, JOI8-JOI10, WIN9, WIN11, WIN12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx


def flagged_details(txns: DataFrame) -> DataFrame:
    """Every low-confidence transaction (AGG8), one row each, with its whole description."""
    return txns.filter(F.coalesce("confidence", F.lit(1.0)) < lx.LOW_TXN_CONFIDENCE).select(
        "stem", "seq", "page", "description", "confidence")


def feedback_records(txns: DataFrame, pages: DataFrame, banks: DataFrame) -> DataFrame:
    """One record per statement that has a low-confidence transaction or page (AGG8).

    ``pages``: ``stem, page_count, n_low_pages``; ``banks``: ``stem, bank``. The flagged transactions and the low
    pages themselves are tables (``flagged_details``, ``tagging.page_confidence``), so a record never grows.
    """
    conf = F.coalesce("confidence", F.lit(1.0))
    mean = F.avg(F.coalesce("confidence", F.lit(0.0)).cast("decimal(18,9)"))
    totals = txns.groupBy("stem").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(conf < lx.LOW_TXN_CONFIDENCE).alias("flagged_transactions"), F.bround(mean, 4).cast("double").alias("avg_confidence"))
    joined = pages.join(totals, "stem", "left").join(banks, "stem", "left")
    return (joined.withColumn("flagged_transactions", F.coalesce("flagged_transactions", F.lit(0)))
            .filter((F.col("flagged_transactions") > 0) | (F.col("n_low_pages") > 0))
            .select("stem", F.coalesce("bank", F.lit("unknown")).alias("bank_format"), "page_count",
                    F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"), "flagged_transactions", "n_low_pages",
                    F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence")))


def flagged_by_bank(records: DataFrame) -> DataFrame:
    """Flagged statements and mean confidence per bank, least confident first (AGG9)."""
    mean = F.avg(F.coalesce("avg_confidence", F.lit(0.0)).cast("decimal(18,9)"))
    return (records.groupBy("bank_format").agg(F.count(F.lit(1)).alias("n"), F.bround(mean, 4).cast("double").alias("bank_confidence"))
            .orderBy("bank_confidence", "bank_format"))


def flagged_members(records: DataFrame) -> DataFrame:
    """Every flagged statement with its bank's figures (AGG9).

    The member list stays a table: one array per bank would put a common bank into one row.
    The joined side has one row per value of ``bank_format``; its size is left to the optimizer.
    """
    return records.join(flagged_by_bank(records), "bank_format").select(
        "bank_format", "n", "bank_confidence", "stem", "flagged_transactions", "total_transactions", "avg_confidence")


def retrain_readiness(labels: DataFrame, training: DataFrame, flagged: DataFrame, min_pages: int = lx.MIN_PAGES_FOR_RETRAIN) -> DataFrame:
    """Counts that decide whether a retraining run is due (AGG10).

    ``labels`` and ``training``: ``stem, page_index``; ``flagged``: one row per flagged statement.
    """
    auto = labels.filter(F.col("stem").startswith("auto_"))
    # Page counts per stem first, so the distinct stem count needs no second pass over pages.
    per_stem = auto.groupBy("stem").agg(F.count(F.lit(1)).alias("pages"))
    trained = training.groupBy("stem").agg(F.count(F.lit(1)).alias("trained"))
    stems = trained.join(per_stem, "stem", "full_outer").agg(
        F.count("pages").alias("auto_labeled_pdfs"), F.coalesce(F.sum("pages"), F.lit(0)).alias("auto_labeled_pages"),
        F.coalesce(F.sum(F.when(F.col("pages").isNotNull(), F.col("trained"))), F.lit(0)).alias("auto_aligned_pages"),
        F.coalesce(F.sum("trained"), F.lit(0)).alias("total_training_pages"), F.lit(1).alias("_one"))
    n_flagged = flagged.agg(F.count(F.lit(1)).alias("flagged_pdfs"), F.lit(1).alias("_one"))
    return stems.join(F.broadcast(n_flagged), "_one").drop("_one").withColumn(
        "ready_for_retrain", F.col("auto_labeled_pages") >= min_pages)


def log_query(log: DataFrame, deal_id=None, method: str | None = None, limit: int = 50) -> DataFrame:
    """Newest log rows with optional filters (WIN9)."""
    for column, value in (("deal_id", deal_id), ("method", method)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    return log.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def corrected_rows(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that carry human corrections, newest first: all of them, as they feed training, or the first few (WIN9)."""
    rows = log.filter("corrected").orderBy(F.desc("created_at"), F.desc("event_id"))
    return rows.limit(limit) if limit else rows


def shadow_comparison(log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest shadow runs next to the serving parser (JOI9)."""
    rows = log.filter(F.col("shadow_method").isNotNull()).orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    return rows.select("event_id", "deal_id", "method", F.col("transaction_count").alias("ml_transactions"),
                       F.col("shadow_transaction_count").alias("other_transactions"),
                       (F.col("transaction_count") - F.col("shadow_transaction_count")).alias("txn_diff"),
                       F.col("total_deposits").alias("ml_deposits"), F.col("shadow_total_deposits").alias("other_deposits"),
                       F.bround(F.col("total_deposits") - F.col("shadow_total_deposits"), 2).alias("deposit_diff"), "processing_time_ms")


def percent_diff(a: Column, b: Column) -> Column:
    return (F.when((a == 0) & (b == 0), "0%").when(b == 0, "N/A")
            .otherwise(F.concat(F.bround((a - b) / F.abs(b) * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))))


def compare_parsers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two parsers' statement totals side by side (JOI8).

    Both: ``stem, n, income, expenses, time_ms``. Counts match when equal, money when closer than 1.
    """
    measures = ("n", "income", "expenses", "time_ms")
    sides = [df.select("stem", *[F.col(m).alias(f"{m}_{tag}") for m in measures]) for df, tag in ((left, "a"), (right, "b"))]
    joined = sides[0].join(sides[1], "stem", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = joined.select("stem", *[zero(f"{m}_{t}").alias(f"{m}_{t}") for m in measures for t in "ab"])
    out = joined
    for m in ("n", "income", "expenses"):
        out = out.withColumn(f"{m}_diff", F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")))
    return (out.withColumn("n_match", F.col("n_diff") == 0).withColumn("income_match", F.col("income_diff") < 1)
            .withColumn("expenses_match", F.col("expenses_diff") < 1)
            .withColumn("income_pct", percent_diff(F.col("income_a"), F.col("income_b"))))


def compare_summaries(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A summary table of two parsers side by side, with differences; what one lacks counts as zero (JOI8)."""
    sides = [df.select(*keys, *[F.col(m).alias(f"{m}_{tag}") for m in measures]) for df, tag in ((left, "a"), (right, "b"))]
    joined = sides[0].join(sides[1], keys, "full_outer")
    zeros = {f"{m}_{t}": F.coalesce(f"{m}_{t}", F.lit(0)) for m in measures for t in "ab"}
    return joined.withColumns(zeros).withColumns({f"{m}_diff": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures})


def comparison_totals(compared: DataFrame) -> DataFrame:
    """Totals over all statements with the speed ratio (JOI8)."""
    totals = compared.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
                            ("n_a", "n_b", "income_a", "income_b", "expenses_a", "expenses_b", "time_ms_a", "time_ms_b")])
    return totals.withColumn("speed_ratio", F.bround(F.col("time_ms_b") / F.greatest("time_ms_a", F.lit(1)), 1))


def version_deltas(evaluations: DataFrame, force: bool = False) -> DataFrame:
    """Each model version against the one before, promoted unless its F1 is worse (JOI10).

    ``evaluations``: ``family, model_version, f1, txn_f1`` (few versions per family).
    """
    order = Window.partitionBy("family").orderBy("model_version")
    before, before_txn = F.lag("f1").over(order), F.lag("txn_f1").over(order)
    return evaluations.select(
        "family", "model_version", "f1", (F.col("f1") - before).alias("f1_delta"), (F.col("txn_f1") - before_txn).alias("txn_f1_delta"),
        (F.lit(force) | before.isNull() | (F.col("f1") >= before)).alias("promote"))


def route(key: Column, percent: int) -> Column:
    """Whether a request goes to the model: a stable share of keys, clamped to 0-100 (WIN11)."""
    share = max(0, min(100, percent))
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return bucket < share


def needs_fallback(low_pages: Column, page_count: Column) -> Column:
    """Whole statement re-parsed when more than half of its pages are low (WIN12)."""
    return F.size(low_pages) > page_count * 0.5
