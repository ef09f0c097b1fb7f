"""Spending summaries and statement metrics (AGG1-AGG7, SET5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import strip
from ledgerloom.operators.transactions import is_nsf

TOP_MERCHANTS = 15
MIN_CHART_POINTS = 5


def _dated(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("month_key") != "unknown")


def _sum_if(test: Column, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(amount))), F.lit(0).cast("decimal(28,2)"))


def _credit() -> Column:
    return F.col("type") == "credit"


def monthly_cashflow(enriched: DataFrame) -> DataFrame:
    """Income (credits), expenses (everything else), net and count per month (AGG1)."""
    return (_dated(enriched).groupBy("month_key")
            .agg(_sum_if(_credit()).alias("income"), _sum_if(~_credit()).alias("expenses"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("net", F.col("income") - F.col("expenses")))


def category_totals(enriched: DataFrame) -> DataFrame:
    """Expenses per category with their share in percent (AGG2)."""
    totals = (_dated(enriched).filter(~_credit()).groupBy("category")
              .agg(F.sum("amount").alias("total")))
    # One row per category by now: the whole-table window sees at most ten rows.
    grand = F.sum("total").over(Window.partitionBy())
    share = F.col("total").cast("double") / grand.cast("double") * 100
    return totals.withColumn("share", F.when(grand != 0, share).otherwise(0.0))


def daily_balances(enriched: DataFrame) -> DataFrame:
    """Last known balance per date, in file, page and position order (AGG3)."""
    return (_dated(enriched).filter(F.col("balance_after").isNotNull() & F.col("parsed_date").isNotNull())
            .groupBy("parsed_date")
            .agg(F.max_by("balance_after", F.struct("source_file", "page", "seq")).alias("balance")))


def balance_chart(enriched: DataFrame, points: int = MIN_CHART_POINTS) -> DataFrame:
    """Daily balances and whether there are enough days for a chart (``chart``)."""
    days = daily_balances(enriched).withColumn("_one", F.lit(1))
    enough = days.agg((F.count(F.lit(1)) >= points).alias("chart"), F.lit(1).alias("_one"))
    return days.join(F.broadcast(enough), "_one").drop("_one")  # one row


def merchants(enriched: DataFrame) -> DataFrame:
    """Count, total and first appearance (``_seen``) of every debit merchant, a whole trimmed description."""
    seen = F.struct(F.col("parsed_date"), F.col("source_file"), F.col("page"), F.col("seq"))
    return (_dated(enriched).filter(F.col("type") == "debit").withColumn("merchant", strip(F.col("description")))
            .filter(F.col("merchant") != "").groupBy("merchant")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.min(seen).alias("_seen")))


def top_merchants(enriched: DataFrame, limit: int = TOP_MERCHANTS) -> DataFrame:
    """Debit merchants by total, ties to the one seen first (AGG4)."""
    return merchants(enriched).orderBy(F.desc("total"), "_seen").limit(limit).drop("_seen")


def portfolio(enriched: DataFrame) -> DataFrame:
    """One row of totals over everything with a known month (AGG5)."""
    low = F.coalesce("confidence", F.lit(1.0)) < lx.LOW_TXN_CONFIDENCE
    # Monthly pre-aggregation keeps the distinct month count off the row stream.
    monthly = (_dated(enriched).groupBy("month_key")
               .agg(_sum_if(_credit()).alias("income"), _sum_if(~_credit()).alias("expenses"),
                    F.count(F.lit(1)).alias("n"), F.count_if(low).alias("flagged")))
    zero = F.lit(0).cast("decimal(28,2)")
    totals = monthly.agg(
        F.coalesce(F.sum("income"), zero).alias("total_income"),
        F.coalesce(F.sum("expenses"), zero).alias("total_expenses"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("months_analyzed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged_transactions"))
    return (totals.withColumn("avg_monthly_spend", F.bround(F.col("total_expenses") / F.col("months_analyzed"), 2))
            .withColumn("net_cashflow", F.col("total_income") - F.col("total_expenses")))


def months_seen(enriched: DataFrame) -> DataFrame:
    """Months with income or expenses: the union of both sets (SET5)."""
    dated = _dated(enriched)
    return (dated.filter(_credit()).select("month_key")
            .union(dated.filter(~_credit()).select("month_key")).distinct())


def statement_metrics(txns: DataFrame) -> DataFrame:
    """Deposits, withdrawals, mean running balance and NSF count per statement (AGG6)."""
    mean = F.sum("balance_after") / F.count("balance_after")
    return (txns.groupBy("stem")
            .agg(_sum_if(_credit()).alias("total_deposits"),
                 _sum_if(F.col("type") == "debit").alias("total_withdrawals"),
                 mean.alias("_mean"), F.count_if(is_nsf(F.col("description"))).alias("nsf_count"),
                 F.count(F.lit(1)).alias("transactions"))
            .withColumn("average_daily_balance", F.when(F.col("_mean") != 0, F.bround("_mean", 2)))
            .drop("_mean"))


def fallback_metrics(txns: DataFrame) -> DataFrame:
    """Metrics of the fallback parser, whose amounts are signed (AGG7).

    A credit or a positive amount is a deposit, a debit or a negative one a withdrawal, so a
    positive debit counts on both sides.
    """
    amount = F.col("amount")
    size = F.abs(amount)
    deposit = _credit() | (amount > 0)
    withdrawal = (F.col("type") == "debit") | (amount < 0)
    zero = F.lit(0).cast("decimal(28,2)")
    return txns.groupBy("stem").agg(
        F.coalesce(F.sum(F.when(deposit, size)), zero).alias("total_deposits"),
        F.coalesce(F.sum(F.when(withdrawal, size)), zero).alias("total_withdrawals"),
        F.bround(F.sum("balance_after") / F.count("balance_after"), 2).alias("average_daily_balance"),
        F.count_if(is_nsf(F.col("description"), fallback=True)).alias("nsf_count"))
