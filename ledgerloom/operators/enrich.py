"""Dates, months and categories on transactions (ENR1-ENR6, ENR12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates as dt
from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import contains_any, first_label


def category_of(description: Column) -> Column:
    """First spending category with a keyword in the description (ENR1)."""
    lower = F.lower(description)
    return first_label([(contains_any(lower, words), name) for name, words in lx.CATEGORIES], lx.OTHER_CATEGORY)


def with_periods(txns: DataFrame, pages: DataFrame | None, default_year: int) -> DataFrame:
    """Year and end month per statement: the file name first, then the page text (ENR4, ENR5).

    ``pages`` holds ``stem, first_page, last_page``.
    """
    named = dt.year_in_name(F.col("source_file"))
    if pages is None:
        return txns.withColumn("year_hint", F.coalesce(named, F.lit(default_year))).withColumn(
            "end_month", F.lit(None).cast("int"))
    periods = pages.select("stem", dt.infer_period(F.col("first_page"), F.col("last_page")).alias("_period"))
    return (txns.join(periods, "stem", "left")
            .withColumn("end_month", F.when(named.isNull(), F.col("_period.end_month")))
            .withColumn("year_hint", F.coalesce(named, F.col("_period.year"), F.lit(default_year)))
            .drop("_period"))


def enrich(txns: DataFrame, default_year: int, pages: DataFrame | None = None) -> DataFrame:
    """Add ``parsed_date``, ``month_key`` and ``category``.

    ``default_year`` stands in for the current year so that results can be repeated.
    """
    dated = with_periods(txns, pages, default_year)
    return (dated.withColumn("parsed_date", dt.parse_date(F.col("date"), F.col("year_hint"), F.col("end_month")))
            .withColumn("month_key", dt.month_key(F.col("parsed_date")))
            .withColumn("category", category_of(F.col("description")))
            .drop("year_hint", "end_month"))


def source_order(enriched: DataFrame) -> DataFrame:
    """By date with undated rows first, then file, page and position (ENR12)."""
    return enriched.orderBy(F.col("parsed_date").asc_nulls_first(), "source_file", "page", "seq")
