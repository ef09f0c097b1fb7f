"""Transactions: building, cleaning and credit/debit typing (TXN1-8, TXN10, WIN1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions import money as mn
from ledgerloom.functions.text import contains_any
from ledgerloom.operators.scale import previous_value

UNKNOWN = "unknown"
_BLANK = r"^\s*$"


def build_transactions(fields: DataFrame) -> DataFrame:
    """Decoded field texts to typed transactions (TXN2).

    Reads ``date_text, desc_text, amount_text, balance_text, mean_conf``; every other column is
    kept. A missing amount counts as 0, only a blank amount drops the row, and a negative one
    makes a debit. A number too large for money is a null amount or balance (``rejected_amounts``).
    """
    amount = mn.parse_amount(F.coalesce("amount_text", F.lit("0")))
    balance = F.when(F.coalesce("balance_text", F.lit("")) != "", mn.parse_amount(F.col("balance_text")))
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    kept = [c for c in fields.columns
            if c not in ("date_text", "desc_text", "amount_text", "balance_text", "mean_conf")]
    return fields.filter(~F.coalesce("amount_text", F.lit("0")).rlike(_BLANK)).select(
        *kept, trim("date_text").alias("date"), trim("desc_text").alias("description"),
        F.abs(amount).try_cast(mn.MONEY).alias("amount"),
        F.when(amount < 0, "debit").otherwise(UNKNOWN).alias("type"),
        balance.try_cast(mn.MONEY).alias("balance_after"),
        F.bround("mean_conf", 4).cast("double").alias("confidence"))


def rescue_embedded_amounts(txns: DataFrame) -> DataFrame:
    """Zero-amount rows whose description holds dollar amounts take the last one (TXN3)."""
    desc = F.col("description")
    found = F.regexp_extract_all(desc, F.lit(mn.EMBEDDED), 0)
    parsed = mn.to_number(F.translate(F.element_at("_found", -1), "−–$,", "--"))
    cleaned = F.aggregate("_found", desc, lambda text, m: F.replace(text, m, F.lit("")))
    cleaned = F.btrim(F.regexp_replace(cleaned, r"\s+", " "))
    use = (F.col("amount") == 0) & (F.size("_found") > 0) & F.col("_parsed").isNotNull()
    staged = (txns.withColumn("_found", F.when(F.col("amount") == 0, found))
              .withColumn("_parsed", F.when(F.size("_found") > 0, parsed)))
    return staged.withColumns({
        "type": F.when(use & (F.col("_parsed") < 0), "debit").otherwise(F.col("type")),
        "description": F.when(use, cleaned).otherwise(desc),
        "amount": F.when(use, F.abs("_parsed").try_cast(mn.MONEY)).otherwise(F.col("amount")),
    }).drop("_found", "_parsed")


def drop_empty(txns: DataFrame) -> DataFrame:
    """Keep rows with an amount or a balance, and those whose amount was rejected (TXN4)."""
    return txns.filter(F.col("amount").isNull() | (F.col("amount") != 0) | F.col("balance_after").isNotNull())


def rejected_amounts(txns: DataFrame) -> DataFrame:
    """Rows and rejected (null) amounts per statement that has one."""
    return (txns.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount").isNull()).alias("rejected"))
            .filter("rejected > 0"))


def drop_summary_rows(txns: DataFrame) -> DataFrame:
    """Drop totals, balances and other statement summary rows (TXN5)."""
    text = F.btrim(F.lower("description"))
    summary = contains_any(text, lx.SUMMARY_WORDS) | ((F.length(text) < 3) & (F.col("amount") == 0))
    return txns.filter(~summary)


def previous_balance(txns: DataFrame) -> DataFrame:
    """Nearest earlier known balance of the same statement (WIN1)."""
    return previous_value(txns, ["stem"], "seq", "balance_after", "prev_balance")


def type_by_balance(balance: Column, previous: Column, amount: Column) -> Column:
    """'debit' / 'credit' when the balance moved by the amount, else null (TXN6)."""
    diff = balance - previous
    return F.when(F.abs(diff + amount) < 1, "debit").when(F.abs(diff - amount) < 1, "credit")


def type_by_words(description: Column) -> Column:
    """Keyword typing with a debit default; credit words win (TXN8)."""
    text = F.lower(description)
    return F.when(contains_any(text, lx.CREDIT_WORDS), "credit").otherwise("debit")


def infer_by_balance(txns: DataFrame) -> DataFrame:
    """Fill unknown types from balance changes (TXN6)."""
    by_balance = type_by_balance(F.col("balance_after"), F.col("prev_balance"), F.col("amount"))
    known = F.nullif(F.col("type"), F.lit(UNKNOWN))
    return (previous_balance(txns).withColumn("type", F.coalesce(known, by_balance, F.lit(UNKNOWN)))
            .drop("prev_balance"))


def infer_types(txns: DataFrame) -> DataFrame:
    """Hybrid typing: sign, balance change, section heading, then model or keywords (TXN10).

    Optional columns ``section_type`` and ``model_type`` hold what those methods found; each
    method only fills what the ones before left unknown.
    """
    known = F.nullif(F.col("type"), F.lit(UNKNOWN))
    by_balance = type_by_balance(F.col("balance_after"), F.col("prev_balance"), F.col("amount"))
    extra = [F.col(c) for c in ("section_type", "model_type") if c in txns.columns]
    return (previous_balance(txns)
            .withColumn("type", F.coalesce(known, by_balance, *extra, type_by_words(F.col("description"))))
            .drop("prev_balance", "section_type", "model_type"))


def is_nsf(description: Column, fallback: bool = False) -> Column:
    """Insufficient-funds wording (ENR11)."""
    return contains_any(F.upper(description), lx.NSF_WORDS_FALLBACK if fallback else lx.NSF_WORDS)
