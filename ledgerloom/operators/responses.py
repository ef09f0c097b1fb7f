"""Model responses: fences, parsing, salvage and label rows (JSN1-JSN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import number_text, to_number
from ledgerloom.functions.text import strip_fence
from ledgerloom.sources.schemas import TXN_ARRAY, label_type

FULL_CONFIDENCE = 1.0
SALVAGED_CONFIDENCE = 0.8


def response_body(text: Column, stop_at_close: bool = False) -> Column:
    """Trimmed response without its code fence (JSN1)."""
    return strip_fence(F.regexp_replace(text, r"^\s+|\s+$", ""), stop_at_close)


def _valid(body: Column) -> Column:
    """One whole JSON value and nothing after it.

    Spark's JSON functions stop after the first value, so the text is closed into an array with
    a marker element: trailing text, or a second value, changes its length or breaks it.
    """
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), body, F.lit(",0]"))) == 2, F.lit(False))


def read_numbers(transactions: Column) -> Column:
    """Written transactions with amounts and balances as numbers; what is no number is null, never zero."""
    number = lambda text: to_number(number_text(text))
    return F.transform(transactions, lambda t: F.struct(
        t["date"].alias("date"), t["description"].alias("description"), number(t["amount"]).alias("amount"),
        t["type"].alias("type"), number(t["balance_after"]).alias("balance_after")))


def parse_labels(responses: DataFrame) -> DataFrame:
    """Response text to label rows; unreadable JSON leaves an empty, flagged label (JSN2)."""
    body = response_body(F.col("text"), stop_at_close=True)
    keep = [c for c in responses.columns if c != "text"]
    parsed = responses.withColumn("_body", body).withColumn("_ok", _valid(F.col("_body"))).withColumn(
        "_label", F.when(F.col("_ok"), F.from_json("_body", label_type())))
    return parsed.select(
        *keep, F.coalesce(read_numbers(F.col("_label.transactions")), F.array().cast(TXN_ARRAY)).alias("transactions"),
        F.coalesce("_label.has_transactions", F.when(~F.col("_ok"), False)).alias("has_transactions"),
        F.when(~F.col("_ok"), F.concat(F.lit("JSON parse error. Raw: "), F.col("_body")))
        .otherwise(F.col("_label.notes")).alias("notes"),
        F.when(~F.col("_ok"), True).otherwise(F.coalesce("_label.parse_error", F.lit(False))).alias("parse_error"))


def salvage(text: Column) -> Column:
    """Truncated JSON cut after its last complete object and closed again (JSN3)."""
    pair = F.regexp_extract(text, r"(?s)^(.*\}),", 1)
    single = F.regexp_extract(text, r"(?s)^(.*\})", 1)
    cut = F.when(pair != "", pair).when(single != "", single)
    return F.concat(cut, F.lit("]}"))


def response_transactions(responses: DataFrame) -> DataFrame:
    """Transactions of each response: confidence 1.0, or 0.8 when salvaged (JSN3).

    ``responses``: ``text, stop_reason``; only responses stopped by the token limit are salvaged.
    """
    body = response_body(F.col("text"))
    staged = responses.withColumn("_body", body).withColumn("_ok", _valid(F.col("_body"))).withColumn(
        "_fixed", F.when(~F.col("_ok") & (F.col("stop_reason") == "max_tokens"), salvage(F.col("_body"))))
    fixed = F.when(F.col("_ok"), F.col("_body")).when(_valid(F.col("_fixed")), F.col("_fixed"))
    keep = [c for c in responses.columns if c not in ("text", "stop_reason")]
    return (staged.withColumn("_txns", read_numbers(F.from_json(fixed, label_type())["transactions"]))
            .select(*keep, F.when(F.col("_ok"), FULL_CONFIDENCE).otherwise(SALVAGED_CONFIDENCE).alias("confidence"),
                    F.posexplode("_txns").alias("idx", "_t"))
            .select(*keep, "confidence", "idx", "_t.*"))


def label_samples(pages: DataFrame) -> DataFrame:
    """Credit and debit rows of label files with absolute amounts (JSN4).

    ``pages``: ``stem, page_index, transactions``. A row without a readable amount has a null amount.
    """
    rows = pages.select("stem", "page_index", F.explode("transactions").alias("t"))
    return rows.filter(F.col("t.type").isin("credit", "debit")).select(
        "stem", "page_index", F.abs("t.amount").alias("amount"),
        F.coalesce("t.description", F.lit("")).alias("description"), F.col("t.type").alias("type"))


def page_of_file(path: Column) -> Column:
    """Page index in a file name such as ``page_3_labels.json``."""
    return F.regexp_extract(path, r"page_(\d+)_[a-z]+\.json$", 1).try_cast("int")
