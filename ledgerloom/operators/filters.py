"""Which files and pages count as statements or training data (FLT1-FLT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import bind, contains_any, contains_any_long, path_name, strip


def is_statement_name(url: Column) -> Column:
    """File name looks like a statement: a PDF of three letters or more without a skip word (FLT1).

    Separators are ignored on both sides of the comparison.
    """
    name = F.lower(path_name(url))
    squeezed = F.regexp_replace(name, "%20|[-_ ]", "")
    skip = [w.replace("_", "") for w in lx.NON_STATEMENT_NAMES]
    return (~contains_any(squeezed, skip) & name.endswith(".pdf")
            & (F.length(F.replace(name, F.lit(".pdf"), F.lit(""))) >= 3))


def statement_score(text: Column, min_chars: int = lx.MIN_STATEMENT_TEXT) -> Column:
    """Number of statement indicators in the text, 0-5; null for a text of under ``min_chars`` characters (FLT2)."""
    dollars = text.contains("$") & (F.regexp_count(text, F.lit(lx.DOLLARS)) >= 3)

    def score(lower: Column) -> Column:
        hits = sum((lower.contains(w).cast("int") for w in lx.CONTENT_TXN), F.lit(0))
        signs = [contains_any_long(lower, words) for words in (lx.CONTENT_BANK, lx.CONTENT_ACCOUNT, lx.CONTENT_PERIOD)]
        total = sum((sign.cast("int") for sign in [*signs, hits >= 3, dollars]), F.lit(0))
        return F.when(F.length(strip(lower)) >= min_chars, total)

    return bind(F.lower(text), score)


def is_statement_text(text: Column, min_chars: int = lx.MIN_STATEMENT_TEXT) -> Column:
    return F.coalesce(statement_score(text, min_chars) >= 2, F.lit(False))


def scoring_counts(files: DataFrame, min_chars: int = lx.MIN_STATEMENT_TEXT) -> DataFrame:
    """Files without a text, with one too short for a score, with a score and with enough indicators (FLT2)."""
    scored = files.select(F.col("text").isNull().alias("none"), statement_score(F.col("text"), min_chars).alias("score"))
    return scored.agg(F.count_if("none").alias("no_text"), F.count_if(~F.col("none") & F.col("score").isNull()).alias("too_short"),
                      F.count("score").alias("scored"), F.count_if(F.col("score") >= 2).alias("kept"))


def _candidate_tests(min_bytes: int, min_chars: int) -> dict[str, Column]:
    """What a candidate must pass, by the name of the reason to remove it."""
    return {"small": F.col("size") >= min_bytes, "name": ~contains_any(F.lower("name"), lx.NON_CANDIDATE_NAMES),
            "short_text": F.length(strip(F.col("text"))) >= min_chars}


def candidate_files(files: DataFrame, existing: DataFrame, min_bytes: int = lx.MIN_PDF_BYTES,
                    min_chars: int = lx.MIN_CANDIDATE_TEXT) -> DataFrame:
    """New files worth scanning: unknown name, big enough, plausible name, readable text (FLT3)."""
    tests = _candidate_tests(min_bytes, min_chars)
    return files.filter(tests["small"] & tests["name"] & tests["short_text"]).join(existing.select("name"), "name", "left_anti")


def candidate_counts(files: DataFrame, existing: DataFrame, min_bytes: int = lx.MIN_PDF_BYTES,
                     min_chars: int = lx.MIN_CANDIDATE_TEXT) -> DataFrame:
    """Files per ``fate``: the first test that removes them, ``known`` or ``kept``; a test of a null fails (FLT3)."""
    fate = F.lit(None).cast("string")
    for reason, passed in reversed(_candidate_tests(min_bytes, min_chars).items()):
        fate = F.when(F.coalesce(passed, F.lit(False)), fate).otherwise(reason)
    # counted by name before the join, so that no text is shuffled
    tested = files.select("name", fate.alias("_fate")).groupBy("name", "_fate").agg(F.count(F.lit(1)).alias("_n"))
    held = existing.select(F.col("name").alias("_known")).distinct()
    known = F.when(F.col("_known").isNotNull(), "known").otherwise("kept")
    return (tested.join(held, F.col("name") == F.col("_known"), "left").groupBy(F.coalesce("_fate", known).alias("fate"))
            .agg(F.sum("_n").alias("n")))


def training_filter(pages: DataFrame, labelled: DataFrame | None = None, min_alignment: float = 50.0,
                    only_reviewed: bool = False) -> DataFrame:
    """Tagged pages fit for training (FLT4); with ``labelled`` only pages that have a label file."""
    kept = pages if labelled is None else pages.join(labelled.select("stem", "page_index"),
                                                     ["stem", "page_index"], "left_semi")
    kept = kept.filter((F.coalesce("alignment_rate", F.lit(0.0)) >= min_alignment)
                       & F.col("has_image") & (F.col("word_count") > 0))
    if only_reviewed:
        kept = kept.filter(F.col("reviewed") & (F.coalesce("review_status", F.lit("")) != "rejected"))
    return kept


def skipped_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """How many tagged pages have no label file (FLT4)."""
    return (pages.join(labelled.select("stem", "page_index"), ["stem", "page_index"], "left_anti")
            .agg(F.count(F.lit(1)).alias("skipped")))


def review_queue(pages: DataFrame, below: float | None = None, unreviewed: bool = True) -> DataFrame:
    """Pages to review: unreviewed and, with ``below``, aligned worse than it (FLT5)."""
    kept = pages.filter(~F.coalesce("reviewed", F.lit(False))) if unreviewed else pages
    return kept if not below else kept.filter(F.coalesce("alignment_rate", F.lit(100.0)) < below)
