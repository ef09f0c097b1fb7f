"""Bank detection and coverage (BNK1-BNK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import all_labels, bind, first_label, found, found_any, strip

SURVEY_SAMPLE = 200


def bank_of_head(text: Column) -> Column:
    """First known substring in lower-cased head text, else 'unknown' (BNK1)."""
    return first_label([(text.contains(p), bank) for p, bank in lx.BANK_SUBSTRINGS], "unknown")


def detect_bank_format(tokens: DataFrame, head_words: int | None = None) -> DataFrame:
    """Bank per statement from page 0, or only its first ``head_words`` words (BNK1)."""
    head = tokens.filter(F.col("page_index") == 0)
    if head_words:
        head = head.filter(F.col("pos") < head_words)
    words = head.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("text").alias("t")))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["t"]), " ")
    return words.select("stem", bank_of_head(text).alias("bank"))


def bank_of_text(text: Column) -> Column:
    """First matching bank of the sampling list, else 'Unknown' (BNK2)."""
    return bind(F.lower(text), lambda lower: first_label(
        [(found_any(lower, patterns), bank) for bank, patterns, _ in lx.SAMPLED_BANKS], "Unknown"))


def banks_in_name(name: Column) -> Column:
    """Every bank whose file-name patterns match (BNK3). 'WF' counts in either case."""
    return all_labels(F.lower(name), [(bank, names) for bank, names, _ in lx.SURVEYED_BANKS])


def banks_in_text(text: Column) -> Column:
    """Every bank whose first-page patterns match (BNK3, JOI4)."""
    return bind(F.lower(text), lambda lower: all_labels(lower, [(bank, texts) for bank, _, texts in lx.SURVEYED_BANKS]))


def bank_of_header(text: Column, header_chars: int | None = None) -> Column:
    """Bank from the page text, or the first 'bank' line of an FDIC member, else 'Unknown' (BNK4).

    ``header_chars`` looks at the beginning of the text only.
    """
    area = F.substring(text, 1, header_chars) if header_chars else text
    head = F.lower(area)
    trimmed = F.transform(F.split(area, "\n"), strip)
    named = F.filter(trimmed, lambda s: (F.length(s) > 3) & F.lower(s).contains("bank"))
    member = F.when(head.contains("fdic"), F.get(named, F.lit(0)))
    known = bind(head, lambda lower: first_label([(found(lower, p), bank) for p, bank in lx.HEADER_BANKS], None))
    return F.coalesce(known, member, F.lit("Unknown"))


def survey_sample(files: DataFrame, size: int = SURVEY_SAMPLE, seed: int = 42) -> DataFrame:
    """Repeatable uniform sample: the files with the smallest seeded MD5 (WIN8)."""
    return files.orderBy(F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col("name"))), "name").limit(size)


def bank_coverage(files: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Banks by file name and by text, with an estimate (BNK5).

    Texts of all files are read unless a ``sample`` of them is given; only then the estimate extrapolates.
    """
    sample = files if sample is None else sample
    total = files.agg(F.count(F.lit(1)).alias("total"))
    sampled = sample.agg(F.count(F.lit(1)).alias("sampled"))
    by_name = (files.select(F.explode(banks_in_name(F.col("name"))).alias("bank"))
               .groupBy("bank").agg(F.count(F.lit(1)).alias("fn")))
    by_text = (sample.select(F.explode(banks_in_text(F.col("text"))).alias("bank"))
               .groupBy("bank").agg(F.count(F.lit(1)).alias("txt")))
    one = F.lit(1).alias("_one")  # both sizes are one-row aggregates, so broadcasting them is safe
    rows = (by_name.join(by_text, "bank", "full_outer").select("*", one)
            .join(F.broadcast(total.select("*", one)), "_one").join(F.broadcast(sampled.select("*", one)), "_one"))
    fn, txt = F.coalesce("fn", F.lit(0)), F.coalesce("txt", F.lit(0))
    guess = F.floor(txt / F.col("sampled") * F.col("total"))
    return (rows.select("bank", fn.alias("filename_count"), txt.alias("text_count"),
                        (txt / F.col("sampled") * 100).alias("text_pct"), guess.alias("guess"))
            .select("bank", "filename_count", "text_count", "text_pct",
                    F.greatest("filename_count", "guess").alias("estimate"),
                    (F.col("filename_count") + F.col("guess")).alias("_rank"))
            .orderBy(F.desc("_rank"), "bank").drop("_rank"))


def unmatched_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files without any text match, their text on one line, and whether the name tells a bank (BNK6)."""
    snippet = F.replace("text", F.lit("\n"), F.lit(" | "))
    rows = files.filter(F.size(banks_in_text(F.col("text"))) == 0).select(
        "name", snippet.alias("snippet"), (F.size(banks_in_name(F.col("name"))) > 0).alias("in_name")).orderBy("name")
    return rows.limit(limit) if limit else rows


def bank_members(matches: DataFrame) -> DataFrame:
    """Match counts per bank (most files first)."""
    return matches.groupBy("bank").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "bank")
