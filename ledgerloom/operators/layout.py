"""Visual rows, markers, columns and sections of a page (LAY1-LAY8).

Input is the canonical token table ``stem, page_index, pos, text, x0, top``. All windows are
partitioned by page (or by row inside a page), so one exchange by statement or page serves
the whole chain, and a group never exceeds one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as lx
from ledgerloom.functions.text import contains_any

PAGE = ["stem", "page_index"]
ROW = [*PAGE, "row_index"]
#: Order inside a row. Windows name it in full instead of ``row_pos``, so one sort serves the chain.
ACROSS = ("x0", "top", "pos")
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def row_numbers(tokens: DataFrame, tolerance: float = lx.ROW_TOLERANCE) -> DataFrame:
    """Add ``row_index``, the row of each token down its page (LAY1).

    A row starts at the first token more than ``tolerance`` below the row's *first* token, so
    the row starts of a page are a fold over its distinct tops; the fold runs once per page. One sort, down the page.
    """
    down = Window.partitionBy(*PAGE).orderBy("top")
    whole, upto = down.rowsBetween(*_ALL), down.rowsBetween(Window.unboundedPreceding, 0)

    def add(starts: Column, top: Column) -> Column:
        far = (F.size(starts) == 0) | (F.abs(top - F.element_at(starts, -1)) > tolerance)
        return F.when(far, F.concat(starts, F.array(top))).otherwise(starts)

    starts = F.aggregate(F.sort_array("_tops"), F.array().cast("array<double>"), add)
    return (tokens.withColumns({"_tops": F.collect_set("top").over(whole), "_n": F.row_number().over(down)})
            .withColumn("_starts", F.when(F.col("_n") == 1, starts)).drop("_tops", "_n")
            .withColumn("_starts", F.first("_starts", ignorenulls=True).over(whole))
            .withColumn("_begins", F.array_position("_starts", F.col("top"))).drop("_starts")  # 0 where no row starts
            .withColumn("row_index", (F.coalesce(F.max("_begins").over(upto), F.lit(0)) - 1).cast("int")).drop("_begins"))


def visual_rows(tokens: DataFrame, tolerance: float = lx.ROW_TOLERANCE) -> DataFrame:
    """Add ``row_index`` and ``row_pos`` (LAY1): ``row_numbers`` and a second sort, across the rows."""
    return row_numbers(tokens, tolerance).withColumn(
        "row_pos", F.row_number().over(Window.partitionBy(*ROW).orderBy(*ACROSS)) - 1)


def is_date_token(text: Column) -> Column:
    return text.rlike(lx.DATE_TOKEN)


def is_month_token(text: Column) -> Column:
    return F.rtrim(F.lower(text), F.lit(".")).isin(*lx.MONTH_WORDS)


def is_amount_token(text: Column) -> Column:
    return text.rlike(lx.AMOUNT_TOKEN)


def token_shapes(tokens: DataFrame) -> DataFrame:
    """Date, month and amount tests per token (LAY5)."""
    text = F.col("text")
    return tokens.withColumns({"is_date": is_date_token(text), "is_month": is_month_token(text),
                               "is_amount": is_amount_token(text)})


def is_section_marker(words: Column) -> Column:
    """Row of a section heading or total (LAY2); ``words`` is the row's lower-cased text array."""
    short = (F.size(words) <= 3) & F.btrim(F.get(words, F.lit(0)), F.lit("*")).isin(*lx.ROW_MARKER_WORDS)
    return contains_any(F.array_join(words, " "), lx.ROW_MARKER_PHRASES) | short


def is_header_row(words: Column) -> Column:
    """Row naming at least two kinds of column (LAY3, SET3)."""
    kinds = sum((F.arrays_overlap(words, F.array(*[F.lit(w) for w in names])).cast("int")
                 for _, names in lx.HEADER_WORDS), F.lit(0))
    return kinds >= 2


def with_row_flags(rowed: DataFrame) -> DataFrame:
    """``is_marker`` and ``is_header`` of the row on every token."""
    row = Window.partitionBy(*ROW).orderBy(*ACROSS).rowsBetween(*_ALL)
    words = F.collect_list(F.lower("text")).over(row)
    return (rowed.withColumn("_words", words)
            .withColumn("is_marker", is_section_marker(F.col("_words")))
            .withColumn("is_header", is_header_row(F.col("_words"))).drop("_words"))


def row_table(rowed: DataFrame) -> DataFrame:
    """One row per visual row: its text and flags (LAY2, LAY3)."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("row_pos", F.lower("text").alias("t")))), lambda x: x["t"])
    return (rowed.groupBy(*ROW).agg(words.alias("words"))
            .select(*ROW, F.size("words").alias("n_words"), F.array_join("words", " ").alias("row_text"),
                    is_section_marker(F.col("words")).alias("is_marker"), is_header_row(F.col("words")).alias("is_header")))


def header_kind(text: Column) -> Column:
    """Column kind a header word names, first kind wins."""
    lower, case = F.lower(text), None
    for kind, names in lx.HEADER_WORDS:
        case = F.when(lower.isin(*names), kind) if case is None else case.when(lower.isin(*names), kind)
    return case


def with_columns_x(flagged: DataFrame) -> DataFrame:
    """Column x positions of the page's first header row on every token, defaults where absent (LAY4).

    One window finds the first header row and, of every kind, the last word in the first header row that names it;
    such a word counts where both are the same row. The window has the order of rows, so that running ones can share it.
    """
    page = Window.partitionBy(*PAGE).orderBy("row_index", *ACROSS).rowsBetween(*_ALL)
    place = F.struct((-F.col("row_index")).alias("up"), "row_pos")
    named = flagged.withColumn("_kind", F.when(F.col("is_header"), header_kind(F.col("text"))))
    found = {f"_{kind}": F.max_by(F.struct("x0", "row_index"), F.when(F.col("_kind") == kind, place)).over(page)
             for kind in lx.DEFAULT_COLUMNS}
    located = named.withColumns({"_header": F.min(F.when(F.col("is_header"), F.col("row_index"))).over(page), **found})
    columns = {f"{kind}_x": F.coalesce(
        F.when(F.col(f"_{kind}.row_index") == F.col("_header"), F.col(f"_{kind}.x0")), F.lit(default))
        for kind, default in lx.DEFAULT_COLUMNS.items()}
    return located.withColumns(columns).drop("_header", "_kind", *found)


def page_columns(flagged: DataFrame) -> DataFrame:
    """One row per page with its column positions (LAY4)."""
    located = with_columns_x(flagged)
    return located.groupBy(*PAGE).agg(*[F.first(f"{kind}_x").alias(f"{kind}_x") for kind in lx.DEFAULT_COLUMNS])


def _with_area(tokens: DataFrame, min_preamble: int) -> DataFrame:
    """Tokens with the position ``_start`` of their page's transaction area and that of the last end heading up to them.

    The area has ended before or at a token if that heading, ``_end`` (null: none), is not before the area.
    Header phrases are compared with two- to four-token runs.
    """
    by_pos = Window.partitionBy(*PAGE).orderBy("pos")
    word = F.lower("text")
    grams = tokens.withColumn("_g1", word).withColumns({f"_l{n}": F.lead("_g1", n - 1).over(by_pos) for n in (2, 3, 4)})
    for n in (2, 3, 4):
        grams = grams.withColumn(f"_g{n}", F.concat(f"_g{n - 1}", F.lit(" "), f"_l{n}"))

    def at_header(headers: list[str]) -> Column:
        sizes = sorted({len(h.split()) for h in headers})
        runs = [F.col(f"_g{n}").isin(*[h for h in headers if len(h.split()) == n]) for n in sizes]
        return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in runs])

    # In the order of the running maximum, so one window finds both.
    firsts = [F.coalesce(F.min(F.when(F.col(f"_g{len(h.split())}") == h, F.col("pos"))).over(by_pos.rowsBetween(*_ALL)), F.lit(0))
              for h in lx.TXN_START_HEADERS]
    staged = grams.withColumns({
        "_start": F.greatest(*firsts), "_end": F.max(F.when(at_header(lx.TXN_END_HEADERS), F.col("pos"))).over(by_pos)})
    return staged.withColumn("_start", F.when(F.col("_start") < min_preamble, 0).otherwise(F.col("_start"))).drop(
        "_g1", "_g2", "_g3", "_g4", "_l2", "_l3", "_l4")


def trim_sections(tokens: DataFrame, min_preamble: int = lx.MIN_PREAMBLE) -> DataFrame:
    """Keep the transaction area of each page (LAY6); positions stay those of the full page.

    What precedes the area stays if it has under ``min_preamble`` tokens.
    """
    inside = (F.col("pos") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("_end") < F.col("_start")))
    return _with_area(tokens, min_preamble).filter(inside).drop("_start", "_end")


def trimmed_counts(tokens: DataFrame, min_preamble: int = lx.MIN_PREAMBLE) -> DataFrame:
    """Tokens before, in and after the transaction areas (LAY6)."""
    before = F.col("pos") < F.col("_start")
    after = ~before & F.coalesce(F.col("_end") >= F.col("_start"), F.lit(False))
    return _with_area(tokens, min_preamble).agg(F.count_if(before).alias("preamble"), F.count_if(~before & ~after).alias("kept"),
                                                F.count_if(after).alias("closing"))


def page_arrays(tokens: DataFrame) -> DataFrame:
    """One row per page with its lower-cased words in order."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.lower("text").alias("t")))), lambda x: x["t"])
    return tokens.groupBy(*PAGE).agg(words.alias("words"))


def section_array(words: Column, text: Column) -> Column:
    """Credit and debit headings of a page as array<struct<pos,type>> sorted by position (LAY7).

    Phrases come first; a single-word heading is dropped when any heading accepted so far is
    within five words.
    """
    kind = lambda pos, name: F.struct(pos.cast("int").alias("pos"), name.alias("type"))

    def phrase(p: str, name: str) -> Column:
        at = F.instr(text, p)
        before = F.substring(text, F.lit(1), at - 1)
        return F.when(at > 0, kind(F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))), F.lit(name)))

    phrases = F.array_compact(F.array(*[phrase(p, "debit") for p in lx.DEBIT_PHRASES],
                                      *[phrase(p, "credit") for p in lx.CREDIT_PHRASES]))
    singles = F.array_compact(F.transform(words, lambda w, i: F.when(
        w.isin(*lx.DEBIT_HEADINGS, *lx.CREDIT_HEADINGS),
        kind(i, F.when(w.isin(*lx.DEBIT_HEADINGS), "debit").otherwise("credit")))))

    def accept(seen: Column, single: Column) -> Column:
        near = F.exists(seen, lambda s: F.abs(s["pos"] - single["pos"]) < lx.HEADING_GAP)
        return F.when(near, seen).otherwise(F.concat(seen, F.array(single)))

    shape = "array<struct<pos:int,type:string>>"
    accepted = F.aggregate(singles.cast(shape), phrases.cast(shape), accept)
    ordered = F.sort_array(F.transform(accepted, lambda s, i: F.struct(s["pos"].alias("pos"), i.alias("i"), s["type"].alias("type"))))
    return F.transform(ordered, lambda s: F.struct(s["pos"].alias("pos"), s["type"].alias("type")))


def page_sections(tokens: DataFrame) -> DataFrame:
    """Pages with their words and section headings (LAY7)."""
    pages = page_arrays(tokens).withColumn("_text", F.array_join("words", " "))
    return pages.withColumn("sections", section_array(F.col("words"), F.col("_text"))).drop("_text")


def section_of(txns: DataFrame, sections: DataFrame) -> DataFrame:
    """Section type per transaction (LAY8, JOI5).

    The only section type of the page, or the last heading before the transaction, which is
    found by its date text and else by the first word of its description. Null when neither.
    """
    kinds = F.array_distinct(F.transform("sections", lambda s: s["type"]))
    only = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))  # of the page
    date_at = F.array_position("words", F.lower(F.coalesce("date", F.lit(""))))
    first_word = F.get(F.split(F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), r"^\s+", ""), r"\s+"), F.lit(0))
    word_at = F.when(first_word != "", F.array_position("words", first_word))
    at = F.coalesce(F.nullif(date_at, F.lit(0)), F.nullif(word_at, F.lit(0))) - 1
    last = F.get(F.reverse(F.filter("sections", lambda s: s["pos"] < F.col("_at"))), F.lit(0))["type"]
    # Rows and pages are put side by side instead of joined: where both are dealt by statement, as a page's transactions
    # and its words are, a join by statement and page would deal the words of all pages again.
    given = sections.filter(F.col("stem").isNotNull() & F.col("page_index").isNotNull())
    both = txns.select("stem", "page", F.struct(*txns.columns).alias("_txn")).unionByName(
        given.select("stem", F.col("page_index").alias("page"), "words", "sections", only.alias("_only")), allowMissingColumns=True)
    page = Window.partitionBy("stem", "page")
    return (both.withColumns({c: F.first(c, ignorenulls=True).over(page) for c in ("words", "sections", "_only")})
            .filter(F.col("_txn").isNotNull()).select("_txn.*", "words", "sections", "_only")
            .withColumn("_at", at)
            .withColumn("section_type", F.when(F.col("_only").isNotNull(), F.col("_only")).otherwise(last))
            .drop("words", "sections", "_only", "_at"))
