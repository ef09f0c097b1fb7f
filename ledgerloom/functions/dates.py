"""Dates as printed on statements: parsing, year inference, matching variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.lexicon import MONTH_ALT, MONTHS
from ledgerloom.functions.text import bind

_SPACE = " \t\n\r\f\x0b"
_NUMERIC = r"^(\d{1,2})([/-])(\d{1,2})(?:\2(\d{4}|\d{2}))?$"
_NAMED = r"^([A-Za-z]+)\s+(\d{1,2})(?:,?\s+(\d{4}))?$"
_CUT = "\x1f"

NUMERIC_RANGE = (r"(?i)(\d{1,2})[/-]\d{1,2}[/-](?:20[2-3]\d|\d{2})\s*(?:through|thru|to|-|–|—)\s*"
                 r"(\d{1,2})[/-]\d{1,2}[/-](20[2-3]\d|\d{2})")
NAMED_RANGE = (rf"(?i)(?:{MONTH_ALT})\w*\.?\s+\d{{0,2}},?\s*(?:20[2-3]\d)\s*(?:through|thru|to|-|–|—)\s*"
               rf"((?:{MONTH_ALT})\w*\.?)\s+\d{{0,2}},?\s*(20[2-3]\d)")
CLOSING_YEAR = r"(?i)(?:through|ending|closing|thru)\s+.*?(20[2-3]\d)"
DATED_YEAR = r"\d{1,2}[/-]\d{1,2}[/-](20[2-3]\d)"
NAMED_YEAR = rf"(?i)(?:{MONTH_ALT})\w*\.?\s+(?:\d{{1,2}},?\s+)?(20[2-3]\d)"
ANY_YEAR = "20[2-3][0-9]"
CLOSING_WEIGHT = 5


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"),
                    F.lpad(day, 2, "0")).try_cast("date")


def month_number(name: Column) -> Column:
    """1-12 as text for a full or three-letter month name in any case, else null."""
    lower = F.lower(name)
    table = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1)
                           for key in dict.fromkeys((m.lower(), m[:3].lower())) for v in (key, str(i))])
    return F.try_element_at(table, lower)


def parse_date(text: Column, year: Column, end_month: Column | None = None) -> Column:
    """Printed date to DATE; null when it is not a valid date.

    ``year`` fills year-less dates. With ``end_month``, a date in ``year`` whose month is after
    the statement's last month belongs to the year before.
    """
    value = F.rtrim(F.btrim(text, F.lit(_SPACE)), F.lit("."))
    # month, day, year ('' when absent), cut by a separator no statement prints
    parts = F.split(F.regexp_replace(F.regexp_replace(value, _NUMERIC, f"$1{_CUT}$3{_CUT}$4"),
                                     _NAMED, f"$1{_CUT}$2{_CUT}$3"), _CUT)

    def build(cut: Column) -> Column:
        first, day, printed = (F.get(cut, F.lit(i)) for i in range(3))
        named = month_number(first)
        month = F.coalesce(named, first)
        hint = year.cast("string")
        full = (F.when(printed == "", hint).when(F.length(printed) == 2, F.concat(F.lit("20"), printed))
                .when((printed == "1900") & named.isNotNull(), hint).otherwise(printed))
        # A named, year-less 29 February never parses (the day is checked against a common year).
        leap = (printed == "") & (day == "29") & (F.coalesce(named, F.lit("")) == "2")
        parsed = F.when(~leap, _iso(full, month, day))
        if end_month is None:
            return parsed
        late = ((F.coalesce(end_month, F.lit(0)) != 0) & (month.try_cast("int") > end_month)
                & (full.try_cast("int") == year))
        shifted = _iso((year - 1).cast("string"), month, day)
        return F.when(F.coalesce(late, F.lit(False)), F.when(parsed.isNotNull(), shifted)).otherwise(parsed)

    # Inlined, the regexes would be repeated per use.
    return bind(parts, build)


def month_key(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("unknown"))


def year_in_name(name: Column) -> Column:
    """First 2020-2039 year in the file stem, else null."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, r"(20[2-3]\d)", 1), F.lit("")).cast("int")


def _range_end(text: Column) -> Column:
    """struct(year, end_month) of the first statement period in the text, else null.

    The long text is searched once; the parts are read from the short match.
    """
    def numeric(hit: Column) -> Column:
        y = F.regexp_extract(hit, NUMERIC_RANGE, 3)
        return F.when(hit != "", F.struct(
            F.when(F.length(y) == 2, y.try_cast("int") + 2000).otherwise(y.try_cast("int")).alias("year"),
            F.regexp_extract(hit, NUMERIC_RANGE, 2).try_cast("int").alias("end_month")))

    def named(hit: Column) -> Column:
        return F.when(hit != "", F.struct(
            F.regexp_extract(hit, NAMED_RANGE, 2).try_cast("int").alias("year"),
            month_number(F.substring(F.regexp_extract(hit, NAMED_RANGE, 1), 1, 3)).cast("int").alias("end_month")))

    return F.coalesce(bind(F.regexp_extract(text, NUMERIC_RANGE, 0), numeric),
                      F.when(text.rlike(ANY_YEAR), bind(F.regexp_extract(text, NAMED_RANGE, 0), named)))


def _votes(text: Column) -> Column:
    none = F.array().cast("array<string>")
    closing = bind(F.regexp_extract(text, CLOSING_YEAR, 1),
                    lambda y: F.when(y != "", F.array_repeat(y, CLOSING_WEIGHT)).otherwise(none))
    seen = F.concat(closing, F.regexp_extract_all(text, F.lit(DATED_YEAR), 1), F.regexp_extract_all(text, F.lit(NAMED_YEAR), 1))
    return F.when(text.rlike(ANY_YEAR), seen).otherwise(none)


def infer_period(first_page: Column, last_page: Column) -> Column:
    """struct(year, end_month) from a statement's first and last page text.

    A printed period on the first, then the last page wins. Otherwise the years seen on both
    pages vote (ties go to the year seen first) and the end month stays null. ``last_page`` is
    null for one-page statements.
    """
    first, last = F.coalesce(first_page, F.lit("")), F.coalesce(last_page, F.lit(""))

    def winner(votes: Column) -> Column:
        ranked = F.transform(F.array_distinct(votes), lambda y, i: F.struct(
            F.size(F.filter(votes, lambda v: v == y)).alias("n"), (-i).alias("order"), y.alias("year")))
        return F.when(F.size(votes) > 0, F.struct(
            F.array_max(ranked)["year"].try_cast("int").alias("year"), F.lit(None).cast("int").alias("end_month")))

    voted = bind(F.concat(_votes(first), _votes(last)), winner)
    return F.coalesce(_range_end(first), _range_end(last), voted)


def date_variants(text: Column) -> Column:
    """Ways the same date may appear on the page: a set, returned sorted."""
    parts = F.split(F.btrim(text, F.lit(_SPACE)), r"[/\-\s]+")
    p0, p1, p2 = (F.get(parts, F.lit(i)) for i in range(3))
    none = F.array().cast("array<string>")
    three = F.when(F.size(parts) == 3, F.array(
        F.concat(p0, F.lit("/"), p1), F.concat(p0, F.lit("-"), p1),
        F.concat(p0, F.lit("/"), p1, F.lit("/"), p2))).otherwise(none)
    abbr = F.try_element_at(F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (f"{i:02d}", m[:3])]),
                            p0)
    numbered = F.when((F.size(parts) >= 2) & abbr.isNotNull(), F.array_compact(F.array(
        F.concat(abbr, F.lit(" "), p1),
        F.concat(abbr, F.lit(" "), p1.try_cast("int").cast("string"))))).otherwise(none)
    name = F.rtrim(F.concat(F.upper(F.substring(p0, 1, 1)), F.lower(F.substring(p0, 2, 1000))), F.lit("."))
    number = F.try_element_at(F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m[:3], f"{i:02d}")]),
                              name)
    day = F.when(F.length(p1) < 2, F.lpad(p1, 2, "0")).otherwise(p1)
    named = F.when((F.size(parts) >= 2) & number.isNotNull(), F.array(
        p0, F.concat(number, F.lit("/"), day), F.concat(number, F.lit("-"), day))).otherwise(none)
    base = F.concat(F.array(text), three, numbered, named)
    months = F.array(*[F.struct(F.lit(m).alias("full"), F.lit(m[:3]).alias("abbr")) for m in MONTHS])

    def shorten(seen: Column, m: Column) -> Column:
        shorter = F.transform(seen, lambda v: F.replace(
            F.replace(v, m["full"], m["abbr"]), F.lower(m["full"]), F.lower(m["abbr"])))
        return F.when(F.lower(text).contains(F.lower(m["full"])), F.concat(seen, shorter)).otherwise(seen)

    full = F.array_sort(F.array_distinct(F.aggregate(months, base, shorten)))
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(full)
