"""DuckDB expressions shared by the oracle statements."""

from __future__ import annotations

from ledgerloom.catalog.frames import any_of, arr, lit
from ledgerloom.functions import lexicon as lx

_MON = "{" + ", ".join(f"'{k}': '{i}'" for i, m in enumerate(lx.MONTHS, 1)
                       for k in dict.fromkeys((m.lower(), m[:3].lower()))) + "}"


def month_no(name: str) -> str:
    whens = " ".join(f"when {lit(m.lower())} then '{i}' when {lit(m[:3].lower())} then '{i}'"
                     for i, m in enumerate(lx.MONTHS, 1))
    return f"case lower({name}) {whens} end"


def iso(y: str, m: str, d: str) -> str:
    return f"try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date)"


def parse_date(text: str, year: str, end_month: str = "null") -> str:
    v = f"rtrim(trim({text}, ' ' || chr(9) || chr(10) || chr(13)), '.')"
    hint = f"cast({year} as varchar)"

    def numeric(sep: str) -> str:
        pat = rf"^(\d{{1,2}}){sep}(\d{{1,2}})(?:{sep}(\d{{4}}|\d{{2}}))?$"
        g = lambda i: f"regexp_extract({v}, '{pat}', {i})"
        y = f"case when {g(3)} = '' then {hint} when length({g(3)}) = 2 then '20' || {g(3)} else {g(3)} end"
        return f"case when regexp_matches({v}, '{pat}') then {iso(y, g(1), g(2))} end"

    pat = r"^([A-Za-z]+)\s+(\d{1,2})(?:,?\s+(\d{4}))?$"
    g = lambda i: f"regexp_extract({v}, '{pat}', {i})"
    y = f"case when {g(3)} in ('', '1900') then {hint} else {g(3)} end"
    leap = f"(coalesce({month_no(g(1))}, '') = '2' and {g(2)} = '29' and {g(3)} = '')"
    named = f"case when regexp_matches({v}, '{pat}') and not {leap} then {iso(y, month_no(g(1)), g(2))} end"
    parsed = f"coalesce({numeric('/')}, {numeric('-')}, {named})"
    if end_month == "null":
        return parsed
    back = iso(f"cast({year} - 1 as varchar)", f"cast(month({parsed}) as varchar)", f"cast(day({parsed}) as varchar)")
    return (f"case when coalesce({end_month}, 0) <> 0 and month({parsed}) > {end_month} and year({parsed}) = {year} "
            f"then {back} else {parsed} end")


def category(desc: str) -> str:
    whens = " ".join(f"when {any_of(f'lower({desc})', words)} then {lit(name)}" for name, words in lx.CATEGORIES)
    return f"case {whens} else {lit(lx.OTHER_CATEGORY)} end"


def year_in_name(name: str) -> str:
    return f"try_cast(nullif(regexp_extract(regexp_replace({name}, '\\.[^.]*$', ''), '20[2-3][0-9]'), '') as int)"


def half_even(num: str, den: str) -> str:
    """num / den rounded half to even, for integers with den > 0."""
    f = f"cast(floor({num} / {den}) as bigint)"
    r = f"(2 * ({num} - {f} * {den}))"
    return f"case when {r} < {den} or ({r} = {den} and {f} % 2 = 0) then {f} else {f} + 1 end"


ENRICHED = (f", dated as (select *, {parse_date('date', f'coalesce({year_in_name(chr(115) + 'ource_file')}, 2025)')} "
            f"parsed_date, {category('description')} category from txn), "
            "enriched as (select k, stem, source_file, page, seq, date, description, cents, true_type as type, "
            "balance_cents, confidence, parsed_date, category, "
            "coalesce(strftime(parsed_date, '%Y-%m'), 'unknown') month_key from dated) ")
