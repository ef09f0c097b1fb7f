"""Amounts: parsing printed text, printing values, matching variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
_NUMBER = r"^[ \t\r\n\f\x0B]*[-+]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][-+]?\d+)?[ \t\r\n\f\x0B]*$"
EMBEDDED = r"[-−–]?\$[\d,]+\.?\d*"


def number_text(text: Column) -> Column:
    """Printed amount without separators, currency sign and brackets; long dashes become '-'.

    A backslash and the letter 's' are removed too, whitespace is not.
    """
    return F.translate(F.translate(text, ",$()\\s", ""), "−–", "--")


def to_number(cleaned: Column) -> Column:
    """Double, or null when the text is not a plain decimal number."""
    return F.when(cleaned.rlike(_NUMBER), F.translate(cleaned, "_", "").try_cast("double"))


def parse_amount(text: Column) -> Column:
    """Printed amount to double; anything unreadable, blank or null is 0."""
    return F.coalesce(to_number(number_text(text)), F.lit(0.0))


def format_money(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value), 2))


def plain_two(value: Column) -> Column:
    """Two decimals, no thousands separator."""
    return F.abs(value).cast(MONEY).cast("string")


def amount_variants(amount: Column) -> Column:
    """Ways a statement may print the amount, in match order."""
    grouped = F.format_number(F.abs(amount), 2)
    plain = plain_two(amount)
    whole = F.format_number(F.bround(F.abs(amount), 0), 0)
    base = F.array(grouped, plain, F.concat(F.lit("$"), grouped), F.concat(F.lit("$"), plain), whole)
    signed = F.array(F.concat(F.lit("-"), grouped), F.concat(F.lit("("), grouped, F.lit(")")),
                     F.concat(F.lit("-$"), grouped))
    return F.when(amount < 0, F.concat(base, signed)).otherwise(base)
