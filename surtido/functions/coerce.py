"""Coercion of raw sales texts. Every function returns a Column; nothing raises on bad input."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import DATE_FORMATS, MISSING_MARKERS

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_quantity(raw: Column) -> Column:
    """Whole units, truncated toward zero; unreadable or out-of-range values are 0.

    The pattern keeps out texts that only a cast would read as a number, such
    as ``5d`` or ``inf``.
    """
    text = raw.cast("string")
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(number.try_cast("int"), F.lit(0))


def _shape(fmt: str) -> str:
    """Regular expression of the texts a date format can read."""
    digits = {"yyyy": "[0-9]{4}", "MM": "[0-9]{2}", "dd": "[0-9]{2}"}
    tokens = re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", fmt)
    return "^" + "".join(
        re.escape(t[1]) if t[1] is not None
        else digits.get(t[0], "[0-9]{1,2}") if t[2]
        else re.escape(t[0])
        for t in tokens
    ) + "$"


#: Texts of each part of a date; those of no month or day are not worth a try.
_PARTS = {
    "yyyy": "([0-9]{4})", "M": "(0?[1-9]|1[0-2])", "MM": "(0[1-9]|1[0-2])",
    "d": "(0?[1-9]|[12][0-9]|3[01])", "dd": "(0[1-9]|[12][0-9]|3[01])",
}


def _date_parts(fmt: str) -> tuple[str, str] | None:
    """Regular expression of the dates a format reads, a group for each part, and the ISO text of the groups.

    None for formats of other parts or with letters between them.
    """
    tokens = [t[0] for t in re.finditer(r"([A-Za-z])\1*|.", fmt)]
    order = [t[0] for t in tokens if t.isalpha()]
    if sorted(order) != ["M", "d", "y"] or any(t not in _PARTS and t not in "./-" for t in tokens):
        return None
    return "".join(_PARTS.get(t) or re.escape(t) for t in tokens), "-".join(f"${order.index(p) + 1}" for p in "yMd")


_ISO = "yyyy-M-d"
# A time of day with seconds, fractions, AM or PM and an offset, each as far as given.
_TIME = (
    r"^([T ]\s*([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9]([.,][0-9]{1,9})?)?"
    r"(\s*[AaPp]\.?\s?[Mm]\.?)?(\s*(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?$"
)


def to_sale_date(raw: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date as written in the text, else null; ``formats`` are day patterns, the first that reads it counts.

    A time of day may follow and does not move the date, nor does its offset.
    The shape of the text picks the patterns, so that unreadable texts are not
    parsed at all: a failing parse costs far more than a match. Plain ISO days,
    the most frequent kind, cost one match and a cast.
    """
    text = F.trim(raw.cast("string"))
    if _ISO in formats:
        others = [f for f in formats if f != _ISO]
        plain = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text.try_cast("date"))
        return plain.otherwise(_by_shape(text, [_ISO, *others]))
    return _by_shape(text, formats)


def _by_shape(text: Column, formats: Sequence[str]) -> Column:
    """By the formats of the first shape that fits.

    Year, month and day are put in the order a cast reads: that costs a match
    and throws nothing, while a parser of patterns throws for each text that it
    cannot read. Matching whole texts, nothing is cut out of them first.
    """
    by_shape: dict[str, list[str]] = {}
    for fmt in formats:
        by_shape.setdefault(_shape(fmt), []).append(fmt)
    day = F.regexp_extract(text, r"^[0-9./-]+", 0)
    rest = F.substring(text, F.length(day) + 1, F.length(text))
    cases = F.when(text.isNull(), F.lit(None).cast("date"))
    for shape, alike in by_shape.items():
        if all(map(_date_parts, alike)):
            fits, parsed = text.rlike(shape[:-1] + _TIME[1:]), []
            for pattern, iso in map(_date_parts, alike):
                parsed.append(F.regexp_replace(text, "^" + pattern + _TIME[1:], iso).try_cast("date"))
        else:
            fits = day.rlike(shape) & rest.rlike(_TIME)
            parsed = [F.try_to_timestamp(day, F.lit(fmt)).cast("date") for fmt in alike]
        cases = cases.when(fits, F.coalesce(*parsed))
    return cases


def day_first(formats: Sequence[str]) -> bool | None:
    """Whether ``formats`` try the day before the month where a text could be either; None if they allow one order only."""
    orders = [f[0] == "d" for f in formats if f[0] in "dM"]
    return orders[0] if len(set(orders)) == 2 else None


def other_order(formats: Sequence[str]) -> list[str]:
    """``formats`` with day-first and month-first patterns in each other's place."""
    swapped = str.maketrans("dM", "Md")
    return [f.translate(swapped) if f[0] in "dM" else f for f in formats]


def order_told(raw: Column) -> Column:
    """What a date text says about the order of day and month.

    ``dia`` or ``mes``: only this can stand first; ``ambos``: either can, and it
    makes a difference; null: nothing, the text begins with the year or is the
    same day in both orders.
    """
    text = F.trim(raw.cast("string"))
    low, high = "(0?[0-9]|1[0-2])", "(1[3-9]|[2-9][0-9])"

    def starts(first: str, second: str) -> Column:
        return text.rlike(f"^{first}[./-]{second}[./-][0-9]{{4}}(?![0-9])")

    same = text.rlike(r"^0?([0-9]{1,2})[./-]0?\1[./-]")
    return F.when(starts(high, low), "dia").when(starts(low, high), "mes").when(starts(low, low) & ~same, "ambos")


def to_sku(raw: Column) -> Column:
    """Trimmed SKU text; blanks and missing-value markers become null."""
    text = F.trim(raw.cast("string"))
    return F.when(~text.isin(*MISSING_MARKERS), text)


def blank_to(value: Column, default: Column) -> Column:
    """``default`` where ``value`` is null or an empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def finite_or_null(value: Column) -> Column:
    """Double with NaN and infinities replaced by null."""
    number = value.try_cast("double")
    bounded = (~F.isnan(number)) & (F.abs(number) < F.lit(float("inf")))
    return F.when(bounded, number)
