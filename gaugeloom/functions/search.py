"""Search conditions for snapshot pages, as columns.

Conditions on members hold before grouping, conditions on results after it;
both are ordinary columns, combined with & and |.
"""

from __future__ import annotations

import re
from decimal import Context, Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiples of the units that a quantity may carry.
BYTES = {"B": 1, "kB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "PB": 10**15, "EB": 10**18, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40, "PiB": 2**50, "EiB": 2**60}
SECONDS = {"ns": Decimal("1e-9"), "us": Decimal("1e-6"), "ms": Decimal("1e-3"), "s": Decimal(1), "min": Decimal(60), "h": Decimal(3600)}


def glob(column: Column, text: str) -> Column:
    """Case-insensitive match anywhere; `*` and `?` are wildcards."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text.lower())
    return F.lower(column).rlike(f"(?s)^.*{body}.*$")


def exact(column: Column, text: str) -> Column:
    return F.lower(column) == text.lower()


def contains(column: Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def identifier(column: Column, text: str) -> Column:
    """The canonical decimal form equals the text."""
    return column.cast("string") == text


def quantity(text: str) -> Decimal:
    """The exact value of a number with an optional unit, in bytes, seconds, per cent or plain."""
    m = re.fullmatch(r"(\d+(?:\.\d{1,9})?)\s*([A-Za-z%]+)?(?:/s)?", text.strip())
    if not m or len(m[1].replace(".", "")) > 38:
        raise ValueError(f"not a quantity: {text}")
    number, unit, wide = Decimal(m[1]), m[2], Context(prec=80)
    if unit == "%":
        if number > 100:
            raise ValueError("more than 100 %")
        return number
    if unit in BYTES:
        if (value := wide.multiply(number, BYTES[unit])) % 1:
            raise ValueError("a part of a byte")
        return value
    if unit and unit not in SECONDS:
        raise ValueError(f"unknown unit: {unit}")
    return wide.multiply(number, SECONDS[unit]) if unit else number


def _fraction(quantity_: str | Fraction) -> tuple[int, int]:
    return (quantity(quantity_) if isinstance(quantity_, str) else quantity_).as_integer_ratio()


def _against(top: Column, text: str | Fraction, bottom: Column) -> tuple[Column, Column, Column]:
    """(x, y, exact): whole numbers with top / bottom > quantity as x > y, and < as x < y or, unless `exact`, x <= y.

    The whole part of the quantity times bottom is taken off top; the rest of
    it, times bottom, is rounded down. No product leaves 38 digits.
    """
    n, d = _fraction(text)
    whole, rest = min(n // d, 1 << 63), n % d  # top is smaller than that many times any bottom
    digits = max(1, len(str(d)) - 1) if d > 1 else 0
    while 10**digits % d:
        digits += 1
    number = lambda x, size: F.lit(Decimal(x)).cast(f"decimal({size},0)")
    part = (bottom.cast("decimal(19,0)") * number(rest * (10**digits // d), 18)).cast("decimal(38,0)")
    scale = number(10**digits, 19)
    x = top.cast("decimal(38,0)") - (bottom.cast("decimal(19,0)") * number(whole, 19)).cast("decimal(38,0)")
    return x, F.call_function("div", part, scale).cast("decimal(38,0)"), part % scale == 0


def above(top: Column, text: str | Fraction, bottom: Column | None = None) -> Column:
    """A whole number is strictly greater than the quantity, exactly; with `bottom` for top / bottom. Any quantity of quantity() will do."""
    if bottom is None:
        n, d = _fraction(text)
        return top.cast("decimal(38,0)") > F.lit(Decimal(min(n // d, 1 << 64))).cast("decimal(38,0)")
    x, y, _ = _against(top, text, bottom)
    return x > y


def below(top: Column, text: str | Fraction, bottom: Column | None = None) -> Column:
    if bottom is None:
        n, d = _fraction(text)
        return top.cast("decimal(38,0)") < F.lit(Decimal(min(-(-n // d), 1 << 64))).cast("decimal(38,0)")
    x, y, exact = _against(top, text, bottom)
    return F.when(exact, x < y).otherwise(x <= y)
