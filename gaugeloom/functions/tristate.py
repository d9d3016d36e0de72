"""Sums and ratios over values that may be unavailable or neutral.

Unavailable makes the result unknown; neutral adds nothing. Every aggregate is
a pair of ordinary aggregates, so partial aggregation works as for any sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(value: Column, unavailable: Column) -> Column:
    """The sum, null if any member is unavailable or none has a value."""
    return F.when(~F.coalesce(F.bool_or(unavailable), F.lit(False)), F.sum(value))


def maximum(value: Column, absent: Column) -> Column:
    """The maximum of what is known, null if the column is absent from any member's layout."""
    return F.when(~F.coalesce(F.bool_or(absent), F.lit(False)), F.max(value))


def _whole(value: Column) -> Column:
    """The sum as a double; whole numbers are added as decimals, so that it may leave their type."""
    return F.sum(F.coalesce(value, F.lit(None).cast("decimal(20,0)"))).cast("double")


def strict_ratio(top: Column, bottom: Column) -> Column:
    """Sum of top by sum of bottom; null if an operand is null anywhere or the divisor is 0."""
    known = ~F.bool_or(top.isNull() | bottom.isNull())
    return F.when(known, F.try_divide(_whole(top), _whole(bottom)))


def neutral_ratio(top: Column, bottom: Column) -> Column:
    """As strict_ratio, but members with both operands null add nothing."""
    known = ~F.bool_or(top.isNull() != bottom.isNull())
    return F.when(known, F.try_divide(_whole(top), _whole(bottom)))


def paired(value: Column, other: Column) -> Column:
    """The sum of `value` over members where both are known."""
    return F.sum(F.when(other.isNotNull(), value))


def row_sum(*values: Column) -> Column:
    """Sum of the fields that are present in a row; null only if none is."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values[1:]), F.coalesce(values[0], F.lit(0))))


def oldest_latest_never(ts: Column) -> list[Column]:
    """The three facts of a `last time` column, where null means never."""
    return [F.min(ts).alias("oldest"), F.max(ts).alias("latest"), F.count_if(ts.isNull()).alias("never_count")]
