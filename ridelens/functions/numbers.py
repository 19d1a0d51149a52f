"""Safe casts, exact sums, rates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICRO = 1_000_000


def to_double(col: Column) -> Column:
    """Text to double; anything that is not a finite decimal number becomes NULL.

    The JVM parser also takes ``1.5f`` and ``1.5d``; those are not numbers here.
    """
    number = col.try_cast("double")
    return F.when(
        ~F.right(col, F.lit(1)).isin("d", "D", "f", "F") & (F.abs(number) < float("inf")),
        number,
    )


def exact_sum(col: Column) -> Column:
    """Sum of a double column that does not depend on row order; 0 for no values.

    Values are added in fixed point, in two parts: millionths, and what those leave in
    steps of 1e-18. Both are longs in decimal accumulators, which stay cheap per row (a
    direct double-to-decimal cast formats text). Values of 9e12 or more are added as
    decimals, and those of 1e25 or more, which no decimal sum holds, as doubles.
    """
    size = F.abs(col)
    millionths = F.rint(col * F.lit(_MICRO))
    rest = F.rint((col - millionths / F.lit(_MICRO)) * F.lit(1e18))
    small, large = size < 9e12, (size >= 9e12) & (size < 1e25)
    parts = [
        F.sum(F.when(small, millionths).cast("long").cast("decimal(20,0)")).cast("double") / F.lit(float(_MICRO)),
        F.sum(F.when(small, rest).cast("long").cast("decimal(20,0)")).cast("double") / F.lit(1e18),
        F.sum(F.when(large, col).cast("decimal(28,3)")).cast("double"),
        F.sum(F.when(~(small | large), col)),
    ]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return total


def exact_mean(col: Column) -> Column:
    """Mean from ``exact_sum``; NULL for no values."""
    return F.try_divide(exact_sum(col), F.count(col).cast("double"))


def round_half_up(col: Column, digits: int) -> Column:
    """Round on the decimal spelling, so 1.005 gives 1.01 in every engine.

    The spelling is taken to ten digits after the point; values of 1e15 or more have
    fewer and are rounded as they are.
    """
    spelled = F.when(F.abs(col) < 1e15, col).cast("decimal(38,10)")
    return F.coalesce(F.round(spelled, digits).cast("double"), F.round(col, digits))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def percent_or_zero(part: Column, whole: Column) -> Column:
    """``percent`` with 0 when ``whole`` is 0."""
    return F.coalesce(percent(part, whole), F.lit(0.0))


def flag(condition: Column) -> Column:
    """0/1 integer; a NULL condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def thousands(col: Column, digits: int = 0) -> Column:
    """``1234567.8`` as ``1,234,568``."""
    return F.format_number(col, digits)
