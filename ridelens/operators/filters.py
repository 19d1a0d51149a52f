"""Row filters; all are native predicates, so Parquet scans take them over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import text


def filter_equals(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == value)


def filter_in_list(df: DataFrame, column: str, values: Sequence[object] | None) -> DataFrame:
    """Rows whose value is listed. No list or an empty one keeps every row, the
    missing values included; a list drops them."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def filter_hour_between(
    df: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Rows with ``first <= Hour <= last``; an open end takes every hour."""
    return df.filter(F.col("Hour").between(first or 0, 23 if last is None else last))


def filter_day_type(df: DataFrame, day_type: str = "All Days") -> DataFrame:
    """``All Days``, ``Weekdays`` or ``Weekends``."""
    wanted = {"All Days": None, "Weekdays": 0, "Weekends": 1}
    if day_type not in wanted:
        raise ValueError(f"unknown day type: {day_type}")
    flag = wanted[day_type]
    return df if flag is None else df.filter(F.col("Is_Weekend") == flag)


def filter_bookings(
    df: DataFrame,
    vehicles: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    payment_methods: Sequence[str] | None = None,
    day_type: str = "All Days",
    hours: tuple[int | None, int | None] = (None, None),
) -> DataFrame:
    """All dashboard filters together.

    ``payment_methods=None`` keeps bookings without a payment; listing every
    method drops them, and with them every cancelled booking.
    """
    return (
        df.transform(filter_in_list, "Vehicle Type", vehicles)
        .transform(filter_in_list, "Booking Status", statuses)
        .transform(filter_in_list, "Payment Method", payment_methods)
        .transform(filter_day_type, day_type)
        .transform(filter_hour_between, *hours)
    )


def filter_nonblank_reason(
    df: DataFrame, column: str, also: tuple[str, ...] = ()
) -> DataFrame:
    """Rows with a reason, stripped; ``also`` lists more words that mean none."""
    return df.withColumn(column, text.strip_space(F.col(column))).filter(
        text.is_nonblank(F.col(column), also)
    )


def distinct_values_sorted(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, missing ones left out: the options of a filter."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
