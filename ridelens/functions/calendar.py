"""Date and time expressions on naive timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.schema import MONTHS, TIME_PERIOD_DEFAULT, TIME_PERIODS, WEEKDAYS


def parse_datetime(date: Column, time: Column, formats: Sequence[str] = ()) -> Column:
    """Stripped date and time texts to a naive timestamp; NULL if they do not parse.

    ISO layouts need no format. Other layouts are tried in the given order.
    """
    text = F.concat(date, F.lit(" "), time)
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def _name(names: Sequence[str], position: Column) -> Column:
    # Stated, because in ANSI mode the lookup of a NULL position is not NULL.
    name = F.element_at(F.array(*[F.lit(n) for n in names]), position)
    return F.when(position.isNotNull(), name)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The eight calendar columns of a timestamp; Monday is day 0.

    Names are looked up by number, which is far cheaper than formatting each date.
    """
    weekday = F.weekday(ts)
    return {
        "Year": F.year(ts),
        "Month": F.month(ts),
        "Month_Name": _name(MONTHS, F.month(ts)),
        "Day": F.dayofmonth(ts),
        "Day_of_Week": weekday,
        "Day_Name": _name(WEEKDAYS, weekday + 1),
        "Hour": F.hour(ts),
        "Is_Weekend": F.coalesce(weekday >= 5, F.lit(False)).cast("int"),
    }


def time_period(
    hour: Column,
    periods: Sequence[tuple[int, str]] = TIME_PERIODS,
    default: str = TIME_PERIOD_DEFAULT,
    missing: str | None = None,
) -> Column:
    """Name of the part of the day; ``periods`` lists (last hour, label) in order."""
    label = F.when(hour.isNull(), F.lit(missing))
    for last_hour, name in periods:
        label = label.when(hour <= last_hour, name)
    return label.otherwise(default)


def month_label(year: Column, month: Column) -> Column:
    """``2024-03``."""
    return F.format_string("%d-%02d", year, month)
