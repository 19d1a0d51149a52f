"""Cleaning, type repair and feature derivation (row-wise, no shuffle but for
the removal of exact duplicates)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens import schema as S
from ridelens.functions import calendar, numbers, text
from ridelens.functions.tables import over_array


def text_columns(df: DataFrame) -> list[str]:
    """Names of the string columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def first_matching_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First column whose stripped lower-case header is one of ``candidates``."""
    wanted = list(candidates)
    by_header = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((by_header[w] for w in wanted if w in by_header), None)


def normalise_headers(df: DataFrame) -> DataFrame:
    """Headers stripped and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")


def _present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


# These decide which rows are kept. The optimizer copies their expression into a
# filter below the shuffle, so it must not carry the work on the whole row along.
_DECIDING = ("Date", "Time")


def _over_text(
    df: DataFrame,
    columns: Sequence[str] | None,
    clean: Callable[..., Column],
    normalise: bool = False,
    distinct: bool = False,
) -> DataFrame:
    names = text_columns(df) if columns is None else _present(df, columns)
    together = [c for c in names if c not in _DECIDING]

    # The test for "no value" stands around the cleaning, so it is made once per value.
    def changed(value: Column, full: Column | None = None) -> Column:
        done = clean(value, full)
        return text.missing_to_null(value, done) if normalise else done

    alone = {c: changed(F.col(c), text.needs_full_clean(F.col(c))) for c in names if c in _DECIDING}
    guarded = df.withColumn("_full_clean", text.needs_full_clean(*[F.col(c) for c in together]))

    # Asked for the row; in the rows that hold such a value it is asked for each value, by a
    # lambda function. All others take compiled expressions, which a projection that has a
    # lambda function cuts into small methods.
    def cleaned(row: Column) -> Column:
        full = F.transform(row, lambda value: changed(value))
        short = F.array(*[changed(F.col(c), F.lit(False)) for c in together])
        return F.when(F.col("_full_clean"), full).otherwise(short)

    return over_array(guarded.withColumns(alone), together, cleaned, distinct, ["_full_clean"])


def clean_text_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    normalise: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Strip, unquote and collapse white space in the text columns.

    ``normalise`` turns spellings of "no value" to NULL before, in the same pass;
    ``distinct`` leaves one of each set of rows that are equal after it.
    """
    return _over_text(df, columns, text.clean_text, normalise, distinct)


def audit_strip_columns(
    df: DataFrame, columns: Sequence[str] | None = None, normalise: bool = False
) -> DataFrame:
    """Strip and unquote the text columns; inner white space stays. ``normalise`` as above."""
    return _over_text(df, columns, text.strip_quotes, normalise)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; NULL equals NULL.

    Copies are merged before the shuffle, so a much repeated row costs nothing. Rows that
    come partitioned by some of their columns are not shuffled again.
    """
    return df.dropDuplicates()


def coerce_numeric(df: DataFrame, columns: Sequence[str] = S.NUMERIC_COLUMNS) -> DataFrame:
    """Text to double; bad text becomes NULL."""
    casts = {}
    for c in _present(df, columns):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        casts[c] = numbers.to_double(F.col(c)) if is_text else F.col(c).cast("double")
    return df.withColumns(casts)


# (rule text, columns, what a valid value looks like), in report order
def validity_rules(df: DataFrame) -> list[tuple[str, str, Column]]:
    """The nine (column, rule, valid) checks whose columns are present."""
    rules: list[tuple[str, str, Column]] = []
    for c in S.NON_NEGATIVE_COLUMNS:
        rules.append((c, "Must be >= 0", F.col(c) >= 0))
    for c in S.RATING_COLUMNS:
        rules.append((c, "Must be between 0 and 5", F.col(c).between(0, 5)))
    for c in S.INDICATOR_COLUMNS:
        rules.append((c, "Must be 0 or 1", F.col(c).isin(0.0, 1.0)))
    return [r for r in rules if r[0] in df.columns]


def null_invalid_numeric(df: DataFrame) -> DataFrame:
    """NULL in place of values that break their rule."""
    return df.withColumns({c: F.when(valid, F.col(c)) for c, _, valid in validity_rules(df)})


def add_datetime(
    df: DataFrame, formats: Sequence[str] = (), keep_invalid: bool = False
) -> DataFrame:
    """``DateTime`` from Date and Time; rows without a valid one are dropped."""
    require_columns(df, ["Date", "Time"])
    stripped = df.withColumns({c: text.strip_space(F.col(c)) for c in ("Date", "Time")})
    stamped = stripped.withColumn(
        "DateTime", calendar.parse_datetime(F.col("Date"), F.col("Time"), formats)
    )
    return stamped if keep_invalid else stamped.filter(F.col("DateTime").isNotNull())


def add_calendar(df: DataFrame) -> DataFrame:
    """The eight calendar columns of ``DateTime``."""
    return df.withColumns(calendar.calendar_columns(F.col("DateTime")))


def add_time_period(df: DataFrame, scheme: str = "standard") -> DataFrame:
    """``Time_Period`` of ``Hour`` by the ``standard`` or the ``alternative`` scheme."""
    if scheme == "standard":
        label = calendar.time_period(F.col("Hour"))
    elif scheme == "alternative":
        label = calendar.time_period(
            F.col("Hour"),
            S.TIME_PERIODS_ALT,
            S.TIME_PERIOD_ALT_DEFAULT,
            S.TIME_PERIOD_ALT_MISSING,
        )
    else:
        raise ValueError(f"unknown time period scheme: {scheme}")
    return df.withColumn("Time_Period", label)


def _with_status(df: DataFrame) -> DataFrame:
    """The stripped status as ``_status``: computed once, used by many columns."""
    return df.withColumn("_status", text.strip_space(F.col("Booking Status")))


def add_outcome_flags(df: DataFrame, cancelled: str = "contains") -> DataFrame:
    """Four 0/1 flags of the booking status.

    ``cancelled="contains"`` takes any status with the word in it, whatever the
    case; ``"listed"`` takes only the two known cancelled statuses.
    """
    status = F.col("_status")
    if cancelled == "contains":
        is_cancelled = F.lower(status).contains("cancelled")
    elif cancelled == "listed":
        is_cancelled = status.isin(S.CANCELLED_BY_DRIVER, S.CANCELLED_BY_CUSTOMER)
    else:
        raise ValueError(f"unknown cancelled rule: {cancelled}")
    return _with_status(df).withColumns(
        {
            "Is_Completed": numbers.flag(status == S.COMPLETED),
            "Is_Cancelled": numbers.flag(is_cancelled),
            "Is_Incomplete": numbers.flag(status == S.INCOMPLETE),
            "Is_No_Driver_Found": numbers.flag(status == S.NO_DRIVER_FOUND),
        }
    ).drop("_status")


def add_booking_outcome(df: DataFrame) -> DataFrame:
    """``Booking_Outcome``: the status relabelled, "Other" for unknown ones."""
    label = F.when(F.lit(False), F.lit(None))
    for value, name in S.OUTCOME_LABELS.items():
        label = label.when(F.col("_status") == value, name)
    labelled = _with_status(df).withColumn("Booking_Outcome", label.otherwise("Other"))
    return labelled.drop("_status")


def add_revenue(df: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """``Revenue``: the booking value of completed rides, 0 otherwise."""
    value = F.col("Booking Value")
    if missing_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    return df.withColumn("Revenue", F.when(F.col("Is_Completed") == 1, value).otherwise(0.0))


def add_fare_per_km(df: DataFrame, completed_only: bool = True) -> DataFrame:
    """``Fare_Per_KM`` where the distance is positive."""
    usable = F.col("Ride Distance") > 0
    if completed_only:
        usable = usable & (F.col("Is_Completed") == 1)
    fare = F.try_divide(F.col("Booking Value"), F.col("Ride Distance"))
    return df.withColumn("Fare_Per_KM", F.when(usable, fare))


def add_availability_flags(df: DataFrame) -> DataFrame:
    """``Has_*``: 1 where the source column has a value."""
    return df.withColumns(
        {
            flag: F.col(source).isNotNull().cast("int")
            for source, flag in S.AVAILABILITY_FLAGS.items()
            if source in df.columns
        }
    )


def add_business_features(df: DataFrame) -> DataFrame:
    """Outcome flags and label, revenue, fare per kilometre, availability flags."""
    require_columns(df, ["Booking Status", "Booking Value", "Ride Distance"])
    return (
        df.transform(add_outcome_flags)
        .transform(add_booking_outcome)
        .transform(add_revenue)
        .transform(add_fare_per_km)
        .transform(add_availability_flags)
    )


def clean_bookings(
    df: DataFrame,
    formats: Sequence[str] = (),
    keep_invalid: bool = False,
    normalise: bool = False,
) -> DataFrame:
    """Raw text bookings to the cleaned table with its 24 derived columns.

    Extra columns (a row key) travel along and count in the duplicate test. Rows without a
    valid date are dropped; ``keep_invalid`` leaves them in, with calendar columns of NULL.
    ``normalise`` is for rows whose spellings of "no value" are not yet NULL.
    """
    return (
        df.transform(clean_text_columns, None, normalise, True)
        .transform(coerce_numeric)
        .transform(null_invalid_numeric)
        .transform(add_datetime, formats, keep_invalid)
        .transform(add_calendar)
        .transform(add_time_period)
        .transform(add_business_features)
    )


def clean_bookings_alternative(
    df: DataFrame, formats: Sequence[str] = (), normalise: bool = False
) -> DataFrame:
    """The alternative rules: text only stripped, no range checks, rows with a bad
    date kept, duplicates removed after type repair, other time periods, fares for
    every ride with a distance, missing revenue as 0, boolean ``Is_Weekend``."""
    base = (
        df.transform(audit_strip_columns, None, normalise)
        .transform(coerce_numeric)
        .transform(add_datetime, formats, True)
        .transform(drop_exact_duplicates)
        .transform(add_calendar)
        .withColumn("Is_Weekend", F.coalesce(F.col("Day_of_Week") >= 5, F.lit(False)))
        .transform(add_time_period, "alternative")
        .transform(add_outcome_flags, "listed")
        .withColumn("Booking_Outcome", F.col("Booking Status"))
        .transform(add_revenue, True)
        .transform(add_fare_per_km, False)
    )
    return base.withColumns(
        {
            f"Has_{c.replace(' ', '_')}": F.col(c).isNotNull().cast("int")
            for c in S.AVAILABILITY_FLAGS
            if c in base.columns
        }
    )


def sort_by_time(df: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows in ``DateTime`` order. ``tie_break`` columns let the range shuffle split
    a moment that very many rows share."""
    return df.orderBy("DateTime", *tie_break)
