"""Profiles and quality audits.

Column-by-column counts come from one aggregation over the table whatever the
number of columns. Distinct counts and top values come from one count of
(column, value) pairs, merged before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions import calendar, text
from ridelens.functions.numbers import exact_mean, exact_sum, percent, round_half_up
from ridelens.functions.ranking import quantile_columns
from ridelens.functions.tables import fixed_rows, long_rows, share, side_by_side
from ridelens.operators import cleaning


def audit_table(raw: DataFrame, normalise: bool = False) -> DataFrame:
    """The table audits look at: text stripped and unquoted, numbers as doubles.

    ``normalise`` is for rows whose spellings of "no value" are not yet NULL.
    """
    if normalise:
        # Not left to the cast, which finds out by a costly exception that one is no number.
        numbers = [c for c in S.NUMERIC_COLUMNS if c in cleaning.text_columns(raw)]
        raw = raw.withColumns({c: text.missing_to_null(F.col(c)) for c in numbers})
    return raw.transform(cleaning.audit_strip_columns, S.TEXT_COLUMNS, normalise).transform(
        cleaning.coerce_numeric
    )


def _missing(column: str) -> Column:
    return F.count("*") - F.count(F.col(column))


def _total(columns: Sequence[str]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + _missing(c)
    return total


def _per_column(
    df: DataFrame, columns: Sequence[str], measures: dict[str, callable], key: str = "Column"
) -> DataFrame:
    """One aggregation, then one row per column with the named measures."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        values = []
        for j, measure in enumerate(measures.values()):
            aggs.append(measure(c).alias(f"m{i}_{j}"))
            values.append(F.col(f"m{i}_{j}"))
        rows.append((c, values))
    return long_rows(df.agg(*aggs), key, rows, list(measures))


def distinct_counts(df: DataFrame, columns: Sequence[str], key: str = "Column") -> DataFrame:
    """(Column, distinct non-missing values) for columns of any type.

    Columns of one type are counted together, in their own type: turning numbers
    and moments into text to put all columns in one list would cost more.
    """
    types = dict(df.dtypes)
    counted = []
    for kind in dict.fromkeys(types[c] for c in columns):
        same = [c for c in columns if types[c] == kind]
        pairs = df.select(*same).unpivot([], same, "Column", "Value")
        counted.append(
            pairs.filter(F.col("Value").isNotNull())
            .groupBy("Column", "Value")
            .agg(F.lit(1).alias("one"))
            .groupBy("Column")
            .agg(F.count("*").alias("Unique Values"))
        )
    found = reduce(DataFrame.union, counted)
    names = fixed_rows(df.sparkSession, [(c,) for c in columns], "Column string")
    return names.join(found, "Column", "left").select(
        F.col("Column").alias(key),
        F.coalesce("Unique Values", F.lit(0)).cast("long").alias("Unique Values"),
    )


def value_counts_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(Column, Value as text, Count), missing values as NULL."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "Column", "Value")
        .groupBy("Column", "Value")
        .agg(F.count("*").alias("Count"))
    )


def schema_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Position, name, type and non-missing count of each column."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    return _per_column(
        df,
        columns,
        {
            "Position": lambda c: F.lit(columns.index(c) + 1),
            "Data_Type": lambda c: F.lit(types[c]),
            "Non_Null": lambda c: F.count(F.col(c)),
        },
    ).orderBy("Position")


def table_preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, most missing first."""
    columns = list(columns or df.columns)
    return _per_column(
        df,
        columns,
        {
            "Missing Count": _missing,
            "Missing %": lambda c: round_half_up(percent(_missing(c), F.count("*")), 2),
        },
    ).orderBy(F.desc("Missing %"), "Column")


def missing_values_typed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``missing_values`` with the column's type."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    return _per_column(
        df,
        columns,
        {
            "Missing_Count": _missing,
            "Missing_Percentage": lambda c: round_half_up(percent(_missing(c), F.count("*")), 2),
            "Data_Type": lambda c: F.lit(types[c]),
        },
    ).orderBy(F.desc("Missing_Percentage"), "Column")


def data_dictionary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, missing count and percentage, distinct values per column."""
    columns = list(columns or df.columns)
    unique = distinct_counts(df, columns).withColumnRenamed("Unique Values", "Unique_Values")
    return missing_values_typed(df, columns).join(unique, "Column").select(
        "Column", "Data_Type", "Missing_Count", "Missing_Percentage", "Unique_Values"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows equal to an earlier row; missing equals missing.

    Only hashes of rows are shuffled to find those that may have an equal; rows whose hash
    occurs once have none. The others are compared in all columns.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[f"`{c}`" for c in df.columns]))
    repeated = hashed.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash")
    groups = (
        hashed.join(repeated, "_hash", "left_semi")
        .groupBy(*[f"`{c}`" for c in df.columns])
        .agg(F.count("*").alias("n"))
    )
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("Duplicate Rows")
    )


def _id_groups(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def duplicate_ids_first(df: DataFrame, column: str = "Booking ID") -> DataFrame:
    """Rows whose id an earlier row has; a missing id counts as one value."""
    return _id_groups(df, column).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("Duplicate Values")
    )


def duplicate_ids_all(df: DataFrame, column: str = "Booking ID") -> DataFrame:
    """Distinct repeated ids and the number of rows that carry one."""
    repeated = _id_groups(df, column).filter(F.col("n") > 1)
    return repeated.agg(
        F.count(F.col(column)).alias("duplicate_booking_ids_found"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_with_duplicate_booking_ids"),
    )


def duplicate_summary(df: DataFrame, column: str = "Booking ID") -> DataFrame:
    """(Metric, Count) of duplicate rows and repeated ids."""
    one = side_by_side(duplicate_rows(df), duplicate_ids_first(df, column))
    return long_rows(
        one,
        "Metric",
        [
            ("Duplicate complete rows", [F.col("Duplicate Rows")]),
            ("Duplicate Booking IDs", [F.col("Duplicate Values")]),
        ],
        ["Count"],
    )


def duplicate_id_report(df: DataFrame, column: str = "Booking ID") -> DataFrame:
    """All rows whose id is not unique, in the order of the id; missing ids form one group.

    The ranges of the order hold all rows of an id, so they are counted there: the rows are
    shuffled once.
    """
    ranged = df.repartitionByRange(F.col(column))
    counted = ranged.withColumn("_n", F.count("*").over(Window.partitionBy(column)))
    return counted.filter("_n > 1").drop("_n").orderBy(column)


def group_size_flag(df: DataFrame, column: str = "Booking ID") -> DataFrame:
    """Adds ``Is_Repeated_ID``: 1 where another row has the same id; missing ids are one.

    A join on the repeated ids alone, not a window: adaptive execution can split a very
    frequent id in a join, while a window must gather it in one task.
    """
    repeated = _id_groups(df, column).filter("n > 1").select(
        F.col(column).alias("_id"), F.lit(1).alias("_repeated")
    )
    joined = df.join(repeated, F.col(column).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("Is_Repeated_ID", F.coalesce("_repeated", F.lit(0))).drop(
        "_id", "_repeated"
    )


def first_occurrence_flag(
    df: DataFrame, order: Sequence[str], column: str = "Booking ID"
) -> DataFrame:
    """Adds ``Is_Duplicate``: 0 for the first row of each id in ``order``, else 1.

    Ids that occur once need no join: only the first rows of repeated ids, found from
    merged counts and minima, come back, and their side is as small as they are few.
    """
    key = F.struct(*order)
    first = (
        df.groupBy(F.col(column).alias("_id"))
        .agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = df.join(first, F.col(column).eqNullSafe(F.col("_id")), "left")
    later = F.coalesce(key > F.col("_first"), F.lit(False))
    return joined.withColumn("Is_Duplicate", later.cast("int")).drop("_id", "_first")


def value_share(
    df: DataFrame, column: str, count: str = "Count", percentage: str = "Percentage"
) -> DataFrame:
    """Count and share of all rows per value, missing included, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias(count))
    return counts.withColumn(
        percentage, round_half_up(share(F.col(count), counts, count), 2)
    ).orderBy(F.desc(count), F.asc_nulls_last(column))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values and missing count per text column."""
    columns = list(columns or cleaning.text_columns(df))
    counts = value_counts_by_column(df, columns)
    missing = F.col("Value").isNull()
    return counts.groupBy("Column").agg(
        F.count(F.when(~missing, 1)).alias("Unique Values"),
        F.coalesce(F.sum(F.when(missing, F.col("Count"))), F.lit(0)).alias("Missing"),
    )


def categorical_summary_approx(
    df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02
) -> DataFrame:
    """``categorical_summary`` with sketched distinct counts: one pass, no wide shuffle."""
    columns = list(columns or cleaning.text_columns(df))
    return _per_column(
        df,
        columns,
        {
            "Unique Values": lambda c: F.approx_count_distinct(F.col(c), rsd),
            "Missing": _missing,
        },
    )


def top_categories(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 20
) -> DataFrame:
    """The ``n`` most frequent values of each text column, missing included.

    Spark keeps only ``n`` rows per column in each task before it gathers them.
    """
    columns = list(columns or cleaning.text_columns(df))
    order = Window.partitionBy("Column").orderBy(F.desc("Count"), F.asc_nulls_last("Value"))
    return (
        value_counts_by_column(df, columns)
        .withColumn("Rank", F.row_number().over(order))
        .filter(F.col("Rank") <= n)
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = list(columns or cleaning.numeric_columns(df))
    basic = _per_column(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]),
        columns,
        {
            "count": lambda c: F.count(F.col(c)),
            "mean": lambda c: exact_mean(F.col(c)),
            "std": lambda c: F.stddev_samp(F.col(c)),
            "min": lambda c: F.min(F.col(c)),
            "max": lambda c: F.max(F.col(c)),
        },
    )
    quartiles = quantile_columns(df, columns, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    joined = basic.join(
        quartiles.withColumnRenamed("column", "Column"), "Column", "left"
    )
    return joined.select("Column", "count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe_all(
    df: DataFrame, text: Sequence[str] | None = None, numbers: Sequence[str] | None = None
) -> DataFrame:
    """``numeric_summary`` rows and, for text columns, count, unique, top and freq."""
    text = list(text or cleaning.text_columns(df))
    counts = value_counts_by_column(df, text).filter(F.col("Value").isNotNull())
    # The most frequent value, the smallest on a tie, as a merged maximum.
    best = F.min_by("Value", F.struct(-F.col("Count"), F.col("Value")))
    top = counts.groupBy("Column").agg(
        F.sum("Count").alias("count"),
        F.count("*").alias("unique"),
        best.alias("top"),
        F.max("Count").alias("freq"),
    )
    return top.unionByName(numeric_summary(df, numbers), allowMissingColumns=True)


def numeric_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Negative, zero and missing counts per numeric column."""
    columns = list(columns or cleaning.numeric_columns(df))
    return _per_column(
        df,
        columns,
        {
            "Negative Count": lambda c: F.count_if(F.col(c) < 0),
            "Zero Count": lambda c: F.count_if(F.col(c) == 0),
            "Missing Count": _missing,
        },
    )


def datetime_audit(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Unparsable count, earliest and latest moment of Date and Time."""
    ts = calendar.parse_datetime(F.col("Date"), F.col("Time"), formats)
    return df.select(ts.alias("ts")).agg(
        (F.count("*") - F.count("ts")).alias("Invalid DateTime"),
        F.min("ts").alias("Minimum DateTime"),
        F.max("ts").alias("Maximum DateTime"),
    )


def rating_validation(df: DataFrame, low: float = 0, high: float = 5) -> DataFrame:
    """Range, out-of-range and missing counts of every column named like a rating."""
    columns = [c for c in df.columns if "rating" in c.lower()]
    outside = f"Outside {low:g}-{high:g}"
    return _per_column(
        df,
        columns,
        {
            "Min": lambda c: F.min(F.col(c)),
            "Max": lambda c: F.max(F.col(c)),
            outside: lambda c: F.count_if((F.col(c) < low) | (F.col(c) > high)),
            "Missing": _missing,
        },
    )


def identifier_audit(df: DataFrame, columns: Sequence[str] = tuple(S.ID_COLUMNS)) -> DataFrame:
    """Missing, distinct and repeated values per id column."""
    columns = [c for c in columns if c in df.columns]
    counts = value_counts_by_column(df, columns)
    known = F.col("Value").isNotNull()
    return counts.groupBy("Column").agg(
        F.coalesce(F.sum(F.when(~known, F.col("Count"))), F.lit(0)).alias("Missing"),
        F.count(F.when(known, 1)).alias("Unique"),
        F.sum(F.col("Count") - 1).alias("Duplicate Values"),
    )


def missingness_by_status(
    df: DataFrame, columns: Sequence[str] = tuple(S.STATUS_DEPENDENT_COLUMNS)
) -> DataFrame:
    """Percentage of missing values of each column within each booking status."""
    columns = [c for c in columns if c in df.columns]
    return (
        df.filter(F.col("Booking Status").isNotNull())
        .groupBy("Booking Status")
        .agg(*[round_half_up(percent(_missing(c), F.count("*")), 2).alias(c) for c in columns])
        .orderBy("Booking Status")
    )


def with_preview_features(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """The 13 audit-only columns; fares here are not limited to completed rides."""
    ts = calendar.parse_datetime(F.col("Date"), F.col("Time"), formats)
    stamped = df.withColumn("DateTime", ts)
    calendar_cols = {
        name.replace("_", " "): col
        for name, col in calendar.calendar_columns(F.col("DateTime")).items()
    }
    status = F.col("Booking Status")
    completed = F.coalesce(status == S.COMPLETED, F.lit(False))
    cancelled = F.coalesce(F.lower(status).contains("cancelled"), F.lit(False))
    fare = F.try_divide(F.col("Booking Value"), F.col("Ride Distance"))
    return stamped.withColumns(
        calendar_cols
        | {
            "Is Completed": completed.cast("int"),
            "Is Cancelled": cancelled.cast("int"),
            "Revenue": F.when(completed, F.col("Booking Value")).otherwise(0.0),
            "Fare Per KM": F.when(F.col("Ride Distance") > 0, fare),
        }
    )


PREVIEW_COLUMNS = [
    "Booking ID",
    "Booking Status",
    "DateTime",
    "Hour",
    "Day Name",
    "Is Weekend",
    "Booking Value",
    "Ride Distance",
    "Revenue",
    "Fare Per KM",
]


def feature_preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of the preview columns in a stated order."""
    return with_preview_features(df).orderBy(*order).limit(n).select(*PREVIEW_COLUMNS)


def audit_overview(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, columns, duplicates, missing cells and bad moments in one row.

    Takes the table given: pass it through ``with_preview_features`` to count the
    preview columns as well. ``columns`` limits the cells that are counted;
    duplicate rows are judged on all columns of ``df``.
    """
    columns = list(columns or df.columns)
    ts = calendar.parse_datetime(F.col("Date"), F.col("Time"))
    empty = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    # Cells and moments need no shuffle; ids and rows are counted apart, so no wide row moves.
    counted = df.agg(
        F.count("*").alias("Rows"),
        F.lit(len(columns)).alias("Columns"),
        F.coalesce(F.sum(empty), F.lit(0)).alias("Total Missing Cells"),
        F.count_if(ts.isNull()).alias("Invalid DateTime"),
    )
    ids = duplicate_ids_first(df).withColumnRenamed("Duplicate Values", "Duplicate Booking IDs")
    return side_by_side(counted, duplicate_rows(df), ids)


def numeric_validation(df: DataFrame) -> DataFrame:
    """(column, rule, invalid_values) for the nine value rules."""
    rules = cleaning.validity_rules(df)
    counted = df.agg(
        *[F.count_if(~valid).alias(f"v{i}") for i, (_, _, valid) in enumerate(rules)]
    )
    rows = [(c, [F.lit(rule), F.col(f"v{i}")]) for i, (c, rule, _) in enumerate(rules)]
    return long_rows(counted, "column", rows, ["rule", "invalid_values"])


def cleaning_summary(
    raw: DataFrame,
    clean: DataFrame,
    raw_columns: int,
    clean_columns: Sequence[str],
    deduplicated: DataFrame | None = None,
) -> DataFrame:
    """Counters of a cleaning run in one row, from the raw and the cleaned table.

    ``deduplicated`` is the cleaned table with the undated rows still in it, if the run has
    stored that: then nothing is cleaned again and only two columns of it are read.
    """
    if deduplicated is None:
        texts = raw.transform(cleaning.clean_text_columns).distinct()
        stamp = calendar.parse_datetime(F.col("Date"), F.col("Time"))
        deduplicated = texts.withColumn("DateTime", stamp)
    per_id = deduplicated.groupBy("Booking ID").agg(
        F.count("*").alias("kept"), (F.count("*") - F.count("DateTime")).alias("bad")
    )
    all_rows = raw.agg(F.count("*")).scalar()
    repeated = F.col("kept") > 1
    before = per_id.agg(
        F.any_value(all_rows).alias("original_rows"),
        F.lit(raw_columns).alias("original_columns"),
        (F.any_value(all_rows) - F.coalesce(F.sum("kept"), F.lit(0))).alias(
            "exact_duplicate_rows_removed"
        ),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_datetime_rows_removed"),
        F.count(F.when(repeated, F.col("Booking ID"))).alias("duplicate_booking_ids_found"),
        F.coalesce(F.sum(F.when(repeated, F.col("kept"))), F.lit(0)).alias(
            "rows_with_duplicate_booking_ids"
        ),
    )
    after = clean.agg(
        F.count("*").alias("final_rows"),
        F.lit(len(clean_columns)).alias("final_columns"),
        _total(clean_columns).alias("missing_values_remaining"),
        F.sum("Is_Completed").alias("completed_bookings"),
        F.sum("Is_Cancelled").alias("cancelled_bookings"),
        F.sum("Is_Incomplete").alias("incomplete_bookings"),
        F.sum("Is_No_Driver_Found").alias("no_driver_found_bookings"),
        round_half_up(exact_sum(F.col("Revenue")), 2).alias("total_revenue_completed_rides"),
    )
    return side_by_side(before, after)
