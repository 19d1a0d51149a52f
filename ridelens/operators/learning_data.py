"""Targets, features, exact stratified split, imputation values, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions.ranking import bucket_starts, quantile_columns
from ridelens.operators.profiling import value_counts_by_column

TARGET = "Target_Completed"

PREBOOKING_FEATURES = [
    "Vehicle Type",
    "Pickup Location",
    "Drop Location",
    "Hour",
    "Day_of_Week",
    "Is_Weekend",
    "Time_Period",
    "Payment Method",
]
WIDE_FEATURES = [
    "Vehicle Type",
    "Pickup Location",
    "Drop Location",
    "Avg VTAT",
    "Avg CTAT",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
    "Payment Method",
    "Hour",
    "Day_of_Week",
    "Is_Weekend",
    "Time_Period",
]
CATEGORICAL_FEATURES = [
    "Vehicle Type",
    "Pickup Location",
    "Drop Location",
    "Time_Period",
    "Payment Method",
]


def categorical(features: Sequence[str]) -> list[str]:
    return [c for c in CATEGORICAL_FEATURES if c in features]


def numeric(features: Sequence[str]) -> list[str]:
    return [c for c in features if c not in CATEGORICAL_FEATURES]


def add_target(df: DataFrame) -> DataFrame:
    """``Target_Completed``: 1 for completed bookings."""
    done = F.coalesce(F.col("Booking Status") == S.COMPLETED, F.lit(False))
    return df.withColumn(TARGET, done.cast("int"))


def features(
    df: DataFrame, wanted: Sequence[str] = tuple(PREBOOKING_FEATURES), keep: Sequence[str] = ()
) -> DataFrame:
    """The features that are present, the target, and the columns of ``keep``."""
    present = [c for c in wanted if c in df.columns]
    return df.transform(add_target).select(*keep, *present, TARGET)


def target_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(TARGET).agg(F.count("*").alias("Count")).orderBy(TARGET)


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (2 * rows of the class)."""
    counts = df.groupBy(TARGET).agg(F.count("*").alias("Count"))
    total = counts.agg(F.sum("Count")).scalar()
    weight = total.cast("double") / (F.col("Count") * 2)
    return counts.withColumn("Weight", weight)


SPLIT_BUCKETS = 1 << 16


def split_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """A hash of the row key in ``[0, 2**31)``."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 31))


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Column | None = None,
    test_fraction: float = 0.2,
    label: str = TARGET,
) -> DataFrame:
    """Adds ``Is_Test``: exactly ``round(test_fraction * n)`` rows of each class.

    The test rows are those with the smallest hashes. Counting the rows per hash
    bucket finds the bucket in which each class reaches its size; only the rows
    of that bucket, one in ``SPLIT_BUCKETS``, are ranked to find the last test row.
    The split is then a comparison with that row. ``keys`` must identify a row;
    ``order`` is an integer hash in ``[0, 2**31)``.
    """
    order = split_hash(keys) if order is None else order
    width = (1 << 31) // SPLIT_BUCKETS
    position = F.struct(order.alias("order"), *keys)
    placed = df.select(
        F.col(label), position.alias("_at"), F.floor(order / width).cast("int").alias("_bucket")
    )
    counts = placed.groupBy(label, "_bucket").agg(F.count("*").alias("n"))
    wanted = F.floor(F.col("n_total") * test_fraction + 0.5).cast("long")
    border = (
        bucket_starts(counts, [label], "_bucket", ["n"])
        .withColumn("wanted", wanted)
        .filter((F.col("n_start") < F.col("wanted")) & (F.col("n_start") + F.col("n") >= F.col("wanted")))
        .select(label, "_bucket", (F.col("wanted") - F.col("n_start")).alias("take"))
    )
    # One row per class on the broadcast side of both joins.
    in_border = placed.join(F.broadcast(border), [label, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_at"))
    last = (
        in_border.withColumn("rank", rank)
        .filter(F.col("rank") == F.col("take"))
        .select(label, F.col("_at").alias("_last"))
    )
    return (
        df.join(F.broadcast(last), label, "left")
        .withColumn("Is_Test", F.coalesce(position <= F.col("_last"), F.lit(False)).cast("int"))
        .drop("_last")
    )


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(Column, Value): exact medians."""
    return quantile_columns(df, columns, {"Value": 0.5}).withColumnRenamed("column", "Column")


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(Column, Value): most frequent text, the smallest on a tie."""
    counts = value_counts_by_column(df, columns).filter(F.col("Value").isNotNull())
    best = F.min_by("Value", F.struct(-F.col("Count"), F.col("Value")))
    return counts.groupBy("Column").agg(best.alias("Value"))
