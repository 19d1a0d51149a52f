"""Ranks and quantiles over counted values, without one task seeing them all.

A running total over a whole column needs a global order. Here the values are
counted first, the counts are split into ordered buckets, a running total over
the few bucket totals gives each bucket its start, and only then is each bucket
ordered on its own. A value held by any share of the rows is one counted row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most cuts of a bucket with a wanted rank. There are about as many as the square root of
#: its number of distinct values, so that a bucket has about as many pieces as a piece has
#: values, up to 2**32 values; beyond that pieces grow and their sorting spills.
MOST_CUTS = 1 << 16
#: Every so many cuts are looked at first when a value looks for its piece.
STRIDE = 256


def magnitude_bucket(value: Column, per_unit: int = 256) -> Column:
    """Ordered integer bucket of a double, about 0.4 % of the value wide.

    Needs no pass over the data to find bounds, keeps order because the logarithm
    is monotone, and gives at most a few thousand buckets for values below 1e9.
    """
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * per_unit).cast("long")


def bucket_starts(
    counts: DataFrame, group: Sequence[str], bucket: str, measures: Sequence[str]
) -> DataFrame:
    """Per group and bucket: each measure's sum, its start and its group total.

    The windows run over bucket totals, whose number the bucketing bounds.
    """
    totals = counts.groupBy(*group, bucket).agg(*[F.sum(m).alias(m) for m in measures])
    before = (
        Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*group)
    extra = {}
    for m in measures:
        extra[f"{m}_start"] = F.coalesce(F.sum(m).over(before), F.lit(0))
        extra[f"{m}_total"] = F.sum(m).over(whole)
    return totals.withColumns(extra)


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-missing values of double columns.

    Counted before the shuffle: what moves is one row per distinct value.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )


def _holds_rank(start: str) -> Column:
    return (F.col(start) <= F.col("high")) & (F.col(start) + F.col("n") > F.col("low"))


def _piece(value: Column, cuts: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by two short looks."""
    coarse = F.filter(cuts, lambda _, at: (at + 1) % STRIDE == 0)
    passed = F.size(F.filter(coarse, lambda cut: cut <= value)) * STRIDE
    near = F.slice(cuts, passed + 1, F.lit(STRIDE))
    return passed + F.size(F.filter(near, lambda cut: cut <= value))


def in_pieces(counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(column, bucket, piece, value, n): the counted values of ``buckets`` (column, bucket,
    values), which are few, in ordered pieces with about equally many distinct values.

    Cuts are values drawn by their hash, so a piece is as small however the values lie, and
    a task that is run again cuts at the same places. With k cuts of m values, a piece of
    more than ``20 * m / k`` values is not to be expected in any run.
    """
    key = ["column", "bucket"]
    wanted = F.least(F.ceil(F.sqrt("values")), F.lit(MOST_CUTS))
    drawn = F.pmod(F.xxhash64("value"), F.lit(1 << 52)) / float(1 << 52) < wanted / F.col("values")
    # One row for each wanted bucket, of at most some MOST_CUTS values: bounded, so a dense
    # bucket stays spread over the tasks that counted it.
    inside = counts.join(F.broadcast(buckets), key)
    cuts = inside.filter(drawn).groupBy(*key).agg(F.sort_array(F.collect_list("value")).alias("cuts"))
    placed = inside.join(F.broadcast(cuts), key, "left")
    # A small bucket may have drawn none: it is one piece.
    piece = F.coalesce(_piece(F.col("value"), F.col("cuts")), F.lit(0))
    return placed.select(*key, piece.alias("piece"), "value", "n")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """(column, probability, quantile): exact, linear between neighbours.

    Only the buckets that hold a wanted rank are looked at again. Such a bucket is cut into
    pieces of about equally many values, and only the piece with the rank is ordered, so
    neither a dense column nor one that piles up at a point gathers in one task.
    """
    # Stating that the bucket is present keeps all uses of ``counts`` the same plan,
    # so that the counting runs once and its exchange is used again.
    counts = (
        value_counts_long(df, columns)
        .withColumn("bucket", magnitude_bucket(F.col("value")))
        .withColumn("values", F.lit(1))
        .filter(F.col("bucket").isNotNull())
    )
    probs = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    rank = F.col("probability") * (F.col("n_total") - 1)
    wanted = (
        bucket_starts(counts, ["column"], "bucket", ["n", "values"])
        .withColumn("probability", probs)
        .withColumns({"rank": rank, "low": F.floor(rank), "high": F.ceil(rank)})
        .filter(_holds_rank("n_start"))
    )
    key = ["column", "bucket"]
    buckets = wanted.groupBy(*key).agg(F.max("values").alias("values"))
    inside = in_pieces(counts.drop("values"), buckets)
    earlier = Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        inside.groupBy(*key, "piece")
        .agg(F.sum("n").alias("n"))
        .withColumn("piece_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(F.broadcast(wanted.select(*key, "probability", "rank", "low", "high", "n_start")), key)
        .withColumn("piece_start", F.col("n_start") + F.col("piece_start"))
        .filter(_holds_rank("piece_start"))
        .select(*key, "piece", "probability", "rank", "low", "high", "piece_start")
    )
    # At most two pieces hold the two neighbours of a rank.
    within = (
        Window.partitionBy(*key, "piece", "probability")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = inside.join(F.broadcast(pieces), [*key, "piece"]).withColumn(
        "before", F.col("piece_start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    )
    hits = placed.filter(_holds_rank("before"))
    low, high = F.min("value"), F.max("value")
    part = F.max(F.col("rank") - F.col("low"))
    return hits.groupBy("column", "probability").agg((low + (high - low) * part).alias("quantile"))


def quantile_columns(
    df: DataFrame, columns: Sequence[str], names: dict[str, float]
) -> DataFrame:
    """One row per column with a named column per probability."""
    q = exact_quantiles(df, columns, sorted(set(names.values())))
    return q.groupBy("column").agg(
        *[
            F.max(F.when(F.col("probability") == float(p), F.col("quantile"))).alias(name)
            for name, p in names.items()
        ]
    )
