"""Bins, histograms, correlation, calendar series and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions.numbers import exact_sum, round_half_up
from ridelens.functions.tables import fixed_rows, long_rows
from ridelens.operators.reports import completed_rides


def cut_right_closed(
    value: Column, buckets: Sequence[tuple[float, str]], lowest: float = 0.0
) -> Column:
    """Label of the interval ``(previous bound, bound]``; ``lowest`` itself falls in
    the first, anything below it is missing."""
    label = F.when(value < lowest, F.lit(None))
    for upper, name in buckets:
        label = label.when(value <= upper, name)
    return label


def distance_buckets(
    df: DataFrame, buckets: Sequence[tuple[float, str]] = tuple(S.DISTANCE_BUCKETS)
) -> DataFrame:
    """Completed rides per distance bucket, empty buckets as 0, in order."""
    label = cut_right_closed(F.col("Ride Distance"), buckets)
    counts = (
        completed_rides(df)
        .select(label.alias("Distance_Bucket"))
        .groupBy("Distance_Bucket")
        .agg(F.count("*").alias("n"))
    )
    spine = fixed_rows(
        df.sparkSession,
        [(i, name) for i, (_, name) in enumerate(buckets)],
        "position int, Distance_Bucket string",
    )
    return (
        spine.join(counts, "Distance_Bucket", "left")
        .orderBy("position")
        .select("Distance_Bucket", F.coalesce("n", F.lit(0)).cast("long").alias("Completed_Rides"))
    )


def histogram_equal_width(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """(Bin, Lower, Upper, Count): equal bins over the value range, the last closed.

    The range is found first and enters the second scan as two constants.
    """
    values = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    low = values.agg(F.min("x")).scalar()
    high = values.agg(F.max("x")).scalar()
    width = (high - low) / bins
    index = F.least(F.floor(F.try_divide(F.col("x") - low, width)) + 1, F.lit(bins))
    counts = (
        values.select(F.coalesce(index, F.lit(1)).cast("int").alias("Bin"))
        .groupBy("Bin")
        .agg(F.count("*").alias("n"))
    )
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("Bin"))
    return (
        spine.join(counts, "Bin", "left")
        .select(
            "Bin",
            (low + width * (F.col("Bin") - 1)).alias("Lower"),
            (low + width * F.col("Bin")).alias("Upper"),
            F.coalesce("n", F.lit(0)).cast("long").alias("Count"),
        )
        .orderBy("Bin")
    )


def histogram_fixed(
    df: DataFrame, column: str, low: float, high: float, bins: int
) -> DataFrame:
    """``histogram_equal_width`` over a stated range.

    Values outside it are counted in the first or the last bin, so no row is lost.
    """
    width = (high - low) / bins
    x = F.col(column)
    # a hair is added so that a bound such as 3.6 falls in the bin it opens
    place = F.floor((x - low) / width + 1e-9) + 1
    index = F.greatest(F.least(place, F.lit(bins)), F.lit(1)).cast("int")
    counts = (
        df.filter(x.isNotNull())
        .select(index.alias("Bin"))
        .groupBy("Bin")
        .agg(F.count("*").alias("n"))
    )
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("Bin"))
    return (
        spine.join(counts, "Bin", "left")
        .select(
            "Bin",
            F.round(low + width * (F.col("Bin") - 1), 6).alias("Lower"),
            F.round(low + width * F.col("Bin"), 6).alias("Upper"),
            F.coalesce("n", F.lit(0)).cast("long").alias("Count"),
        )
        .orderBy("Bin")
    )


def _pearson(
    n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, varies: Column
) -> Column:
    """Correlation from sums; NULL unless both sides vary.

    Whether they do is asked of the values: in long sums the rounding of a constant looks
    like a small variance.
    """
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    varies = varies & (vx > 0) & (vy > 0)
    return F.when(varies, F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] = tuple(S.CORRELATION_COLUMNS), digits: int = 3
) -> DataFrame:
    """Pairwise Pearson correlations over the rows that have both values.

    One aggregation, by which columns a row has, holds the upper triangle of products; a
    pair adds up the groups that have both its columns, at most ``2**columns`` of them.
    Values are first centred on the column means (constants from a pass before), which
    keeps plain sums accurate.
    """
    columns = [c for c in columns if c in df.columns]
    order = range(len(columns))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])

    def centred(c: str) -> Column:
        return F.col(c).cast("double") - F.coalesce(means.select(c).scalar(), F.lit(0.0))

    values = df.select(*[centred(c).alias(f"x{i}") for i, c in enumerate(columns)])
    has = sum((F.when(F.col(f"x{i}").isNotNull(), 1 << i).otherwise(0) for i in order), F.lit(0).cast("long"))
    x = [F.coalesce(F.col(f"x{i}"), F.lit(0.0)) for i in order]
    sums = {f"s{i}": x[i] for i in order}
    sums |= {f"p{i}_{j}": x[i] * x[j] for i in order for j in order if i <= j}
    groups = values.groupBy(has.alias("has")).agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(e).alias(name) for name, e in sums.items()],
        F.array(*[F.min(f"x{i}") for i in order]).alias("low"),
        F.array(*[F.max(f"x{i}") for i in order]).alias("high"),
    )

    k = len(columns)
    packed = groups.select(
        "has",
        "n",
        "low",
        "high",
        F.array(*[F.col(f"s{i}") for i in order]).alias("s"),
        F.array(*[F.col(f"p{i}_{j}") for i in order for j in order if i <= j]).alias("p"),
        F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("cell"),
    ).select("*", F.expr(f"cell div {k}").cast("int").alias("i"), (F.col("cell") % k).cast("int").alias("j"))

    def product(i: str, j: str) -> Column:
        """The sum of products of two columns, at its place in the triangle's rows."""
        low, high = F.least(F.col(i), F.col(j)), F.greatest(F.col(i), F.col(j))
        before = low * k - F.expr(f"least({i}, {j}) * (least({i}, {j}) - 1) div 2")
        return F.element_at("p", (before + high - low + 1).cast("int"))

    moments = {
        "n": F.col("n"), "sx": F.element_at("s", F.col("i") + 1), "sy": F.element_at("s", F.col("j") + 1),
        "sxx": product("i", "i"), "syy": product("j", "j"), "sxy": product("i", "j"),
    }
    both = packed.filter("shiftright(has, i) & shiftright(has, j) & 1 = 1")

    def varies(place: str) -> Column:
        at = F.col(place) + 1
        return F.min(F.element_at("low", at)) < F.max(F.element_at("high", at))

    summed = both.groupBy("i", "j").agg(
        *[F.sum(m).alias(name) for name, m in moments.items()],
        (varies("i") & varies("j")).alias("varies"),
    )
    r = round_half_up(_pearson(*[F.col(m) for m in moments], F.col("varies")), digits)
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("Column")
    matrix = summed.select(named, "j", r.alias("r")).groupBy("Column").agg(
        *[F.max(F.when(F.col("j") == j, F.col("r"))).alias(c) for j, c in enumerate(columns)]
    )
    # A column without any value still has its row.
    labels = fixed_rows(df.sparkSession, [(c,) for c in columns], "Column string")
    return labels.join(matrix, "Column", "left")


# Steps a reader counts in.
_NICE_STEPS = ("0.01", "0.02", "0.05", "0.1", "0.2", "0.5", "1", "2", "5", "10", "20", "50",
               "100", "200", "500", "1000", "2000", "5000", "10000")


def histogram_nice(df: DataFrame, column: str, most_bins: int = 10) -> DataFrame:
    """(Bin, Lower, Upper, Count) with bins of a round width, chosen from the value range.

    The width is the smallest of 1, 2 or 5 times a power of ten, from 0.01 to 10,000, that
    needs at most ``most_bins`` bins (else the largest); bins start at its multiples and hold
    their lower bound. Values are taken as decimals, so 3.6 opens the bin it should.
    """
    x = F.col(column).cast("decimal(28,6)")
    values = df.select(x.alias("x")).filter("x is not null")
    steps = F.array(*[F.lit(s).cast("decimal(10,2)") for s in _NICE_STEPS])

    def place(value: Column, step: Column) -> Column:
        return F.floor(value / step).cast("long")

    low, high = F.col("low"), F.col("high")
    fitting = F.filter(steps, lambda s: place(high, s) - place(low, s) < most_bins)
    step = F.coalesce(F.try_element_at(fitting, F.lit(1)), F.element_at(steps, -1))
    # One row; the width enters the second scan as a constant.
    bounds = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).withColumn("step", step)
    width = bounds.select("step").scalar()
    counts = values.select(place(F.col("x"), width).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    spine = bounds.select(
        "step", F.explode(F.sequence(place(low, F.col("step")), place(high, F.col("step")))).alias("at")
    )
    first = F.min("at").over(Window.partitionBy("step"))  # at most `most_bins` rows
    return (
        spine.join(counts, "at", "left")
        .select(
            (F.col("at") - first + 1).cast("int").alias("Bin"),
            (F.col("at") * F.col("step")).cast("double").alias("Lower"),
            ((F.col("at") + 1) * F.col("step")).cast("double").alias("Upper"),
            F.coalesce("n", F.lit(0)).cast("long").alias("Count"),
        )
        .orderBy("Bin")
    )


def daily_revenue(df: DataFrame) -> DataFrame:
    """Completed booking value per calendar day, days without rides as 0."""
    rides = completed_rides(df).select(
        F.to_date("DateTime").alias("Day"), F.col("Booking Value")
    ).filter(F.col("Day").isNotNull())
    sums = rides.groupBy("Day").agg(round_half_up(exact_sum(F.col("Booking Value")), 2).alias("v"))
    return on_daily_spine(sums, "Day", "v", "Booking Value")


def on_daily_spine(daily: DataFrame, day: str, value: str, name: str) -> DataFrame:
    """Every day from the first to the last, absent ones as 0."""
    spine = daily.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(
        F.explode(F.sequence("first", "last")).alias(day)
    )
    return spine.join(daily, day, "left").select(
        day, F.coalesce(value, F.lit(0.0)).alias(name)
    ).orderBy(day)


def fixed_size_sample(
    df: DataFrame, columns: Sequence[str], order: Column, n: int = 5000
) -> DataFrame:
    """``n`` rows without missing values, the same rows every time.

    ``order`` is a hash of the row key: the rows with the smallest hashes are a
    uniform sample, found with a top-k per task and one merge.
    """
    return (
        df.dropna(subset=list(columns))
        .withColumn("_order", order)
        .orderBy("_order")
        .limit(n)
        .select(*columns)
    )


def row_cap(df: DataFrame, order: Sequence[str], n: int = 5000) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    """Sample order of a row key. Equal keys only share a hash with equal rows."""
    return F.xxhash64(F.lit(seed), *keys)
