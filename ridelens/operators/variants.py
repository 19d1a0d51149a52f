"""Reports of the alternative rules (see ``clean_bookings_alternative``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.numbers import exact_mean, round_half_up
from ridelens.functions.tables import long_rows
from ridelens.operators import profiling, reports
from ridelens.operators.reports import bookings_by, flagged, revenue, top_k

DESCRIBED = ["Driver Ratings", "Customer Rating", "Ride Distance", "Avg VTAT", "Avg CTAT"]


def vehicle(df: DataFrame) -> DataFrame:
    """Rows, completed, revenue per vehicle type; the rate is a fraction."""
    report = bookings_by(
        df,
        ["Vehicle Type"],
        {
            "Bookings": F.count("*"),
            "Completed": flagged("Is_Completed"),
            "Revenue": revenue(),
        },
    )
    rate = F.try_divide(F.col("Completed").cast("double"), F.col("Bookings").cast("double"))
    return report.withColumn("Completion_Rate", rate).orderBy(F.desc("Bookings"), "Vehicle Type")


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; ``n`` keeps the top ones."""
    counts = bookings_by(df, [column], {"Bookings": F.count("*")})
    if n is not None:
        return top_k(counts, "Bookings", n, [column])
    return counts.orderBy(F.desc("Bookings"), column)


def kpis(df: DataFrame) -> DataFrame:
    """(Metric, Value): counts, rates as fractions, means over all rated rows."""
    total = F.count("*")
    done = F.col("Is_Completed") == 1

    def fraction(flag: str):
        return round_half_up(F.try_divide(flagged(flag).cast("double"), total), 6)

    one = df.agg(
        total.cast("double").alias("Total Bookings"),
        flagged("Is_Completed").cast("double").alias("Completed Bookings"),
        flagged("Is_Cancelled").cast("double").alias("Cancelled Bookings"),
        flagged("Is_Incomplete").cast("double").alias("Incomplete Bookings"),
        flagged("Is_No_Driver_Found").cast("double").alias("No Driver Found"),
        fraction("Is_Completed").alias("Completion Rate"),
        fraction("Is_Cancelled").alias("Cancellation Rate"),
        fraction("Is_No_Driver_Found").alias("No Driver Found Rate"),
        fraction("Is_Incomplete").alias("Incomplete Rate"),
        revenue().alias("Completed Ride Revenue"),
        round_half_up(exact_mean(F.when(done, F.col("Booking Value"))), 2).alias(
            "Average Booking Value"
        ),
        round_half_up(exact_mean(F.when(done, F.col("Ride Distance"))), 2).alias(
            "Average Ride Distance"
        ),
        reports.mean2("Driver Ratings").alias("Average Driver Rating"),
        reports.mean2("Customer Rating").alias("Average Customer Rating"),
    )
    return long_rows(one, "Metric", [(c, [F.col(c)]) for c in one.columns], ["Value"])


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Revenue of completed rides per month; rows with a bad date are left out."""
    return bookings_by(
        reports.completed_rides(df), ["Year", "Month"], {"Revenue": revenue()}
    ).orderBy("Year", "Month")


def revenue_by_vehicle(df: DataFrame) -> DataFrame:
    return bookings_by(
        reports.completed_rides(df), ["Vehicle Type"], {"Revenue": revenue()}
    ).orderBy(F.desc("Revenue"), "Vehicle Type")


def describe(df: DataFrame) -> DataFrame:
    """``numeric_summary`` of ratings, distance and waiting times."""
    return profiling.numeric_summary(df, DESCRIBED)
