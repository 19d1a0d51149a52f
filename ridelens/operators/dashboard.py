"""Tables behind the dashboard; each takes the already filtered bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions import text
from ridelens.functions.numbers import exact_mean, exact_sum, percent_or_zero, round_half_up
from ridelens.operators import cleaning, filters, reports
from ridelens.operators.reports import bookings, bookings_by, flagged, revenue, top_k


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Totals, rates (0 for no rows), completed value, mean value and distance."""
    total = F.count("*")
    done = F.col("Is_Completed") == 1
    value, distance = (F.when(done, F.col(c)) for c in ("Booking Value", "Ride Distance"))
    completed = flagged("Is_Completed")

    def mean_or_zero(column):
        return F.when(completed > 0, round_half_up(exact_mean(column), 6)).otherwise(0.0)

    return df.agg(
        total.alias("total_bookings"),
        completed.alias("completed"),
        flagged("Is_Cancelled").alias("cancelled"),
        flagged("Is_No_Driver_Found").alias("no_driver"),
        percent_or_zero(completed, total).alias("completion_rate"),
        percent_or_zero(flagged("Is_Cancelled"), total).alias("cancellation_rate"),
        percent_or_zero(flagged("Is_No_Driver_Found"), total).alias("no_driver_rate"),
        round_half_up(exact_sum(value), 2).alias("revenue"),
        mean_or_zero(value).alias("average_booking_value"),
        mean_or_zero(distance).alias("average_distance"),
    )


def _counts(df: DataFrame, key: str) -> DataFrame:
    return bookings_by(df, [key], {"Bookings": F.count("*")})


def status_counts(df: DataFrame) -> DataFrame:
    return _counts(df, "Booking Status").orderBy(F.desc("Bookings"), "Booking Status")


def hourly(df: DataFrame) -> DataFrame:
    return _counts(df, "Hour").orderBy("Hour")


def vehicle(df: DataFrame) -> DataFrame:
    """Per vehicle type; money counts every status that has a value."""
    measures = {
        "Bookings": bookings(),
        "Completed": flagged("Is_Completed"),
        "Cancelled": flagged("Is_Cancelled"),
        "Revenue": revenue("recorded"),
    }
    rates = {
        "Completion Rate": ("Completed", "Bookings"),
        "Cancellation Rate": ("Cancelled", "Bookings"),
    }
    return bookings_by(df, ["Vehicle Type"], measures, rates, digits=None).orderBy(
        F.desc("Bookings"), "Vehicle Type"
    )


def time_period(df: DataFrame) -> DataFrame:
    return _counts(df, "Time_Period").orderBy("Time_Period")


def day_of_week(df: DataFrame) -> DataFrame:
    return reports.on_weekday_spine(_counts(df, "Day_Name"))


def payment(df: DataFrame) -> DataFrame:
    measures = {"Bookings": bookings(), "Revenue": revenue("recorded")}
    return bookings_by(df, ["Payment Method"], measures).orderBy(
        F.desc("Bookings"), "Payment Method"
    )


def top_pickups(df: DataFrame, n: int = 15) -> DataFrame:
    return top_k(_counts(df, "Pickup Location"), "Bookings", n, ["Pickup Location"])


def top_drops(df: DataFrame, n: int = 15) -> DataFrame:
    return top_k(_counts(df, "Drop Location"), "Bookings", n, ["Drop Location"])


def top_routes(df: DataFrame, n: int = 15) -> DataFrame:
    measures = {
        "Bookings": bookings(),
        "Completed": flagged("Is_Completed"),
        "Revenue": revenue("recorded"),
    }
    report = bookings_by(
        df,
        [text.route_label().alias("Route")],
        measures,
        {"Completion Rate": ("Completed", "Bookings")},
        digits=None,
    )
    return top_k(report, "Bookings", n, ["Route"])


def _reasons(df: DataFrame, status: str, column: str, n: int, also: tuple[str, ...]) -> DataFrame:
    rows = df.filter(text.strip_space(F.col("Booking Status")) == status)
    named = filters.filter_nonblank_reason(rows, column, also)
    counts = _counts(named, column).withColumnRenamed(column, "Reason")
    return top_k(counts, "Bookings", n, ["Reason"])


def driver_reasons(df: DataFrame, n: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    return _reasons(df, S.CANCELLED_BY_DRIVER, "Driver Cancellation Reason", n, also)


def customer_reasons(df: DataFrame, n: int = 10, also: tuple[str, ...] = ()) -> DataFrame:
    return _reasons(df, S.CANCELLED_BY_CUSTOMER, "Reason for cancelling by Customer", n, also)


def rating_means(df: DataFrame) -> DataFrame:
    """Mean ratings and distance of completed rides."""
    return reports.completed_rides(df).agg(
        round_half_up(exact_mean(F.col("Driver Ratings")), 2).alias("Average Driver Rating"),
        round_half_up(exact_mean(F.col("Customer Rating")), 2).alias("Average Customer Rating"),
        round_half_up(exact_mean(F.col("Ride Distance")), 2).alias("Average Ride Distance"),
    )


FEATURE_HEADERS = ["feature", "features", "feature_name", "variable"]
IMPORTANCE_HEADERS = [
    "importance",
    "feature_importance",
    "importance_score",
    "score",
    "value",
]


def feature_importance(report: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest importances of a report, whatever it calls its columns."""
    feature = cleaning.first_matching_column(report, FEATURE_HEADERS) or report.columns[0]
    importance = cleaning.first_matching_column(report, IMPORTANCE_HEADERS)
    if importance is None:
        raise ValueError("the report has no importance column")
    rows = report.select(
        F.col(feature).alias("Feature"), F.col(importance).try_cast("double").alias("Importance")
    )
    return top_k(rows.dropna(subset=["Importance"]), "Importance", n, ["Feature"])


def ml_metrics(report: DataFrame) -> DataFrame:
    """A (Metric, Score) report as one row with a column per metric."""
    return report.groupBy().pivot("Metric", METRIC_NAMES).agg(F.first("Score"))


METRIC_NAMES = ["Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"]
