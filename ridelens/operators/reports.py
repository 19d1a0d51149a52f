"""Grouped reports and KPIs.

All are partial and final hash aggregations over a few columns of the cleaned
table; only the small results are joined to fixed rows, ranked or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions import calendar, text
from ridelens.functions.numbers import (
    exact_mean,
    exact_sum,
    percent,
    percent_or_zero,
    round_half_up,
)
from ridelens.functions.ranking import quantile_columns
from ridelens.functions.tables import fixed_rows, long_rows, share, side_by_side


def bookings() -> Column:
    return F.count("Booking ID")


def flagged(flag: str) -> Column:
    return F.coalesce(F.sum(flag), F.lit(0))


def revenue(basis: str = "completed") -> Column:
    """Money of a group.

    ``completed``: the ``Revenue`` column, completed rides only. ``recorded``:
    the booking value of every status that has one, incomplete rides included.
    """
    columns = {"completed": "Revenue", "recorded": "Booking Value"}
    if basis not in columns:
        raise ValueError(f"unknown revenue basis: {basis}")
    return round_half_up(exact_sum(F.col(columns[basis])), 2)


def mean2(column: str) -> Column:
    return round_half_up(exact_mean(F.col(column)), 2)


def rate(part: str, whole: str, digits: int | None = 2) -> Column:
    value = percent(F.col(part), F.col(whole))
    return value if digits is None else round_half_up(value, digits)


def bookings_by(
    df: DataFrame,
    keys: Sequence[str | Column],
    measures: dict[str, Column],
    rates: dict[str, tuple[str, str]] | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Aggregates per key and percentages between them.

    Rows with a missing key are left out. ``rates`` maps a new column to the
    (part, whole) columns it divides.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    present = df
    for c in columns:
        present = present.filter(c.isNotNull())
    grouped = present.groupBy(*columns).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.withColumns(
        {name: rate(part, whole, digits) for name, (part, whole) in (rates or {}).items()}
    )


def completed_rides(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Is_Completed") == 1)


# --- KPIs ------------------------------------------------------------------


def _over_completed(column: str) -> Column:
    return exact_mean(F.when(F.col("Is_Completed") == 1, F.col(column)))


def kpi_columns(money_basis: str = "booking_value") -> list[Column]:
    """The 14 KPIs as aggregates, rounded to two decimals.

    ``money_basis`` names the source of the revenue: the ``Revenue`` column or
    the booking values of completed rides. They agree unless values are missing.
    """
    money = (
        F.col("Revenue")
        if money_basis == "revenue"
        else F.when(F.col("Is_Completed") == 1, F.col("Booking Value"))
    )
    total = F.count("*")

    def ratio(flag: str) -> Column:
        return round_half_up(percent_or_zero(flagged(flag), total), 2)

    return [
        total.alias("total_bookings"),
        flagged("Is_Completed").alias("completed_bookings"),
        flagged("Is_Cancelled").alias("cancelled_bookings"),
        flagged("Is_Incomplete").alias("incomplete_bookings"),
        flagged("Is_No_Driver_Found").alias("no_driver_found"),
        ratio("Is_Completed").alias("completion_rate"),
        ratio("Is_Cancelled").alias("cancellation_rate"),
        ratio("Is_Incomplete").alias("incomplete_rate"),
        ratio("Is_No_Driver_Found").alias("no_driver_found_rate"),
        round_half_up(exact_sum(money), 2).alias("completed_ride_revenue"),
        round_half_up(_over_completed("Booking Value"), 2).alias("average_booking_value"),
        round_half_up(_over_completed("Ride Distance"), 2).alias("average_ride_distance"),
        round_half_up(_over_completed("Driver Ratings"), 2).alias("average_driver_rating"),
        round_half_up(_over_completed("Customer Rating"), 2).alias("average_customer_rating"),
    ]


def insight_kpis(df: DataFrame, money_basis: str = "booking_value") -> DataFrame:
    """The 14 KPIs in one row."""
    return df.agg(*kpi_columns(money_basis))


EXECUTIVE_METRICS = [
    ("Total Bookings", "total_bookings"),
    ("Completed Bookings", "completed_bookings"),
    ("Cancelled Bookings", "cancelled_bookings"),
    ("Incomplete Bookings", "incomplete_bookings"),
    ("No Driver Found", "no_driver_found"),
    ("Completion Rate (%)", "completion_rate"),
    ("Cancellation Rate (%)", "cancellation_rate"),
    ("No Driver Found Rate (%)", "no_driver_found_rate"),
    ("Incomplete Rate (%)", "incomplete_rate"),
    ("Completed Ride Revenue", "completed_ride_revenue"),
    ("Average Booking Value", "average_booking_value"),
    ("Average Ride Distance", "average_ride_distance"),
    ("Average Driver Rating", "average_driver_rating"),
    ("Average Customer Rating", "average_customer_rating"),
]


def executive_kpis(df: DataFrame) -> DataFrame:
    """The 14 KPIs as (Metric, Value)."""
    rows = [(label, [F.col(c).cast("double")]) for label, c in EXECUTIVE_METRICS]
    return long_rows(insight_kpis(df, "revenue"), "Metric", rows, ["Value"])


# --- status, vehicle, time -------------------------------------------------


def booking_status_analysis(df: DataFrame) -> DataFrame:
    """Per status: bookings, revenue, mean value and distance, share of all rows."""
    report = bookings_by(
        df,
        ["Booking Status"],
        {
            "Bookings": bookings(),
            "Revenue": revenue(),
            "Avg_Booking_Value": mean2("Booking Value"),
            "Avg_Ride_Distance": mean2("Ride Distance"),
        },
    )
    all_rows = df.groupBy("Booking Status").agg(F.count("*").alias("n"))
    return report.withColumn(
        "Booking_Percentage", round_half_up(share(F.col("Bookings"), all_rows, "n"), 2)
    ).orderBy("Booking Status")


_LONG_RATES = {
    "Completion_Rate": ("Completed_Bookings", "Total_Bookings"),
    "Cancellation_Rate": ("Cancelled_Bookings", "Total_Bookings"),
}


def _long_counts() -> dict[str, Column]:
    return {
        "Total_Bookings": bookings(),
        "Completed_Bookings": flagged("Is_Completed"),
        "Cancelled_Bookings": flagged("Is_Cancelled"),
        "Revenue": revenue(),
    }


def vehicle_performance(df: DataFrame) -> DataFrame:
    """Per vehicle type: eight measures and two rates, highest revenue first."""
    measures = _long_counts() | {
        "Avg_Booking_Value": mean2("Booking Value"),
        "Avg_Ride_Distance": mean2("Ride Distance"),
        "Avg_Driver_Rating": mean2("Driver Ratings"),
        "Avg_Customer_Rating": mean2("Customer Rating"),
    }
    return bookings_by(df, ["Vehicle Type"], measures, _LONG_RATES).orderBy(
        F.desc("Revenue"), "Vehicle Type"
    )


_SHORT_RATES = {
    "Completion_Rate": ("Completed", "Bookings"),
    "Cancellation_Rate": ("Cancelled", "Bookings"),
}


def demand_by(df: DataFrame, key: str) -> DataFrame:
    """Bookings, completed, cancelled, revenue and both rates per ``key``."""
    measures = {
        "Bookings": bookings(),
        "Completed": flagged("Is_Completed"),
        "Cancelled": flagged("Is_Cancelled"),
        "Revenue": revenue(),
    }
    return bookings_by(df, [key], measures, _SHORT_RATES)


def hourly_demand(df: DataFrame) -> DataFrame:
    return demand_by(df, "Hour").orderBy("Hour")


def day_of_week(df: DataFrame) -> DataFrame:
    """The seven days in calendar order; a day without bookings has NULLs."""
    return on_weekday_spine(demand_by(df, "Day_Name"))


def on_weekday_spine(report: DataFrame) -> DataFrame:
    """Reindex a per-day report to the seven days in calendar order."""
    spine = fixed_rows(
        report.sparkSession, list(enumerate(S.WEEKDAYS)), "position int, Day_Name string"
    )
    return spine.join(report, "Day_Name", "left").orderBy("position").drop("position")


def time_period_analysis(df: DataFrame) -> DataFrame:
    return demand_by(df, "Time_Period").orderBy("Time_Period")


# --- revenue ---------------------------------------------------------------


def revenue_summary(df: DataFrame) -> DataFrame:
    """(Metric, Value) of completed rides' values, distance and fares."""
    rides = completed_rides(df)
    value = F.col("Booking Value")
    one = side_by_side(
        rides.agg(
            exact_sum(value).alias("sum"),
            exact_mean(value).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            exact_mean(F.col("Ride Distance")).alias("distance"),
            exact_mean(F.col("Fare_Per_KM")).alias("fare"),
        ),
        quantile_columns(rides, ["Booking Value"], {"median": 0.5}).select("median"),
    )
    labels = [
        ("Total Revenue", "sum"),
        ("Average Revenue per Completed Ride", "mean"),
        ("Median Revenue per Completed Ride", "median"),
        ("Minimum Booking Value", "min"),
        ("Maximum Booking Value", "max"),
        ("Average Ride Distance", "distance"),
        ("Average Fare per KM", "fare"),
    ]
    rows = [(label, [round_half_up(F.col(c), 2)]) for label, c in labels]
    return long_rows(one, "Metric", rows, ["Value"])


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Completed rides per month: count, revenue, mean value."""
    return bookings_by(
        completed_rides(df),
        ["Year", "Month"],
        {
            "Completed_Bookings": bookings(),
            "Revenue": revenue("recorded"),
            "Avg_Booking_Value": mean2("Booking Value"),
        },
    ).orderBy("Year", "Month")


def month_trend(df: DataFrame) -> DataFrame:
    """(Month, Revenue) labelled ``2024-03``; no rows unless several months exist."""
    monthly = monthly_revenue(df)
    months = monthly.agg(F.count("*").alias("n")).scalar()
    return monthly.filter(months > 1).select(
        calendar.month_label(F.col("Year"), F.col("Month")).alias("Month"), "Revenue"
    ).orderBy("Month")


# --- cancellations ---------------------------------------------------------


def reason_counts(df: DataFrame, status: str, column: str, name: str) -> DataFrame:
    return bookings_by(df.filter(F.col("Booking Status") == status), [column], {name: bookings()})


def _cancel_reasons(df: DataFrame, status: str, column: str) -> DataFrame:
    counts = reason_counts(df, status, column, "Cancelled_Bookings")
    percentage = share(F.col("Cancelled_Bookings"), counts, "Cancelled_Bookings")
    return counts.withColumn("Percentage", round_half_up(percentage, 2)).orderBy(
        F.desc("Cancelled_Bookings"), column
    )


def customer_cancel_reasons(df: DataFrame) -> DataFrame:
    return _cancel_reasons(df, S.CANCELLED_BY_CUSTOMER, "Reason for cancelling by Customer")


def driver_cancel_reasons(df: DataFrame) -> DataFrame:
    return _cancel_reasons(df, S.CANCELLED_BY_DRIVER, "Driver Cancellation Reason")


def top_reasons(df: DataFrame, status: str, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent reasons of one canceller, by rows."""
    counts = bookings_by(
        df.filter(F.col("Booking Status") == status), [column], {"Bookings": F.count("*")}
    )
    return top_k(counts.withColumnRenamed(column, "Reason"), "Bookings", n, ["Reason"])


# --- places and routes -----------------------------------------------------


def top_k(df: DataFrame, by: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties by ``tie_break`` ascending."""
    return df.orderBy(F.desc(by), *tie_break).limit(k)


def pickup_analysis(df: DataFrame) -> DataFrame:
    measures = _long_counts() | {"Avg_Ride_Distance": mean2("Ride Distance")}
    return bookings_by(df, ["Pickup Location"], measures, _LONG_RATES).orderBy(
        F.desc("Total_Bookings"), "Pickup Location"
    )


def drop_analysis(df: DataFrame) -> DataFrame:
    return bookings_by(df, ["Drop Location"], _long_counts(), _LONG_RATES).orderBy(
        F.desc("Total_Bookings"), "Drop Location"
    )


def route_analysis(df: DataFrame) -> DataFrame:
    measures = _long_counts() | {
        "Avg_Ride_Distance": mean2("Ride Distance"),
        "Avg_Booking_Value": mean2("Booking Value"),
    }
    return bookings_by(df, ["Pickup Location", "Drop Location"], measures, _LONG_RATES).orderBy(
        F.desc("Total_Bookings"), "Pickup Location", "Drop Location"
    )


def chart_top_pickups(df: DataFrame, n: int = 15) -> DataFrame:
    return top_k(pickup_analysis(df), "Total_Bookings", n, ["Pickup Location"])


def chart_top_routes(df: DataFrame, n: int = 15) -> DataFrame:
    top = top_k(route_analysis(df), "Total_Bookings", n, ["Pickup Location", "Drop Location"])
    return top.withColumn("Route", text.route_label())


def top_vehicles_by_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    report = bookings_by(
        df,
        ["Vehicle Type"],
        {
            "Bookings": bookings(),
            "Completed": flagged("Is_Completed"),
            "Revenue": revenue(),
            "Cancellation_Rate": round_half_up(
                percent(flagged("Is_Cancelled"), F.count("Is_Cancelled")), 2
            ),
        },
    )
    return top_k(report, "Revenue", n, ["Vehicle Type"])


def _short_counts() -> dict[str, Column]:
    return {
        "Bookings": bookings(),
        "Completed": flagged("Is_Completed"),
        "Revenue": revenue(),
    }


def top_pickups(df: DataFrame, n: int = 20) -> DataFrame:
    report = bookings_by(df, ["Pickup Location"], _short_counts())
    return top_k(report, "Bookings", n, ["Pickup Location"])


def top_routes(df: DataFrame, n: int = 20) -> DataFrame:
    report = bookings_by(df, ["Pickup Location", "Drop Location"], _short_counts())
    top = top_k(report, "Bookings", n, ["Pickup Location", "Drop Location"])
    return top.withColumn("Route", text.route_label())


# --- payment, ratings, waiting, distance -----------------------------------


def payment_analysis(df: DataFrame) -> DataFrame:
    """Per payment method; the share is of bookings that have one."""
    report = bookings_by(
        df,
        ["Payment Method"],
        {
            "Bookings": bookings(),
            "Completed_Bookings": flagged("Is_Completed"),
            "Revenue": revenue(),
            "Avg_Booking_Value": mean2("Booking Value"),
        },
        {"Completion_Rate": ("Completed_Bookings", "Bookings")},
    )
    counts = bookings_by(df, ["Payment Method"], {"n": bookings()})
    return report.withColumn(
        "Booking_Percentage", round_half_up(share(F.col("Bookings"), counts, "n"), 2)
    ).orderBy(F.desc("Bookings"), "Payment Method")


def rating_summary(df: DataFrame) -> DataFrame:
    """(Metric, Value): mean (0 if there is none) and median of both ratings."""
    medians = quantile_columns(df, S.RATING_COLUMNS, {"median": 0.5})
    one = side_by_side(
        df.agg(
            F.coalesce(mean2("Driver Ratings"), F.lit(0.0)).alias("driver_mean"),
            F.coalesce(mean2("Customer Rating"), F.lit(0.0)).alias("customer_mean"),
        ),
        medians.agg(
            F.max(F.when(F.col("column") == "Driver Ratings", F.col("median"))).alias("driver"),
            F.max(F.when(F.col("column") == "Customer Rating", F.col("median"))).alias("customer"),
        ),
    )
    rows = [
        ("Average Driver Rating", [F.col("driver_mean")]),
        ("Average Customer Rating", [F.col("customer_mean")]),
        ("Median Driver Rating", [round_half_up(F.col("driver"), 2)]),
        ("Median Customer Rating", [round_half_up(F.col("customer"), 2)]),
    ]
    return long_rows(one, "Metric", rows, ["Value"])


def rating_distribution(df: DataFrame, column: str, name: str) -> DataFrame:
    """Count per rating value, ascending."""
    return (
        bookings_by(df, [column], {"Count": F.count("*")})
        .withColumnRenamed(column, name)
        .orderBy(name)
    )


def driver_rating_distribution(df: DataFrame) -> DataFrame:
    return rating_distribution(df, "Driver Ratings", "Driver_Rating")


def customer_rating_distribution(df: DataFrame) -> DataFrame:
    return rating_distribution(df, "Customer Rating", "Customer_Rating")


def _wait_by(df: DataFrame, key: str) -> DataFrame:
    measures = {
        "Avg_VTAT": mean2("Avg VTAT"),
        "Avg_CTAT": mean2("Avg CTAT"),
        "Bookings": bookings(),
    }
    return bookings_by(df, [key], measures).orderBy(key)


def wait_by_status(df: DataFrame) -> DataFrame:
    return _wait_by(df, "Booking Status")


def wait_by_vehicle(df: DataFrame) -> DataFrame:
    return _wait_by(df, "Vehicle Type")


def distance_summary(df: DataFrame) -> DataFrame:
    """(Metric, Value) of completed rides' distances."""
    rides = completed_rides(df)
    distance = F.col("Ride Distance")
    one = side_by_side(
        rides.agg(
            exact_mean(distance).alias("mean"),
            F.min(distance).alias("min"),
            F.max(distance).alias("max"),
        ),
        quantile_columns(rides, ["Ride Distance"], {"median": 0.5}).select("median"),
    )
    labels = [
        ("Average Distance", "mean"),
        ("Median Distance", "median"),
        ("Minimum Distance", "min"),
        ("Maximum Distance", "max"),
    ]
    rows = [(label, [round_half_up(F.col(c), 2)]) for label, c in labels]
    return long_rows(one, "Metric", rows, ["Value"])
