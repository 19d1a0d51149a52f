"""Structured insights: best-of answers, section tables and one nested document.

A section is a grouped table; its headline values are merged maxima over that
table. The document holds every section as a struct of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions import text
from ridelens.functions.numbers import exact_mean, exact_sum, round_half_up, thousands
from ridelens.functions.tables import fixed_rows, side_by_side
from ridelens.operators import dashboard, reports
from ridelens.operators.reports import bookings, bookings_by, flagged, revenue, top_k


def section(
    df: DataFrame,
    key: Column,
    name: str,
    cancelled: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Counts, recorded revenue and unrounded rates per key; ``extra`` adds measures."""
    measures = {"bookings": bookings(), "completed": flagged("Is_Completed")}
    rates = {"completion_rate": ("completed", "bookings")}
    if cancelled:
        measures["cancelled"] = flagged("Is_Cancelled")
        rates["cancellation_rate"] = ("cancelled", "bookings")
    measures |= {"revenue": revenue("recorded")} | (extra or {})
    return bookings_by(df, [key.alias(name)], measures, rates, digits=None)


def best(label: str, by: str) -> Column:
    """The label with the largest ``by``, the smallest label on a tie."""
    return F.min_by(label, F.struct(-F.col(by), F.col(label)))


def records(df: DataFrame, order: Sequence[Column]) -> Column:
    """All rows of a small report as an ordered array of structs."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    entry = F.struct(*keys, F.struct(*df.columns).alias("row"))
    return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["row"])


def vehicle_insights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Vehicle Type"), "Vehicle Type").orderBy(
        F.desc("bookings"), "Vehicle Type"
    )


def vehicle_highlights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Vehicle Type"), "Vehicle Type").agg(
        best("Vehicle Type", "bookings").alias("highest_demand_vehicle"),
        best("Vehicle Type", "revenue").alias("highest_revenue_vehicle"),
        best("Vehicle Type", "completion_rate").alias("highest_completion_vehicle"),
    )


def hourly_insights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Hour"), "Hour").orderBy("Hour")


def hourly_highlights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Hour"), "Hour").agg(
        best("Hour", "bookings").alias("peak_hour"),
        F.max("bookings").alias("peak_hour_bookings"),
        best("Hour", "revenue").alias("highest_revenue_hour"),
        F.max("revenue").alias("highest_hourly_revenue"),
    )


def time_period_insights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Time_Period"), "Time_Period").orderBy("Time_Period")


def time_period_highlights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Time_Period"), "Time_Period").agg(
        best("Time_Period", "bookings").alias("highest_demand_period")
    )


def location_insights(df: DataFrame, n: int = 10) -> DataFrame:
    return top_k(
        section(df, F.col("Pickup Location"), "Pickup Location"),
        "bookings",
        n,
        ["Pickup Location"],
    )


def location_highlights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Pickup Location"), "Pickup Location").agg(
        best("Pickup Location", "bookings").alias("highest_demand_pickup"),
        F.max("bookings").alias("highest_demand_pickup_bookings"),
    )


def route_insights(df: DataFrame, n: int = 10) -> DataFrame:
    return top_k(
        section(df, text.route_label(), "Route", cancelled=False), "bookings", n, ["Route"]
    )


def route_highlights(df: DataFrame) -> DataFrame:
    return section(df, text.route_label(), "Route", cancelled=False).agg(
        best("Route", "bookings").alias("highest_volume_route"),
        F.max("bookings").alias("highest_volume_route_bookings"),
    )


def payment_insights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Payment Method"), "Payment Method", cancelled=False).orderBy(
        "Payment Method"
    )


def payment_highlights(df: DataFrame) -> DataFrame:
    return section(df, F.col("Payment Method"), "Payment Method", cancelled=False).agg(
        best("Payment Method", "bookings").alias("most_used_payment_method"),
        F.max("bookings").alias("most_used_payment_bookings"),
    )


def _cancellation_columns() -> list[Column]:
    status = F.col("Booking Status")
    return [
        F.count_if(status.isin(S.CANCELLED_BY_DRIVER, S.CANCELLED_BY_CUSTOMER)).alias(
            "total_cancelled"
        ),
        F.count_if(status == S.CANCELLED_BY_DRIVER).alias("driver_cancellation_count"),
        F.count_if(status == S.CANCELLED_BY_CUSTOMER).alias("customer_cancellation_count"),
    ]


def _reason_map(counts: DataFrame, name: str) -> DataFrame:
    """A top-k report of reasons as one map, most frequent first."""
    entries = F.collect_list(F.struct((-F.col("Bookings")).alias("o"), "Reason", "Bookings"))
    pairs = F.transform(
        F.sort_array(entries), lambda e: F.struct(e["Reason"], e["Bookings"])
    )
    return counts.agg(F.map_from_entries(pairs).alias(name))


def incomplete_reasons(df: DataFrame, n: int = 10) -> DataFrame:
    counts = bookings_by(
        df.filter(F.col("Is_Incomplete") == 1),
        ["Incomplete Rides Reason"],
        {"Bookings": F.count("*")},
    ).withColumnRenamed("Incomplete Rides Reason", "Reason")
    return top_k(counts, "Bookings", n, ["Reason"])


def _driver_reasons(df: DataFrame) -> DataFrame:
    return reports.top_reasons(df, S.CANCELLED_BY_DRIVER, "Driver Cancellation Reason")


def _customer_reasons(df: DataFrame) -> DataFrame:
    return reports.top_reasons(
        df, S.CANCELLED_BY_CUSTOMER, "Reason for cancelling by Customer"
    )


def cancellation_insights(df: DataFrame) -> DataFrame:
    """Counts and the top-10 reason maps of both cancellers in one row."""
    return side_by_side(
        df.agg(*_cancellation_columns()),
        _reason_map(_driver_reasons(df), "top_driver_cancellation_reasons"),
        _reason_map(_customer_reasons(df), "top_customer_cancellation_reasons"),
    )


def incomplete_insights(df: DataFrame) -> DataFrame:
    return side_by_side(
        df.agg(flagged("Is_Incomplete").alias("total_incomplete")),
        _reason_map(incomplete_reasons(df), "top_incomplete_reasons"),
    )


def _rating_columns() -> list[Column]:
    """Lowest and highest ratings of completed rides."""
    done = F.col("Is_Completed") == 1
    driver, customer = (F.when(done, F.col(c)) for c in S.RATING_COLUMNS)
    return [
        round_half_up(F.min(driver), 2).alias("driver_rating_min"),
        round_half_up(F.max(driver), 2).alias("driver_rating_max"),
        round_half_up(F.min(customer), 2).alias("customer_rating_min"),
        round_half_up(F.max(customer), 2).alias("customer_rating_max"),
    ]


RATING_FIELDS = [
    "average_driver_rating",
    "average_customer_rating",
    "driver_rating_min",
    "driver_rating_max",
    "customer_rating_min",
    "customer_rating_max",
]


def rating_insights(df: DataFrame) -> DataFrame:
    return df.agg(*reports.kpi_columns(), *_rating_columns()).select(*RATING_FIELDS)


def revenue_insights(df: DataFrame) -> DataFrame:
    """Completed value, means, and the vehicle type with the most completed value."""
    rides = reports.completed_rides(df)
    by_vehicle = bookings_by(rides, ["Vehicle Type"], {"revenue": revenue("recorded")})
    return side_by_side(
        rides.agg(
            round_half_up(exact_sum(F.col("Booking Value")), 2).alias("completed_ride_revenue"),
            round_half_up(exact_mean(F.col("Booking Value")), 2).alias(
                "average_completed_booking_value"
            ),
            round_half_up(exact_mean(F.col("Ride Distance")), 2).alias(
                "average_completed_ride_distance"
            ),
        ),
        by_vehicle.agg(best("Vehicle Type", "revenue").alias("top_revenue_vehicle")),
    )


def ai_insights(metrics: DataFrame, importance: DataFrame, n: int = 10) -> DataFrame:
    """Model scores as a struct and the ``n`` most important features.

    The metrics report has one row per score; it is turned into one row so that
    no score is lost.
    """
    scores = dashboard.ml_metrics(metrics)
    top = dashboard.feature_importance(importance, n).select(
        F.col("Feature").alias("feature"), F.col("Importance").alias("importance")
    )
    return side_by_side(
        scores.select(F.struct(*scores.columns).alias("model_metrics")),
        top.agg(
            records(top, [-F.col("importance"), F.col("feature")]).alias(
                "top_predictive_features"
            )
        ),
    )


# Sentence texts of the insights report.
FINDING_TEMPLATES = [
    "The dataset contains %s bookings, with %s completed rides and a %.2f%% completion rate.",
    "%s bookings were cancelled, representing %.2f%% of all bookings.",
    "%s bookings had no driver found, representing %.2f%% of total bookings.",
    "Completed rides generated approximately %s in booking value.",
    "The highest booking volume occurs at hour %d:00.",
    "The highest-demand vehicle category is %s.",
    "The highest-volume pickup location is %s.",
    "The most frequently used payment method is %s.",
]
RECOMMENDATIONS = [
    "Use peak-hour demand patterns to plan driver availability and reduce unserved "
    "booking requests.",
    "Monitor locations with high booking volumes and elevated cancellation or "
    "no-driver-found rates for targeted supply allocation.",
    "Investigate the most frequent driver and customer cancellation reasons separately "
    "because their operational causes differ.",
    "Use vehicle-level completion and cancellation metrics to understand where different "
    "vehicle categories perform differently.",
    "Use payment-method patterns as an input to pre-booking outcome prediction and "
    "operational monitoring.",
    "Use the pre-booking AI model as a decision-support tool rather than treating "
    "predictions as guaranteed outcomes.",
    "Continuously evaluate model performance on newer booking data before using "
    "predictions for operational decisions.",
]


def _headlines(df: DataFrame) -> DataFrame:
    """KPIs and headline answers in one row."""
    return side_by_side(
        reports.insight_kpis(df),
        hourly_highlights(df).select("peak_hour"),
        vehicle_highlights(df).select("highest_demand_vehicle"),
        location_highlights(df).select("highest_demand_pickup"),
        payment_highlights(df).select("most_used_payment_method"),
    )


def _finding_columns() -> list[Column]:
    c = F.col
    values = [
        [thousands(c("total_bookings")), thousands(c("completed_bookings")), c("completion_rate")],
        [thousands(c("cancelled_bookings")), c("cancellation_rate")],
        [thousands(c("no_driver_found")), c("no_driver_found_rate")],
        [thousands(c("completed_ride_revenue"))],
        [c("peak_hour")],
        [c("highest_demand_vehicle")],
        [c("highest_demand_pickup")],
        [c("most_used_payment_method")],
    ]
    return [F.format_string(t, *v) for t, v in zip(FINDING_TEMPLATES, values)]


def key_findings(df: DataFrame) -> DataFrame:
    """(Position, Finding): eight sentences made from the KPIs."""
    sentences = F.array(*_finding_columns())
    return _headlines(df).select(F.posexplode(sentences).alias("Position", "Finding")).select(
        (F.col("Position") + 1).alias("Position"), "Finding"
    )


def recommendations(df: DataFrame) -> DataFrame:
    """(Position, Recommendation): fixed advice."""
    rows = [(i, s) for i, s in enumerate(RECOMMENDATIONS, 1)]
    return fixed_rows(df.sparkSession, rows, "Position int, Recommendation string")


def insights_document(
    df: DataFrame,
    metrics: DataFrame | None = None,
    importance: DataFrame | None = None,
    project: str = "Ride bookings",
    title: str = "Ride booking analytics",
    source_file: str = "bookings",
) -> DataFrame:
    """Everything as one nested row. ``df`` is read once per section, so pass a
    stored table."""

    c = F.col
    down = -c("bookings")
    vehicle, pickup, payment = (
        c(n) for n in ("Vehicle Type", "Pickup Location", "Payment Method")
    )
    # Every total of the document is one aggregate, every section one more, and a
    # section's headlines and rows come from the same grouped table.
    done_value = F.when(c("Is_Completed") == 1, c("Booking Value"))
    vehicles = section(
        df, vehicle, "Vehicle Type", extra={"done_value": round_half_up(exact_sum(done_value), 2)}
    )
    hours = hourly_insights(df)
    periods = time_period_insights(df)
    places = location_insights(df)
    routes = route_insights(df)
    payments = payment_insights(df)
    has_rides = c("completed") > 0
    frames = [
        df.agg(*reports.kpi_columns(), *_cancellation_columns(), *_rating_columns()),
        vehicles.agg(
            best("Vehicle Type", "bookings").alias("highest_demand_vehicle"),
            best("Vehicle Type", "revenue").alias("highest_revenue_vehicle"),
            best("Vehicle Type", "completion_rate").alias("highest_completion_vehicle"),
            F.min_by(
                "Vehicle Type", F.when(has_rides, F.struct(-c("done_value"), vehicle))
            ).alias("top_revenue_vehicle"),
            records(vehicles.drop("done_value"), [down, vehicle]).alias("vehicle_summary"),
        ),
        hours.agg(
            best("Hour", "bookings").alias("peak_hour"),
            F.max("bookings").alias("peak_hour_bookings"),
            best("Hour", "revenue").alias("highest_revenue_hour"),
            F.max("revenue").alias("highest_hourly_revenue"),
            records(hours, [c("Hour")]).alias("hourly_summary"),
        ),
        periods.agg(
            best("Time_Period", "bookings").alias("highest_demand_period"),
            records(periods, [c("Time_Period")]).alias("period_summary"),
        ),
        places.agg(
            best("Pickup Location", "bookings").alias("highest_demand_pickup"),
            F.max("bookings").alias("highest_demand_pickup_bookings"),
            records(places, [down, pickup]).alias("top_pickup_locations"),
        ),
        routes.agg(
            best("Route", "bookings").alias("highest_volume_route"),
            F.max("bookings").alias("highest_volume_route_bookings"),
            records(routes, [down, c("Route")]).alias("top_routes"),
        ),
        payments.agg(
            best("Payment Method", "bookings").alias("most_used_payment_method"),
            F.max("bookings").alias("most_used_payment_bookings"),
            records(payments, [payment]).alias("payment_summary"),
        ),
        _reason_map(_driver_reasons(df), "top_driver_cancellation_reasons"),
        _reason_map(_customer_reasons(df), "top_customer_cancellation_reasons"),
        _reason_map(incomplete_reasons(df), "top_incomplete_reasons"),
    ]
    with_model = metrics is not None and importance is not None
    if with_model:
        frames.append(ai_insights(metrics, importance))
    names = {
        "executive_kpis": [n for _, n in reports.EXECUTIVE_METRICS],
        "vehicle_insights": ["highest_demand_vehicle", "highest_revenue_vehicle",
                             "highest_completion_vehicle", "vehicle_summary"],
        "hourly_insights": ["peak_hour", "peak_hour_bookings", "highest_revenue_hour",
                            "highest_hourly_revenue", "hourly_summary"],
        "time_period_insights": ["highest_demand_period", "period_summary"],
        "location_insights": ["highest_demand_pickup", "highest_demand_pickup_bookings",
                              "top_pickup_locations"],
        "route_insights": ["highest_volume_route", "highest_volume_route_bookings", "top_routes"],
        "payment_insights": ["most_used_payment_method", "most_used_payment_bookings",
                             "payment_summary"],
        "cancellation_insights": ["total_cancelled", "driver_cancellation_count",
                                  "customer_cancellation_count",
                                  "top_driver_cancellation_reasons",
                                  "top_customer_cancellation_reasons"],
        "incomplete_insights": [c("incomplete_bookings").alias("total_incomplete"),
                                "top_incomplete_reasons"],
        "rating_insights": RATING_FIELDS,
        "revenue_insights": [
            "completed_ride_revenue",
            c("average_booking_value").alias("average_completed_booking_value"),
            c("average_ride_distance").alias("average_completed_ride_distance"),
            "top_revenue_vehicle",
        ],
    }
    if with_model:
        names["ai_insights"] = ["model_metrics", "top_predictive_features"]
    rows = F.struct(c("total_bookings").alias("rows"), F.lit(source_file).alias("source_file"))
    return side_by_side(*frames).select(
        F.lit(project).alias("project"),
        F.lit(title).alias("title"),
        rows.alias("dataset"),
        *[F.struct(*fields).alias(name) for name, fields in names.items()],
        F.array(*_finding_columns()).alias("key_findings"),
        F.array(*[F.lit(s) for s in RECOMMENDATIONS]).alias("recommendations"),
    )


MARKDOWN_KPIS = [
    ("Total Bookings", "total_bookings", "%s"),
    ("Completed Bookings", "completed_bookings", "%s"),
    ("Cancelled Bookings", "cancelled_bookings", "%s"),
    ("Incomplete Bookings", "incomplete_bookings", "%s"),
    ("No Driver Found", "no_driver_found", "%s"),
    ("Completion Rate", "completion_rate", "%.2f%%"),
    ("Cancellation Rate", "cancellation_rate", "%.2f%%"),
    ("Incomplete Rate", "incomplete_rate", "%.2f%%"),
    ("No Driver Found Rate", "no_driver_found_rate", "%.2f%%"),
    ("Completed Ride Revenue", "completed_ride_revenue", "%s"),
    ("Average Booking Value", "average_booking_value", "%.2f"),
    ("Average Ride Distance", "average_ride_distance", "%.2f"),
    ("Average Driver Rating", "average_driver_rating", "%.2f"),
    ("Average Customer Rating", "average_customer_rating", "%.2f"),
]


def insights_markdown(
    df: DataFrame,
    metrics: DataFrame | None = None,
    importance: DataFrame | None = None,
    project: str = "Ride bookings",
) -> DataFrame:
    """(Line, Text): the insights as a Markdown page."""
    lines: list[Column] = [F.lit(f"# {project} — Business Insights"), F.lit("")]
    lines += [F.lit("## Executive KPIs"), F.lit("")]
    for label, column, form in MARKDOWN_KPIS:
        value = thousands(F.col(column)) if form == "%s" else F.col(column)
        lines.append(F.format_string(f"- {label}: **{form}**", value))
    lines += [F.lit(""), F.lit("## Key Findings"), F.lit("")]
    lines += [F.concat(F.lit("- "), sentence) for sentence in _finding_columns()]
    lines += [F.lit(""), F.lit("## Operational Recommendations"), F.lit("")]
    lines += [F.lit(f"- {s}") for s in RECOMMENDATIONS]
    page = _headlines(df)
    text_lines = F.array(*lines)
    if metrics is not None and importance is not None:
        model = ai_insights(metrics, importance)
        page = side_by_side(page, model)
        scores = [
            F.concat(F.lit(f"- {n}: **"), F.col("model_metrics")[n].cast("string"), F.lit("**"))
            for n in dashboard.METRIC_NAMES
        ]
        features = F.transform(
            "top_predictive_features",
            lambda f: F.concat(
                F.lit("- "), f["feature"], F.lit(": "), f["importance"].cast("string")
            ),
        )
        text_lines = F.concat(
            text_lines,
            F.array(F.lit(""), F.lit("## AI Model"), F.lit(""), *scores),
            F.array(F.lit(""), F.lit("### Top Predictive Features"), F.lit("")),
            features,
        )
    return page.select(F.posexplode(text_lines).alias("Line", "Text"))


def insights_summary(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """The flat variant: counts, rates as fractions, revenue and four best-of answers."""
    total = F.count("*")

    def fraction(flag: str) -> Column:
        return round_half_up(F.try_divide(flagged(flag).cast("double"), total), 4)

    frames = [
        df.agg(
            total.alias("total_bookings"),
            flagged("Is_Completed").alias("completed_bookings"),
            fraction("Is_Cancelled").alias("cancellation_rate"),
            fraction("Is_Completed").alias("completion_rate"),
            fraction("Is_No_Driver_Found").alias("no_driver_rate"),
            revenue().alias("completed_revenue"),
        )
    ]
    for column, name in [
        ("Hour", "peak_booking_hour"),
        ("Vehicle Type", "top_vehicle"),
        ("Pickup Location", "top_pickup_location"),
        ("Payment Method", "top_payment_method"),
    ]:
        counts = bookings_by(df, [column], {"n": F.count("*")})
        frames.append(counts.agg(best(column, "n").alias(name)))
    if metrics is not None:
        scores = dashboard.ml_metrics(metrics)
        names = ["model_accuracy", "model_precision", "model_recall", "model_f1", "model_roc_auc"]
        frames.append(
            scores.select(
                *[
                    F.round(F.col(score), 4).alias(name)
                    for score, name in zip(dashboard.METRIC_NAMES, names)
                ]
            )
        )
    return side_by_side(*frames)
