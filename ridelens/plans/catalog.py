"""The registered queries: one entry per operator, over the whole tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens import schema as S
from ridelens.functions import calendar, text
from ridelens.functions.numbers import round_half_up
from ridelens.functions.tables import flattened
from ridelens.operators import (
    cleaning,
    dashboard,
    filters,
    forests,
    insights,
    learning_data,
    models,
    profiling,
    reports,
    scoring,
    statistics,
    variants,
)
from ridelens.plans.layers import (
    audit,
    bronze,
    cleaned_rows,
    cleaned_rows_alternative,
    cleaning_tasks,
    input_state,
    materialise,
    raw_rows,
    shared_folder,
    silver,
    silver_alternative,
    silver_rows,
)
from ridelens.sources import raw, sinks
from ridelens.sources.derived import ROW_KEY, bookings_text

Query = Callable[[SparkSession, str], DataFrame]

KEY_FIELDS = [
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_extendedprice", T.DoubleType()),
]
COLS = S.RAW_COLUMNS
# the default selections of the filter tests below
FILTER = {
    "vehicles": ["ECONOMY", "LARGE", "PROMO"],
    "statuses": [S.COMPLETED, S.CANCELLED_BY_DRIVER, S.INCOMPLETE],
    "payment_methods": ["UPI", "Cash", "Wallet"],
    "day_type": "Weekdays",
    "hours": (6, 20),
}


def _audit_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir).select(*COLS)


def on_silver(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(silver(spark, sf_dir))


def on_audit(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(audit(spark, sf_dir))


def on_bronze(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(bronze(spark, sf_dir))


def on_alternative(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(silver_alternative(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in columns})


# --- sources and sinks ------------------------------------------------------


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of its own for each call, so a result that is still read is never replaced."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/ridelens/{app}/out-{uuid.uuid4().hex}/{name}"


def read_raw_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "raw_csv")
    export = bookings_text(spark, sf_dir).select(*COLS, *ROW_KEY)
    sinks.export_csv(export, path)
    return raw.read_raw_bookings(spark, path, KEY_FIELDS)


def write_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "cleaned")
    sinks.write_cleaned(silver(spark, sf_dir), path, ["Year", "Month"], gather=False)
    return raw.read_clean_bookings(spark, path, KEY_FIELDS)


def read_clean_bookings_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "cleaned_csv")
    rows = silver(spark, sf_dir).select(*S.CLEAN_COLUMNS, *ROW_KEY)
    sinks.export_csv(rows, path, "gzip")
    return raw.read_clean_bookings_csv(spark, path, KEY_FIELDS)


def write_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "vehicle_performance")
    report = reports.vehicle_performance(silver(spark, sf_dir))
    sinks.write_report_csv(report, path)
    return raw.read_optional_report(spark, path, report.schema)


def write_indexed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "correlation")
    report = statistics.correlation_matrix(silver(spark, sf_dir))
    sinks.write_indexed_csv(report, path, "Column")
    return raw.read_optional_report(spark, path, report.schema)


def read_optional_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that exists and one that does not, read the same way."""
    path = _scratch(spark, sf_dir, "optional")
    report = reports.booking_status_analysis(silver(spark, sf_dir))
    sinks.write_report_csv(report, path)
    found = raw.read_optional_report(spark, path, report.schema)
    absent = raw.read_optional_report(spark, path + "-absent", report.schema)
    return found.unionByName(absent)


def export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "filtered")
    rows = filters.filter_bookings(silver(spark, sf_dir), **FILTER)
    sinks.export_csv(rows.select(*S.CLEAN_COLUMNS, *ROW_KEY), path)
    return raw.read_clean_bookings_csv(spark, path, KEY_FIELDS)


def _reports_on_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two model reports read from files, as the document and the page take them: the
    scores of the arithmetic scorer, and each column's correlation with completion.

    SQL can state both. The reports of a trained forest (``_metrics``, ``_importance``)
    have the same columns and are passed in the same way.
    """

    def stored(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        report = materialise(spark, f"{name}_report", sf_dir, build)
        path = _scratch(spark, sf_dir, name)
        sinks.write_report_csv(report, path)
        return raw.read_optional_report(spark, path, report.schema)

    def scores() -> DataFrame:
        return _rounded(scoring.metrics_binary(_scored(silver(spark, sf_dir))), "Score")

    def importance() -> DataFrame:
        matrix = statistics.correlation_matrix(silver(spark, sf_dir))
        return matrix.select(F.col("Column").alias("Feature"), F.col("Is_Completed").alias("Importance"))

    return stored("scores", scores), stored("importance", importance)


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.insights_document(silver(spark, sf_dir), *_reports_on_file(spark, sf_dir))


def insights_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every section."""
    return flattened(_document(spark, sf_dir))


def write_insights_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the document after it was written and read again."""
    path = _scratch(spark, sf_dir, "insights_json")
    document = _document(spark, sf_dir)
    sinks.write_insights_json(document, path)
    return flattened(raw.read_optional_report(spark, path, document.schema, "json"))


def write_insights_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, sf_dir, "insights_md")
    page = insights.insights_markdown(silver(spark, sf_dir), *_reports_on_file(spark, sf_dir))
    sinks.write_insights_markdown(page, path)
    return spark.read.text(path)


# --- row-wise derivations ---------------------------------------------------


def _key_and(*columns: str) -> list[str]:
    return [*ROW_KEY, *columns]


def _clean_text(df: DataFrame) -> DataFrame:
    return cleaning.clean_text_columns(df, S.TEXT_COLUMNS).select(*_key_and(*S.TEXT_COLUMNS))


def _audit_strip(df: DataFrame) -> DataFrame:
    return cleaning.audit_strip_columns(df, S.TEXT_COLUMNS).select(*_key_and(*S.TEXT_COLUMNS))


def _typed(df: DataFrame) -> DataFrame:
    return df.transform(cleaning.clean_text_columns).transform(cleaning.coerce_numeric)


def _coerce_numeric(df: DataFrame) -> DataFrame:
    return _typed(df).select(*_key_and(*S.NUMERIC_COLUMNS))


def _null_invalid(df: DataFrame) -> DataFrame:
    return cleaning.null_invalid_numeric(_typed(df)).select(*_key_and(*S.NUMERIC_COLUMNS))


def _parse_datetime(df: DataFrame) -> DataFrame:
    stamped = cleaning.add_datetime(df.transform(cleaning.clean_text_columns, ["Date", "Time"]))
    return stamped.select(*_key_and("Date", "Time", "DateTime"))


def _first_matching(df: DataFrame) -> DataFrame:
    """The first column that goes by one of several names, under a name of its own."""
    found = cleaning.first_matching_column(df, ["fare", "booking value", "revenue"])
    return df.select(*ROW_KEY, F.col(found).alias("Found"))


def _route_label(df: DataFrame) -> DataFrame:
    return df.select(*ROW_KEY, text.route_label().alias("Route"))


def _month_label(df: DataFrame) -> DataFrame:
    return df.select(
        *ROW_KEY, calendar.month_label(F.col("Year"), F.col("Month")).alias("Month_Label")
    )


def _recomputed(derive: Callable[[DataFrame], DataFrame], *columns: str):
    """The derivation alone, over stored rows without the derived columns."""

    def run(df: DataFrame) -> DataFrame:
        return derive(df.drop(*columns)).select(*_key_and(*columns))

    return run


CALENDAR = ["Year", "Month", "Month_Name", "Day", "Day_of_Week", "Day_Name", "Hour", "Is_Weekend"]
FLAGS = ["Is_Completed", "Is_Cancelled", "Is_Incomplete", "Is_No_Driver_Found"]


def _validation(df: DataFrame) -> DataFrame:
    distinct = df.transform(cleaning.clean_text_columns).transform(cleaning.drop_exact_duplicates)
    return profiling.numeric_validation(cleaning.coerce_numeric(distinct))


def drop_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over raw rows that were brought together by key while they were narrow, so that no
    wide row is stored or shuffled."""
    rows = raw_rows(spark, sf_dir, cleaning_tasks(spark, sf_dir))
    return cleaning.drop_exact_duplicates(cleaning.clean_text_columns(rows))


def _cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.cleaning_summary(
        bronze(spark, sf_dir),
        silver(spark, sf_dir),
        len(COLS),
        S.CLEAN_COLUMNS,
        silver_rows(spark, sf_dir),
    )


# --- learning ---------------------------------------------------------------


def _arithmetic_hash():
    """Row order any engine can compute; the order key is reduced before it is
    multiplied, so that no product leaves the range of a long."""
    prime = 2147483647
    mixed = (
        F.col("l_orderkey") % prime * 1103515245
        + F.col("l_partkey") * 12345
        + F.col("l_suppkey") * 40503
        + F.col("l_linenumber") * 2654435
    )
    return F.pmod(mixed, F.lit(prime))


def _split(df: DataFrame, wanted=learning_data.PREBOOKING_FEATURES) -> DataFrame:
    rows = learning_data.features(df, wanted, ROW_KEY)
    return learning_data.stratified_split(rows, ROW_KEY, _arithmetic_hash())


_WIDE = list(learning_data.WIDE_FEATURES)


def _stored_split(spark: SparkSession, sf_dir: str, name: str = "silver") -> DataFrame:
    """All features with target and ``Is_Test``, split once per session and laid out by it."""
    source = {"silver": silver, "silver_alternative": silver_alternative}[name]
    return materialise(
        spark, f"split_{name}", sf_dir, lambda: _split(source(spark, sf_dir), _WIDE), ["Is_Test"]
    )


def _train_test(
    spark: SparkSession, sf_dir: str, spec: models.ForestSpec, name: str = "silver"
) -> tuple[DataFrame, DataFrame]:
    rows = _stored_split(spark, sf_dir, name)
    columns = [*ROW_KEY, *spec.used_features(), learning_data.TARGET]
    return rows.filter("Is_Test = 0").select(*columns), rows.filter("Is_Test = 1").select(*columns)


def _scored(df: DataFrame) -> DataFrame:
    """Labels beside a score that arithmetic on the row key gives."""
    score = F.pmod(
        F.col("l_orderkey") + F.col("l_partkey") * 7 + F.col("l_suppkey") * 3, F.lit(1000)
    ) / F.lit(1000.0)
    return df.transform(learning_data.add_target).select(
        learning_data.TARGET,
        score.alias("Completion_Probability"),
        (score >= 0.5).cast("int").alias("Predicted_Completed"),
    )


def _imputation(operator, columns) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, _ = _train_test(spark, sf_dir, models.WIDE)
        return operator(train, columns)

    return run


_FORESTS: dict[tuple[str, str, str], forests.Forest] = {}


def _forest(spark: SparkSession, sf_dir: str, name: str) -> tuple[forests.Forest, DataFrame]:
    """A grown forest, stored in the shared folder per input and spec, and its test rows."""
    spec = getattr(models, name)
    source = "silver_alternative" if name == "NOTEBOOK" else "silver"
    train, test = _train_test(spark, sf_dir, spec, source)
    state = input_state(spark, sf_dir)
    key = (spark.sparkContext.applicationId, state, name)
    if key not in _FORESTS:
        digest = hashlib.sha256(f"{state} {spec!r}".encode()).hexdigest()[:16]
        folder = f"{shared_folder(spark)}/ridelens/forests/{name}-{digest}"
        _FORESTS[key] = forests.grow(train, spec, folder)
    return _FORESTS[key], test


def _metrics(name: str) -> Query:
    """The scores of a model on its test rows, computed once and read from then on."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        forest, test = _forest(spark, sf_dir, name)
        return scoring.metrics_binary(forests.predict(forest, test))

    return lambda spark, sf_dir: materialise(
        spark, f"metrics_{name}", sf_dir, lambda: build(spark, sf_dir)
    )


def _predictions(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        forest, test = _forest(spark, sf_dir, name)
        return models.prediction_report(
            forests.predict(forest, test), getattr(models, name), ROW_KEY
        )

    return run


def _importance(name: str) -> Query:
    return lambda spark, sf_dir: materialise(
        spark,
        f"importance_{name}",
        sf_dir,
        lambda: forests.feature_importance(_forest(spark, sf_dir, name)[0]),
    )


def column_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir, models.PREBOOKING)
    return models.encoded_columns(models.fit_features(train, models.PREBOOKING), test)


def save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows whose prediction is the same before and after the model was stored."""
    forest, test = _forest(spark, sf_dir, "PREBOOKING")
    before = forests.predict(forest, test)
    after = forests.predict(forests.load(spark, forest.folder), test)
    old = before.select(*ROW_KEY, F.struct("Predicted_Completed", "Completion_Probability").alias("a"))
    new = after.select(*ROW_KEY, F.struct("Predicted_Completed", "Completion_Probability").alias("b"))
    return old.join(new, ROW_KEY, "full").agg(
        F.count("*").alias("Rows"), F.count_if(F.col("a") == F.col("b")).alias("Same")
    )


def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, test = _forest(spark, sf_dir, "PREBOOKING")
    return forests.predict(forest, test).select(
        *ROW_KEY, learning_data.TARGET, "Predicted_Completed", "Completion_Probability"
    )


def ai_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = insights.ai_insights(
        _metrics("PREBOOKING")(spark, sf_dir), _importance("PREBOOKING")(spark, sf_dir)
    )
    return report.select(F.to_json(F.struct("*")).alias("ai_insights"))


def on_scored(operator) -> Query:
    return lambda spark, sf_dir: operator(_scored(silver(spark, sf_dir)))


def queries() -> dict[str, Query]:
    wide_numbers = learning_data.numeric(learning_data.WIDE_FEATURES)
    filtered = lambda op: on_silver(lambda df: op(filters.filter_bookings(df, **FILTER)))
    registered: dict[str, Query] = {
        # sources and sinks
        "read_raw_bookings": read_raw_bookings,
        "read_clean_bookings": write_cleaned,
        "read_clean_bookings_csv": read_clean_bookings_csv,
        "read_optional_report": read_optional_report,
        "write_report_csv": write_report_csv,
        "write_indexed_csv": write_indexed_csv,
        "write_insights_json": write_insights_json,
        "write_insights_markdown": write_insights_markdown,
        "export_filtered": export_filtered,
        # profiling
        "audit_overview": on_audit(lambda df: profiling.audit_overview(df, COLS)),
        "audit_overview_with_features": on_audit(
            lambda df: profiling.audit_overview(
                profiling.with_preview_features(df),
                [c for c in profiling.with_preview_features(df).columns if c not in ROW_KEY],
            )
        ),
        "table_preview": on_bronze(lambda df: profiling.table_preview(df, ROW_KEY, 10)),
        "schema_info": lambda s, d: profiling.schema_info(_audit_business(s, d)),
        "missing_values": lambda s, d: profiling.missing_values(_audit_business(s, d)),
        "missing_values_typed": on_silver(
            lambda df: profiling.missing_values_typed(df, S.CLEAN_COLUMNS)
        ),
        "data_dictionary": on_silver(lambda df: profiling.data_dictionary(df, S.CLEAN_COLUMNS)),
        "duplicate_rows": on_audit(profiling.duplicate_rows),
        "duplicate_ids_first": on_audit(profiling.duplicate_ids_first),
        "duplicate_ids_all": on_silver(profiling.duplicate_ids_all),
        "duplicate_summary": on_audit(profiling.duplicate_summary),
        "duplicate_id_report": on_silver(
            lambda df: profiling.duplicate_id_report(df, "Booking ID")
        ),
        "status_summary": on_audit(lambda df: profiling.value_share(df, "Booking Status")),
        "categorical_summary": lambda s, d: profiling.categorical_summary(_audit_business(s, d)),
        "top_categories": lambda s, d: profiling.top_categories(_audit_business(s, d)),
        "numeric_summary": lambda s, d: _rounded(
            profiling.numeric_summary(_audit_business(s, d)), "mean", "std", "25%", "50%", "75%"
        ),
        "describe_all": lambda s, d: _rounded(
            profiling.describe_all(_audit_business(s, d)), "mean", "std", "25%", "50%", "75%"
        ),
        "numeric_quality": lambda s, d: profiling.numeric_quality(_audit_business(s, d)),
        "datetime_audit": on_audit(profiling.datetime_audit),
        "rating_validation": on_audit(profiling.rating_validation),
        "rating_validation_alt": on_audit(lambda df: profiling.rating_validation(df, 1, 5)),
        "identifier_audit": on_audit(profiling.identifier_audit),
        "missingness_by_status": on_audit(profiling.missingness_by_status),
        "feature_preview": on_audit(lambda df: profiling.feature_preview(df, ROW_KEY)),
        "numeric_validation": on_bronze(_validation),
        "cleaning_summary": _cleaning_summary,
        "status_report_clean": on_silver(lambda df: profiling.value_share(df, "Booking Status")),
        "vehicle_report_clean": on_silver(lambda df: profiling.value_share(df, "Vehicle Type")),
        # cleaning and features
        "normalise_headers": on_silver(
            lambda df: cleaning.normalise_headers(
                df.select(*_key_and("Booking ID", "Vehicle Type", "Booking Value"))
            )
        ),
        "first_matching_column": on_silver(_first_matching),
        "recommendations": on_silver(insights.recommendations),
        "clean_text": on_bronze(_clean_text),
        "audit_strip": on_bronze(_audit_strip),
        "coerce_numeric": on_bronze(_coerce_numeric),
        "null_invalid_numeric": on_bronze(_null_invalid),
        "parse_datetime": on_bronze(_parse_datetime),
        "drop_exact_duplicates": drop_exact_duplicates,
        "calendar_features": on_silver(_recomputed(cleaning.add_calendar, *CALENDAR)),
        "time_period": on_silver(_recomputed(cleaning.add_time_period, "Time_Period")),
        "time_period_alt": on_alternative(
            _recomputed(lambda df: cleaning.add_time_period(df, "alternative"), "Time_Period")
        ),
        "outcome_flags": on_silver(_recomputed(cleaning.add_outcome_flags, *FLAGS)),
        "booking_outcome": on_silver(
            _recomputed(cleaning.add_booking_outcome, "Booking_Outcome")
        ),
        "revenue_col": on_silver(_recomputed(cleaning.add_revenue, "Revenue")),
        "fare_per_km": on_silver(_recomputed(cleaning.add_fare_per_km, "Fare_Per_KM")),
        "availability_flags": on_silver(
            _recomputed(cleaning.add_availability_flags, *S.AVAILABILITY_FLAGS.values())
        ),
        "route_label": on_silver(_route_label),
        "month_label": on_silver(_month_label),
        "clean_bookings": cleaned_rows,
        "clean_bookings_alt": cleaned_rows_alternative,
        # filters and spines
        "filter_equals": on_silver(
            lambda df: filters.filter_equals(df, "Payment Method", "UPI").select(
                *_key_and("Payment Method")
            )
        ),
        "filter_in_list": on_silver(
            lambda df: filters.filter_in_list(df, "Payment Method", ["UPI", "Cash"]).select(
                *_key_and("Payment Method")
            )
        ),
        "filter_hour_between": on_silver(
            lambda df: filters.filter_hour_between(df, 7, 9).select(*_key_and("Hour"))
        ),
        "filter_day_type": on_silver(
            lambda df: filters.filter_day_type(df, "Weekends").select(*_key_and("Day_Name"))
        ),
        "filter_bookings": filtered(lambda df: df.select(*_key_and("Vehicle Type", "Hour"))),
        "filter_nonblank_reason": on_silver(
            lambda df: filters.filter_nonblank_reason(df, "Driver Cancellation Reason").select(
                *_key_and("Driver Cancellation Reason")
            )
        ),
        "distinct_values_sorted": on_silver(
            lambda df: filters.distinct_values_sorted(df, "Vehicle Type")
        ),
        "reindex_spine": on_silver(
            lambda df: reports.on_weekday_spine(
                reports.demand_by(df, "Day_Name")
            )
        ),
        "zero_fill_buckets": on_silver(
            lambda df: statistics.distance_buckets(df)
        ),
        "resample_spine": on_silver(
            lambda df: statistics.daily_revenue(df)
        ),
        # reports
        "executive_kpis": on_silver(reports.executive_kpis),
        "insight_kpis": on_silver(reports.insight_kpis),
        "dashboard_kpis": filtered(dashboard.dashboard_kpis),
        "booking_status_analysis": on_silver(reports.booking_status_analysis),
        "vehicle_performance": on_silver(reports.vehicle_performance),
        "hourly_demand": on_silver(reports.hourly_demand),
        "day_of_week": on_silver(reports.day_of_week),
        "time_period_analysis": on_silver(reports.time_period_analysis),
        "revenue_summary": on_silver(reports.revenue_summary),
        "monthly_revenue": on_silver(reports.monthly_revenue),
        "month_trend": on_silver(reports.month_trend),
        "customer_cancel_reasons": on_silver(reports.customer_cancel_reasons),
        "driver_cancel_reasons": on_silver(reports.driver_cancel_reasons),
        "chart_customer_reasons": on_silver(
            lambda df: reports.top_reasons(
                df, S.CANCELLED_BY_CUSTOMER, "Reason for cancelling by Customer"
            )
        ),
        "chart_driver_reasons": on_silver(
            lambda df: reports.top_reasons(
                df, S.CANCELLED_BY_DRIVER, "Driver Cancellation Reason"
            )
        ),
        "pickup_analysis": on_silver(reports.pickup_analysis),
        "drop_analysis": on_silver(reports.drop_analysis),
        "route_analysis": on_silver(reports.route_analysis),
        "chart_top_pickups": on_silver(reports.chart_top_pickups),
        "chart_top_routes": on_silver(reports.chart_top_routes),
        "top_vehicles_by_revenue": on_silver(reports.top_vehicles_by_revenue),
        "top_pickups": on_silver(reports.top_pickups),
        "top_routes": on_silver(reports.top_routes),
        "payment_analysis": on_silver(reports.payment_analysis),
        "rating_summary": on_silver(reports.rating_summary),
        "driver_rating_distribution": on_silver(reports.driver_rating_distribution),
        "customer_rating_distribution": on_silver(reports.customer_rating_distribution),
        "wait_by_status": on_silver(reports.wait_by_status),
        "wait_by_vehicle": on_silver(reports.wait_by_vehicle),
        "distance_summary": on_silver(reports.distance_summary),
        # statistics, windows, top-k
        "distance_buckets": on_silver(statistics.distance_buckets),
        "cut_right_closed": on_silver(
            lambda df: df.select(
                *ROW_KEY,
                statistics.cut_right_closed(F.col("Ride Distance"), S.DISTANCE_BUCKETS).alias(
                    "Distance_Bucket"
                ),
            )
        ),
        "correlation_matrix": on_silver(statistics.correlation_matrix),
        "correlation_matrix_short": on_alternative(
            lambda df: statistics.correlation_matrix(df, S.CORRELATION_COLUMNS_SHORT)
        ),
        "histogram_equal_width": on_silver(
            lambda df: _rounded(
                statistics.histogram_equal_width(reports.completed_rides(df), "Ride Distance"),
                "Lower",
                "Upper",
            )
        ),
        "histogram_rating": on_silver(
            lambda df: statistics.histogram_nice(reports.completed_rides(df), "Driver Ratings")
        ),
        "daily_revenue": on_silver(statistics.daily_revenue),
        "share_of_total": on_silver(
            lambda df: profiling.value_share(df, "Pickup Location", "Bookings", "Share")
        ),
        "first_occurrence_flag": on_silver(
            lambda df: profiling.first_occurrence_flag(df, ROW_KEY).select(
                *_key_and("Booking ID", "Is_Duplicate")
            )
        ),
        "group_size_flag": on_silver(
            lambda df: profiling.group_size_flag(df).select(
                *_key_and("Booking ID", "Is_Repeated_ID")
            )
        ),
        "argmax": on_silver(
            lambda df: reports.demand_by(df, "Hour").agg(
                insights.best("Hour", "Bookings").alias("Peak_Hour"),
                insights.best("Hour", "Revenue").alias("Best_Revenue_Hour"),
            )
        ),
        "top_k": on_silver(
            lambda df: reports.top_k(
                df.filter(F.col("Booking Value").isNotNull()).select(*_key_and("Booking Value")),
                "Booking Value",
                20,
                ROW_KEY,
            )
        ),
        "row_cap": filtered(
            lambda df: statistics.row_cap(df, ROW_KEY, 5000).select(*_key_and("DateTime"))
        ),
        "fixed_size_sample": on_silver(
            lambda df: statistics.fixed_size_sample(
                reports.completed_rides(df),
                ["Ride Distance", "Booking Value"],
                F.struct(_arithmetic_hash(), *ROW_KEY),
            )
        ),
        # insights
        "vehicle_insights": on_silver(insights.vehicle_insights),
        "vehicle_highlights": on_silver(insights.vehicle_highlights),
        "hourly_insights": on_silver(insights.hourly_insights),
        "hourly_highlights": on_silver(insights.hourly_highlights),
        "time_period_insights": on_silver(insights.time_period_insights),
        "time_period_highlights": on_silver(insights.time_period_highlights),
        "location_insights": on_silver(insights.location_insights),
        "location_highlights": on_silver(insights.location_highlights),
        "route_insights": on_silver(insights.route_insights),
        "route_highlights": on_silver(insights.route_highlights),
        "payment_insights": on_silver(insights.payment_insights),
        "payment_highlights": on_silver(insights.payment_highlights),
        "cancellation_insights": on_silver(
            lambda df: insights.cancellation_insights(df).withColumns(
                {
                    c: F.to_json(c)
                    for c in (
                        "top_driver_cancellation_reasons",
                        "top_customer_cancellation_reasons",
                    )
                }
            )
        ),
        "incomplete_insights": on_silver(
            lambda df: insights.incomplete_insights(df).withColumn(
                "top_incomplete_reasons", F.to_json("top_incomplete_reasons")
            )
        ),
        "rating_insights": on_silver(insights.rating_insights),
        "revenue_insights": on_silver(insights.revenue_insights),
        "key_findings": on_silver(insights.key_findings),
        "insights_document": insights_document,
        "insights_summary": on_alternative(insights.insights_summary),
        # dashboard
        "dash_status_counts": filtered(dashboard.status_counts),
        "dash_hourly": filtered(dashboard.hourly),
        "dash_vehicle": filtered(dashboard.vehicle),
        "dash_time_period": filtered(dashboard.time_period),
        "dash_day_of_week": filtered(dashboard.day_of_week),
        "dash_daily_revenue": filtered(statistics.daily_revenue),
        "dash_payment": filtered(dashboard.payment),
        "dash_top_pickups": filtered(dashboard.top_pickups),
        "dash_top_drops": filtered(dashboard.top_drops),
        "dash_top_routes": filtered(dashboard.top_routes),
        "dash_driver_reasons": on_silver(dashboard.driver_reasons),
        "dash_customer_reasons": on_silver(dashboard.customer_reasons),
        "dash_rating_means": filtered(dashboard.rating_means),
        "dash_value_vs_distance": filtered(
            lambda df: statistics.fixed_size_sample(
                reports.completed_rides(df),
                ["Ride Distance", "Booking Value"],
                F.struct(_arithmetic_hash(), *ROW_KEY),
            )
        ),
        # alternative rules
        "nb_vehicle": on_alternative(variants.vehicle),
        "nb_status_counts": on_alternative(lambda df: variants.value_counts(df, "Booking Status")),
        "nb_period_counts": on_alternative(lambda df: variants.value_counts(df, "Time_Period")),
        "nb_payment_counts": on_alternative(lambda df: variants.value_counts(df, "Payment Method")),
        "nb_top_pickups": on_alternative(
            lambda df: variants.value_counts(df, "Pickup Location", 10)
        ),
        "nb_top_drops": on_alternative(lambda df: variants.value_counts(df, "Drop Location", 10)),
        "nb_driver_reasons": on_alternative(
            lambda df: dashboard.driver_reasons(df, also=("None",))
        ),
        "nb_customer_reasons": on_alternative(
            lambda df: dashboard.customer_reasons(df, also=("None",))
        ),
        "nb_hourly": on_alternative(lambda df: variants.value_counts(df, "Hour")),
        "nb_daily": on_alternative(lambda df: variants.value_counts(df, "Day_Name")),
        "sort_by_time": on_silver(
            lambda df: cleaning.sort_by_time(df, ROW_KEY).select(*_key_and("DateTime"))
        ),
        "nb_kpis": on_alternative(variants.kpis),
        "nb_monthly_revenue": on_alternative(variants.monthly_revenue),
        "nb_revenue_by_vehicle": on_alternative(variants.revenue_by_vehicle),
        "nb_describe": on_alternative(
            lambda df: _rounded(variants.describe(df), "mean", "std", "25%", "50%", "75%")
        ),
        # learning
        "ml_target": on_silver(
            lambda df: learning_data.add_target(df).select(*_key_and(learning_data.TARGET))
        ),
        "ml_features_prebooking": on_silver(
            lambda df: learning_data.features(df, learning_data.PREBOOKING_FEATURES, ROW_KEY)
        ),
        "ml_features_wide": on_silver(
            lambda df: learning_data.features(df, learning_data.WIDE_FEATURES, ROW_KEY)
        ),
        "target_distribution": on_silver(
            lambda df: learning_data.target_distribution(learning_data.add_target(df))
        ),
        "stratified_split": on_silver(
            lambda df: _split(df).select(*_key_and(learning_data.TARGET, "Is_Test"))
        ),
        "impute_median": lambda s, d: _rounded(
            _imputation(learning_data.impute_median, wide_numbers)(s, d), "Value"
        ),
        "impute_mode": _imputation(learning_data.impute_mode, learning_data.CATEGORICAL_FEATURES),
        "class_weights": on_silver(
            lambda df: learning_data.class_weights(learning_data.add_target(df))
        ),
        "metrics_binary": on_scored(
            lambda df: _rounded(scoring.metrics_binary(df), "Score")
        ),
        "roc_auc": on_scored(lambda df: _rounded(scoring.roc_auc(df), "roc_auc")),
        "confusion_matrix": on_scored(scoring.confusion_matrix),
        "classification_report": on_scored(
            lambda df: _rounded(scoring.classification_report(df), "Precision", "Recall", "F1")
        ),
        "column_transform": column_transform,
        "train_prebooking": _metrics("PREBOOKING"),
        "train_wide": _metrics("WIDE"),
        "train_notebook": _metrics("NOTEBOOK"),
        "predict": predict,
        "feature_importance": _importance("PREBOOKING"),
        "feature_importance_wide": _importance("WIDE"),
        "save_predictions": _predictions("PREBOOKING"),
        "save_predictions_wide": _predictions("WIDE"),
        "save_load_model": save_load_model,
        "ai_insights": ai_insights,
        "dash_feature_importance": lambda s, d: dashboard.feature_importance(
            _importance("PREBOOKING")(s, d)
        ),
        "dash_ml_metrics": lambda s, d: dashboard.ml_metrics(_metrics("PREBOOKING")(s, d)),
    }
    return registered
