"""Reports, profiles and statistics: rules, invariants, column names, plans."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens import schema as S
from ridelens.functions import numbers, ranking
from ridelens.functions.ranking import exact_quantiles
from ridelens.operators import (
    cleaning, dashboard, insights, learning_data, models, profiling, reports, scoring, statistics,
)
from ridelens.plans import catalog, layers
from ridelens.plans.layers import bronze, materialise, shared_folder, silver
from ridelens.sources import raw
from ridelens.sources.derived import ROW_KEY


@pytest.fixture(scope="module")
def clean(spark, sf_dir):
    return silver(spark, sf_dir)


def quantile(values, p):
    values = sorted(values)
    rank = p * (len(values) - 1)
    low = int(rank)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (rank - low)


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_against_sorting(spark, seed):
    rnd = random.Random(seed)
    values = [rnd.choice([-3.5, 0.0, rnd.uniform(-10, 1e6), 7.0]) for _ in range(rnd.randint(1, 400))]
    values += [7.0] * 200  # a third of all rows and more
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.probability: r["quantile"] for r in exact_quantiles(df, ["v"], [0, 0.25, 0.5, 0.9, 1]).collect()}
    for p, value in got.items():
        assert value == pytest.approx(quantile(values, p), abs=1e-9)


def test_quantiles_of_empty_and_single_columns(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5]).collect()
    assert [(r.column, r["quantile"]) for r in got] == [("b", 4.0)]


def test_groups_leave_out_missing_keys_and_keep_zero_sums(spark):
    df = spark.createDataFrame(
        [("A", "1", 0, None), (None, "2", 1, 5.0), ("B", None, 1, 2.5)],
        "`Vehicle Type` string, `Booking ID` string, Is_Completed int, Revenue double",
    )
    got = reports.bookings_by(
        df, ["Vehicle Type"], {"n": reports.bookings(), "r": reports.revenue()},
    ).orderBy("Vehicle Type").collect()
    assert [tuple(r) for r in got] == [("A", 1, 0.0), ("B", 0, 2.5)]


def test_rate_of_nothing_is_missing_and_kpi_rate_is_zero(spark, clean):
    empty = clean.filter("false")
    row = reports.insight_kpis(empty).first()
    assert row.total_bookings == 0 and row.completion_rate == 0.0
    assert row.average_booking_value is None
    board = dashboard.dashboard_kpis(empty).first()
    assert board.completion_rate == 0.0 and board.average_booking_value == 0.0


def test_revenue_bases_differ_by_incomplete_rides(clean):
    sums = clean.agg(
        reports.revenue().alias("completed"), reports.revenue("recorded").alias("recorded")
    ).first()
    extra = clean.filter("Is_Incomplete = 1").agg(F.round(F.sum("Booking Value"), 2)).first()[0]
    assert sums.recorded - sums.completed == pytest.approx(extra, abs=0.01)
    with pytest.raises(ValueError):
        reports.revenue("other")


def test_outcomes_partition_the_total(clean):
    row = reports.insight_kpis(clean).first()
    parts = (row.completed_bookings, row.cancelled_bookings, row.incomplete_bookings,
             row.no_driver_found)
    assert sum(parts) == row.total_bookings


def test_revenue_sums_agree_across_reports(clean):
    total = reports.insight_kpis(clean).first().completed_ride_revenue
    for report in (
        reports.booking_status_analysis(clean), reports.vehicle_performance(clean),
        reports.monthly_revenue(clean), reports.payment_analysis(clean),
        reports.day_of_week(clean), reports.hourly_demand(clean),
    ):
        assert report.agg(F.sum("Revenue")).first()[0] == pytest.approx(total, abs=0.01)


def test_distance_buckets_sum_to_rides_with_a_distance(clean):
    buckets = statistics.distance_buckets(clean)
    rides = clean.filter("Is_Completed = 1").agg(F.count("Ride Distance")).first()[0]
    assert buckets.agg(F.sum("Completed_Rides")).first()[0] == rides
    assert [r.Distance_Bucket for r in buckets.collect()] == [n for _, n in S.DISTANCE_BUCKETS]


def test_bucket_edges_belong_to_the_lower_bucket(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, 5.1, 50.0, 50.1, -1.0, None]], "d double")
    label = statistics.cut_right_closed(F.col("d"), S.DISTANCE_BUCKETS)
    got = [r.b for r in df.select(label.alias("b")).collect()]
    assert got == ["0-5 km", "0-5 km", "5-10 km", "40-50 km", "50+ km", None, None]


def test_correlation_is_symmetric_with_blanks(clean):
    rows = {r["Column"]: r for r in statistics.correlation_matrix(clean).collect()}
    for a in S.CORRELATION_COLUMNS:
        for b in S.CORRELATION_COLUMNS:
            assert rows[a][b] == rows[b][a]
    assert rows["Hour"]["Hour"] == 1.0
    assert rows["Driver Ratings"]["Is_Completed"] is None


def test_correlation_with_a_long_constant_is_missing(spark):
    n = 300_000
    df = spark.range(0, n, 1, 1).select(
        F.when(F.col("id") % 100 < 62, F.lit(1.0)).otherwise(0.0).alias("flag"),
        F.when(F.col("id") % 100 < 62, F.col("id") % 7).alias("held"),
    )
    rows = {r["Column"]: r for r in statistics.correlation_matrix(df, ["flag", "held"]).collect()}
    assert rows["held"]["flag"] is None and rows["flag"]["held"] is None
    assert rows["flag"]["flag"] == 1.0 and rows["held"]["held"] == 1.0


def test_correlation_of_two_rows_and_of_one(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0)], "a double, b double, c double")
    rows = {r["Column"]: r for r in statistics.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert rows["a"]["b"] == 1.0 and rows["a"]["c"] is None and rows["c"]["c"] is None


def test_histogram_of_a_single_value_and_last_bin_closed(spark):
    one = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert statistics.histogram_equal_width(one, "v", 4).agg(F.sum("Count")).first()[0] == 2
    many = spark.createDataFrame([(float(v),) for v in range(5)], "v double")
    got = [r.Count for r in statistics.histogram_equal_width(many, "v", 4).collect()]
    assert got == [1, 1, 1, 2]


def test_weekday_without_bookings_is_missing_not_zero(clean):
    only_monday = clean.filter("Day_Name = 'Monday'")
    rows = reports.day_of_week(only_monday).collect()
    assert [r.Day_Name for r in rows] == S.WEEKDAYS
    assert rows[0].Bookings > 0 and rows[1].Bookings is None


def test_daily_series_has_no_gaps(spark):
    df = spark.sql(
        "SELECT 1 AS Is_Completed, TIMESTAMP_NTZ '2024-02-27 10:00:00' AS DateTime, "
        "2.5D AS `Booking Value` UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-03-01 01:00:00', 1.0D"
    )
    got = [(str(r.Day), r["Booking Value"]) for r in statistics.daily_revenue(df).collect()]
    assert got == [("2024-02-27", 2.5), ("2024-02-28", 0.0), ("2024-02-29", 0.0), ("2024-03-01", 1.0)]


def test_month_trend_needs_two_months(clean):
    one = clean.filter("Year = 1996 AND Month = 5")
    assert reports.monthly_revenue(one).count() == 1 and reports.month_trend(one).count() == 0


def test_three_counts_of_repeated_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "`Booking ID` string")
    assert profiling.duplicate_ids_first(df).first()[0] == 3
    row = profiling.duplicate_ids_all(df).first()
    assert (row.duplicate_booking_ids_found, row.rows_with_duplicate_booking_ids) == (1, 5)
    assert profiling.duplicate_id_report(df).count() == 5
    assert profiling.group_size_flag(df).agg(F.sum("Is_Repeated_ID")).first()[0] == 5


def test_first_occurrence_follows_the_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 5)], "`Booking ID` string, k int")
    got = {r.k: r.Is_Duplicate for r in profiling.first_occurrence_flag(df, ["k"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_value_share_counts_missing(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    got = [tuple(r) for r in profiling.value_share(df, "x").collect()]
    assert got == [("a", 2, 66.67), (None, 1, 33.33)]


def test_sketched_distinct_counts_are_close(clean):
    exact = {r["Column"]: r["Unique Values"] for r in profiling.categorical_summary(clean, ["Booking ID"]).collect()}
    rough = {r["Column"]: r["Unique Values"] for r in profiling.categorical_summary_approx(clean, ["Booking ID"]).collect()}
    assert rough["Booking ID"] == pytest.approx(exact["Booking ID"], rel=0.1)


def test_overview_matches_the_missing_report(spark, sf_dir):
    audit = profiling.audit_table(bronze(spark, sf_dir))
    total = profiling.audit_overview(audit, S.RAW_COLUMNS).first()["Total Missing Cells"]
    per_column = profiling.missing_values(audit, S.RAW_COLUMNS)
    assert per_column.agg(F.sum("Missing Count")).first()[0] == total


def test_report_headers(clean):
    assert reports.vehicle_performance(clean).columns == [
        "Vehicle Type", "Total_Bookings", "Completed_Bookings", "Cancelled_Bookings", "Revenue",
        "Avg_Booking_Value", "Avg_Ride_Distance", "Avg_Driver_Rating", "Avg_Customer_Rating",
        "Completion_Rate", "Cancellation_Rate"]
    assert reports.hourly_demand(clean).columns == [
        "Hour", "Bookings", "Completed", "Cancelled", "Revenue", "Completion_Rate",
        "Cancellation_Rate"]
    assert reports.executive_kpis(clean).columns == ["Metric", "Value"]
    assert reports.executive_kpis(clean).count() == 14
    assert reports.top_routes(clean).columns == [
        "Pickup Location", "Drop Location", "Bookings", "Completed", "Revenue", "Route"]
    assert profiling.data_dictionary(clean, S.CLEAN_COLUMNS).count() == 45


def test_document_is_complete_json(clean):
    document = insights.insights_document(clean)
    row = json.loads(document.select(F.to_json(F.struct("*"))).first()[0])
    assert len(row["key_findings"]) == 8 and len(row["recommendations"]) == 7
    assert row["dataset"]["rows"] == clean.count()
    assert len(row["hourly_insights"]["hourly_summary"]) == 24
    demand = [v["bookings"] for v in row["vehicle_insights"]["vehicle_summary"]]
    assert demand == sorted(demand, reverse=True)


def test_document_agrees_with_the_single_reports(clean):
    row = insights.insights_document(clean).first().asDict(recursive=True)
    for name, report in {
        "vehicle_insights": insights.vehicle_highlights,
        "hourly_insights": insights.hourly_highlights,
        "time_period_insights": insights.time_period_highlights,
        "location_insights": insights.location_highlights,
        "route_insights": insights.route_highlights,
        "payment_insights": insights.payment_highlights,
        "cancellation_insights": insights.cancellation_insights,
        "incomplete_insights": insights.incomplete_insights,
        "rating_insights": insights.rating_insights,
        "revenue_insights": insights.revenue_insights,
        "executive_kpis": reports.insight_kpis,
    }.items():
        alone = report(clean).first().asDict(recursive=True)
        assert {k: row[name][k] for k in alone} == alone, name
    places = [r.asDict() for r in insights.location_insights(clean).collect()]
    assert row["location_insights"]["top_pickup_locations"] == places
    findings = [r.Finding for r in insights.key_findings(clean).orderBy("Position").collect()]
    assert row["key_findings"] == findings


def test_document_reads_the_table_once_per_section(clean):
    document = insights.insights_document(clean)
    document.collect()
    final = plan(document).split("Initial Plan")[0]
    assert final.count("Scan parquet") <= 10 * 2


def test_markdown_with_model_scores(spark, clean):
    scores = [(n, 0.5) for n in dashboard.METRIC_NAMES]
    metrics = spark.createDataFrame(scores, "Metric string, Score double")
    importance = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "Feature string, Importance double")
    page = insights.insights_markdown(clean, metrics, importance).orderBy("Line").collect()
    lines = [r.Text for r in page]
    assert "- Accuracy: **0.5**" in lines and lines[-2:] == ["- b: 0.75", "- a: 0.25"]
    row = insights.insights_document(clean, metrics, importance).first()
    assert row.ai_insights.model_metrics["ROC-AUC"] == 0.5
    assert [f.feature for f in row.ai_insights.top_predictive_features] == ["b", "a"]


def test_recommendations_are_numbered(clean):
    assert insights.recommendations(clean).count() == 7


def test_sample_is_repeatable_and_of_exact_size(clean):
    pick = lambda n: statistics.fixed_size_sample(
        clean, ["Ride Distance", "Booking Value"], statistics.hash_order(ROW_KEY), n)
    assert pick(100).count() == 100
    assert sorted(pick(100).collect()) == sorted(pick(100).collect())


# --- learning ---------------------------------------------------------------


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("Target_Completed"))
    got = learning_data.stratified_split(df, ["id"]).groupBy("Target_Completed").agg(
        F.count("*").alias("n"), F.sum("Is_Test").alias("t")).orderBy("Target_Completed").collect()
    assert [(r.n, r.t) for r in got] == [(668, 134), (335, 67)]


def test_split_when_many_rows_share_a_hash(spark):
    df = spark.range(500).select("id", F.lit(1).alias("Target_Completed"))
    split = learning_data.stratified_split(df, ["id"], F.lit(7).cast("long"))
    assert split.agg(F.sum("Is_Test")).first()[0] == 100


def test_imputation_values(spark):
    df = spark.createDataFrame([(2.0, "b"), (3.0, "a"), (None, "a"), (4.0, "b"), (None, None)], "n double, c string")
    assert learning_data.impute_median(df, ["n"]).first().Value == 3.0
    assert learning_data.impute_mode(df, ["c"]).first().Value == "a"


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.choice([0.0, 0.5, 1.0, rnd.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "Target_Completed int, Completion_Probability double")
    assert scoring.roc_auc(df).first()[0] == pytest.approx(brute_auc(rows), abs=1e-12)
    one_class = df.filter("Target_Completed = 1")
    assert scoring.roc_auc(one_class).first()[0] is None


def test_metrics_without_positives_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2)], "Target_Completed int, Predicted_Completed int, Completion_Probability double")
    got = {r.Metric: r.Score for r in scoring.metrics_binary(df).collect()}
    assert got == {"Accuracy": 0.5, "Precision": 0.0, "Recall": 0.0, "F1 Score": 0.0, "ROC-AUC": 1.0}


def test_forest_imputes_encodes_and_ignores_unknown_categories(spark, clean):
    spec = models.ForestSpec(tuple(learning_data.PREBOOKING_FEATURES), trees=5, depth=4)
    rows = learning_data.features(clean, spec.features, ROW_KEY)
    model = models.train_forest(rows, spec)
    names = models.feature_names(model)
    assert names[:3] == ["numeric__Hour", "numeric__Day_of_Week", "numeric__Is_Weekend"]
    assert "categorical__Payment Method_UPI" in names
    importance = models.feature_importance(model)
    assert importance.agg(F.sum("Importance")).first()[0] == pytest.approx(1.0, abs=1e-3)
    odd = rows.limit(1).withColumns({"Vehicle Type": F.lit("Boat"), "Hour": F.lit(None).cast("int")})
    scored = models.predict(model, odd).first()
    assert 0.0 <= scored.Completion_Probability <= 1.0
    again = models.train_forest(rows, spec)
    a = models.predict(model, rows).agg(F.sum("Predicted_Completed")).first()
    assert a == models.predict(again, rows).agg(F.sum("Predicted_Completed")).first()


def test_payment_policy_drops_the_leaking_feature():
    spec = models.ForestSpec(tuple(learning_data.PREBOOKING_FEATURES), 1, 1, payment_policy="drop")
    assert "Payment Method" not in spec.used_features()


# --- plans ------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_reports_prune_columns_and_push_filters(clean):
    text = plan(reports.driver_cancel_reasons(clean))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert pushed and all("Cancelled by Driver" in line for line in pushed)
    assert "Pickup Location" not in text


def test_no_python_in_any_plan(spark, sf_dir, clean):
    for df in (
        cleaning.clean_bookings(bronze(spark, sf_dir)), reports.revenue_summary(clean),
        statistics.correlation_matrix(clean), insights.key_findings(clean),
        profiling.describe_all(clean),
    ):
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text


def test_no_cross_join_and_no_unpartitioned_window(spark, sf_dir, clean):
    for df in (
        profiling.value_share(clean, "Vehicle Type"), insights.insights_document(clean),
        profiling.cleaning_summary(bronze(spark, sf_dir), clean, 21, S.CLEAN_COLUMNS),
        reports.payment_analysis(clean), scoring.roc_auc(clean.select(
            F.col("Is_Completed").alias("Target_Completed"),
            (F.col("Hour") / 24).alias("Completion_Probability"))),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_counting_for_quantiles_and_shares_runs_once(clean):
    for df in (
        exact_quantiles(clean, ["Booking Value"], [0.5]),
        profiling.value_share(clean, "Vehicle Type"),
        reports.customer_cancel_reasons(clean),
    ):
        df.collect()
        assert "ReusedExchange" in plan(df)


def test_top_k_keeps_k_rows_per_task(clean):
    assert "TakeOrderedAndProject" in plan(reports.top_pickups(clean))
    assert "WindowGroupLimit" in plan(profiling.top_categories(clean, ["Booking ID"]))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_materialised_table_is_built_once(spark, sf_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert materialise(spark, "once", sf_dir, build).count() == 3
    assert len(calls) == 1


@pytest.mark.parametrize("low, width", [(0.5, 0.0002), (1.7e9, 2e5), (-3.0, 6.0)])
def test_quantiles_of_a_dense_column(spark, low, width):
    n = 50_000
    values = spark.range(n).select((F.lit(low) + F.col("id") * (width / n)).alias("v"))
    got = {
        r.probability: r.quantile
        for r in ranking.exact_quantiles(values, ["v"], [0.0, 0.25, 0.5, 1.0]).collect()
    }
    ordered = sorted(r.v for r in values.collect())
    for p, q in got.items():
        at = p * (n - 1)
        below, above = ordered[int(at)], ordered[min(n - 1, int(at) + 1)]
        assert abs(q - (below + (above - below) * (at - int(at)))) <= 1e-9 * max(1, abs(q))


def piled_up(spark, n=30_000):
    """Values that halve every 35 rows, down to 1e-258: all in one bucket, near its start."""
    return spark.range(n).select(F.exp(-F.col("id") / 50).alias("v"))


def test_quantiles_of_values_that_pile_up(spark):
    values = piled_up(spark)
    ordered = sorted(r.v for r in values.collect())
    for r in ranking.exact_quantiles(values, ["v"], [0.0, 0.1, 0.5, 0.999, 1.0]).collect():
        assert r.quantile == pytest.approx(quantile(ordered, r.probability), rel=1e-9)


@pytest.mark.parametrize("n", [1, 40, 30_000])
def test_pieces_are_small_ordered_and_whole(spark, n):
    counts = ranking.value_counts_long(piled_up(spark, n), ["v"]).withColumn("bucket", F.lit(0))
    buckets = spark.createDataFrame([("v", 0, n)], "column string, bucket int, values long")
    placed = ranking.in_pieces(counts, buckets)
    pieces = placed.groupBy("piece").agg(
        F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high")
    ).orderBy("piece").collect()
    assert sum(p["values"] for p in pieces) == n
    assert max(p["values"] for p in pieces) <= max(40, 20 * n**0.5)
    assert all(a["high"] < b["low"] for a, b in zip(pieces, pieces[1:], strict=False))


def test_a_piece_is_found_among_many_cuts(spark):
    cuts = F.sequence(F.lit(1), F.lit(1000))
    values = spark.range(0, 1003).select("id", ranking._piece(F.col("id"), cuts).alias("piece"))
    assert all(r.piece == min(r.id, 1000) for r in values.collect())


def test_sums_of_any_size(spark):
    frame = spark.createDataFrame([(1e-7,), (2e-7,), (3e-7,)], "v double")
    assert abs(frame.agg(numbers.exact_mean(F.col("v"))).first()[0] - 2e-7) < 1e-20
    for values in ([1e13, 0.5], [1e30, 1.0], [-9e12, 9e12, 0.25]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        assert frame.agg(numbers.exact_sum(F.col("v"))).first()[0] == sum(values)


def test_fixed_histogram_counts_all_values(spark):
    frame = spark.createDataFrame([(2.5,), (3.1,), (4.0,), (None,)], "v double")
    assert statistics.histogram_fixed(frame, "v", 3.0, 5.0, 10).agg(F.sum("Count")).first()[0] == 3


def test_optional_json_report(spark, tmp_path):
    schema = T.StructType.fromDDL("a long, b struct<c:string>")
    cases = {"indented": '{\n    "a": 1,\n    "b": {\n        "c": "x"\n    }\n}', "empty": "", "broken": '{"a": 1,'}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        rows = raw.read_optional_report(spark, str(tmp_path / name), schema, "json").collect()
        assert [r.asDict(True) for r in rows] == ([{"a": 1, "b": {"c": "x"}}] if name == "indented" else [])
    assert raw.read_optional_report(spark, str(tmp_path / "absent"), schema, "json").collect() == []


def test_two_folders_with_one_last_name(spark, sf_dir):
    a, b = (catalog._scratch(spark, d, "x") for d in ("/a/sf0.1", "/b/sf0.1"))
    assert a != b
    assert layers.input_state(spark, sf_dir) == layers.input_state(spark, sf_dir + "/")
