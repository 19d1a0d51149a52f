"""Cleaning and derivation on hand-made rows."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ridelens import schema as S
from ridelens.functions import calendar, numbers, text
from ridelens.operators import cleaning, filters, profiling
from ridelens.plans import layers
from ridelens.sources import raw, sinks


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(spark, values, expression, kind="string"):
    df = column(spark, values, kind).select(expression(F.col("x")).alias("y"))
    return [r.y for r in df.collect()]


def test_clean_text_strips_unquotes_and_collapses(spark):
    given = ["  a  b ", '"CNR1"', "\"'x'\"", "'\"x\"'", '" a "', "a\tb", "a  b",
             "　a\x1f", "", None, "a\n\nb", '""a""', "naïve  x"]
    want = ["a b", "CNR1", "x", '"x"', " a ", "a b", "a b", "a", "", None, "a b", "a", "naïve x"]
    assert apply(spark, given, text.clean_text) == want


def test_row_guard_gives_the_same_as_each_value(spark):
    rows = [(" a  b ", '"q"'), ("plain", "'s'"), (None, "x  y"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    together = cleaning.clean_text_columns(df).collect()
    alone = df.select(text.clean_text(F.col("a")).alias("a"), text.clean_text(F.col("b")).alias("b"))
    assert together == alone.collect()


def test_audit_strip_keeps_inner_space(spark):
    assert apply(spark, [' "a  b" ', "'x'"], text.strip_quotes) == ["a  b", "x"]


def test_missing_tokens_become_null(spark):
    got = apply(spark, ["NaN", "null", "", "N/A", "None", "0", "nil"], text.missing_to_null)
    assert got == [None] * 5 + ["0", "nil"]


def test_to_double_never_gives_nan_or_raises(spark):
    given = ["1.5", " 2 ", "abc", "NaN", "inf", "Infinity", "1e3", "1.5d", "2f", "-0.5", None, ""]
    want = [1.5, 2.0, None, None, None, None, 1000.0, None, None, -0.5, None, None]
    assert apply(spark, given, numbers.to_double) == want


def test_round_half_up_on_the_decimal_spelling(spark):
    got = apply(spark, [1.005, 0.125, -0.125, 2.675], lambda c: numbers.round_half_up(c, 2), "double")
    assert got == [1.01, 0.13, -0.13, 2.68]


def test_exact_sum_is_zero_for_no_values_and_mean_is_null(spark):
    df = column(spark, [None, None], "double").agg(
        numbers.exact_sum(F.col("x")).alias("s"), numbers.exact_mean(F.col("x")).alias("m")
    )
    assert df.first() == (0.0, None)


def test_exact_sum_of_tenths(spark):
    df = column(spark, [0.1] * 10, "double").agg(numbers.exact_sum(F.col("x")).alias("s"))
    assert df.first().s == 1.0


def test_exact_sum_beyond_the_range_of_a_long(spark):
    df = column(spark, [9e12] * 4, "double").agg(numbers.exact_sum(F.col("x")).alias("s"))
    assert df.first().s == 3.6e13


def test_datetime_parses_or_is_dropped(spark):
    df = spark.createDataFrame(
        [(" 2024-03-01", "09:05:00 "), ("bad", "10:00:00"), (None, "10:00:00")],
        "Date string, Time string",
    )
    kept = cleaning.add_datetime(df).collect()
    assert [r.DateTime for r in kept] == [datetime(2024, 3, 1, 9, 5)]
    assert cleaning.add_datetime(df, keep_invalid=True).count() == 3
    with pytest.raises(ValueError, match="Time"):
        cleaning.add_datetime(df.drop("Time"))


def test_datetime_with_stated_format(spark):
    df = spark.createDataFrame([("01/03/2024", "09:05")], "Date string, Time string")
    assert cleaning.add_datetime(df).count() == 0
    row = cleaning.add_datetime(df, ["dd/MM/yyyy HH:mm"]).first()
    assert row.DateTime == datetime(2024, 3, 1, 9, 5)


def test_calendar_monday_is_zero(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-03 23:59:59' AS DateTime")
    row = cleaning.add_calendar(df).first()
    assert (row.Year, row.Month, row.Month_Name, row.Day) == (2024, 3, "March", 3)
    assert (row.Day_of_Week, row.Day_Name, row.Hour, row.Is_Weekend) == (6, "Sunday", 23, 1)


def test_calendar_of_a_missing_moment_is_missing(spark):
    df = spark.createDataFrame([("bad", "10:00:00")], "Date string, Time string")
    row = cleaning.add_calendar(cleaning.add_datetime(df, keep_invalid=True)).first()
    assert row.Month_Name is None and row.Day_Name is None and row.Is_Weekend == 0


def test_time_periods_of_every_hour(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("Hour"))
    got = [r.Time_Period for r in cleaning.add_time_period(df).orderBy("Hour").collect()]
    want = ["Night"] * 6 + ["Morning"] * 6 + ["Afternoon"] * 5 + ["Evening"] * 4
    assert got == want + ["Late Evening"] * 3
    other = cleaning.add_time_period(df, "alternative").orderBy("Hour").collect()
    want = ["Night"] * 5 + ["Morning"] * 7 + ["Afternoon"] * 5 + ["Evening"] * 5 + ["Night"] * 2
    assert [r.Time_Period for r in other] == want
    missing = spark.sql("SELECT CAST(NULL AS INT) AS Hour")
    assert cleaning.add_time_period(missing, "alternative").first().Time_Period == "Unknown"


def outcome_rows(spark):
    rows = [
        ("Completed", 100.0, 4.0),
        (" CANCELLED by admin", 50.0, 5.0),
        (None, None, None),
        ("Completed", None, 2.0),
        ("Completed", 10.0, 0.0),
        ("Incomplete", 30.0, 3.0),
        ("Strange", 1.0, 1.0),
    ]
    return spark.createDataFrame(
        rows, "`Booking Status` string, `Booking Value` double, `Ride Distance` double"
    )


def test_outcomes_revenue_and_fare(spark):
    rows = cleaning.add_business_features(outcome_rows(spark)).collect()
    assert [r.Is_Completed for r in rows] == [1, 0, 0, 1, 1, 0, 0]
    assert [r.Is_Cancelled for r in rows] == [0, 1, 0, 0, 0, 0, 0]
    assert [r.Booking_Outcome for r in rows] == [
        "Completed", "Other", "Other", "Completed", "Completed", "Incomplete", "Other"]
    assert [r.Revenue for r in rows] == [100.0, 0.0, 0.0, None, 10.0, 0.0, 0.0]
    assert [r.Fare_Per_KM for r in rows] == [25.0, None, None, None, None, None, None]
    assert [r.Has_Booking_Value for r in rows] == [1, 1, 0, 0, 1, 1, 1]


def test_alternative_rules_of_flags_revenue_and_fare(spark):
    df = outcome_rows(spark)
    listed = cleaning.add_outcome_flags(df, "listed")
    assert listed.agg(F.sum("Is_Cancelled")).first()[0] == 0
    rows = listed.transform(cleaning.add_revenue, True).transform(cleaning.add_fare_per_km, False)
    got = rows.collect()
    assert got[3].Revenue == 0.0
    assert [r.Fare_Per_KM for r in got] == [25.0, 10.0, None, None, None, 10.0, 1.0]


def test_invalid_numbers_are_nulled(spark):
    df = spark.createDataFrame(
        [(-1.0, 5.5, 2.0), (0.0, 5.0, 1.0), (None, None, None)],
        "`Booking Value` double, `Driver Ratings` double, `Incomplete Rides` double",
    )
    got = [tuple(r) for r in cleaning.null_invalid_numeric(df).collect()]
    assert got == [(None, None, None), (0.0, 5.0, 1.0), (None, None, None)]


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None)], "x string, y int")
    assert cleaning.drop_exact_duplicates(df).count() == 2


def test_first_matching_column_follows_the_candidates(spark):
    df = spark.createDataFrame([(1, 2)], "` Score ` int, Importance int")
    assert cleaning.first_matching_column(df, ["importance", "score"]) == "Importance"
    assert cleaning.first_matching_column(df, ["score"]) == " Score "
    assert cleaning.first_matching_column(df, ["other"]) is None
    assert cleaning.normalise_headers(df).columns == ["score", "importance"]


def test_filters_with_and_without_a_selection(spark):
    df = spark.createDataFrame(
        [("A", "UPI", 0, 5), ("B", None, 1, 9), ("A", "Cash", 1, 20)],
        "`Vehicle Type` string, `Payment Method` string, Is_Weekend int, Hour int",
    ).withColumn("Booking Status", F.lit("Completed"))
    assert filters.filter_bookings(df).count() == 3
    assert filters.filter_bookings(df, payment_methods=["UPI", "Cash"]).count() == 2
    assert filters.filter_bookings(df, vehicles=[], hours=(6, None)).count() == 2
    assert filters.filter_bookings(df, day_type="Weekends", hours=(0, 9)).count() == 1
    with pytest.raises(ValueError):
        filters.filter_day_type(df, "Holidays")


def test_nonblank_reasons(spark):
    df = column(spark, [" late ", "", "NaN", None, "None"])
    assert [r.x for r in filters.filter_nonblank_reason(df, "x").collect()] == ["late", "None"]
    assert filters.filter_nonblank_reason(df, "x", ("None",)).count() == 1


def test_csv_round_trip_keeps_quotes_and_padding(spark, tmp_path):
    row = {c: None for c in S.RAW_COLUMNS} | {
        "Date": "2024-01-01", "Booking ID": '"CNR1"', "Booking Status": "  Completed ",
        "Driver Cancellation Reason": 'a, "b"', "Avg VTAT": "null"}
    df = spark.createDataFrame([tuple(row[c] for c in S.RAW_COLUMNS)], S.RAW_SCHEMA)
    sinks.export_csv(df, str(tmp_path / "raw"))
    got = raw.read_raw_bookings(spark, str(tmp_path / "raw")).first()
    assert got["Booking ID"] == '"CNR1"' and got["Booking Status"] == "  Completed "
    assert got["Driver Cancellation Reason"] == 'a, "b"' and got["Avg VTAT"] is None


def test_raw_file_with_tripled_quotes(spark, tmp_path):
    path = tmp_path / "b.csv"
    cells = ["2024-01-01", "10:00:00", '"""CNR7"""'] + [""] * 18
    path.write_text(",".join(S.RAW_COLUMNS) + "\n" + ",".join(cells) + "\n")
    got = raw.read_raw_bookings(spark, str(path)).first()
    assert got["Booking ID"] == '"CNR7"' and got["Payment Method"] is None


def test_raw_file_with_other_columns_is_refused(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        raw.read_raw_bookings(spark, str(path)).collect()


def test_absent_report_is_empty(spark, tmp_path):
    got = raw.read_optional_report(spark, str(tmp_path / "none"), S.RAW_SCHEMA)
    assert got.columns == S.RAW_COLUMNS and got.count() == 0


def test_month_label(spark):
    df = spark.range(1).select(calendar.month_label(F.lit(2024), F.lit(3)).alias("m"))
    assert df.first().m == "2024-03"


def test_stored_tables_come_from_compiled_code(spark, sf_dir):
    """The JVM compiles no method above 8,000 bytes of code: each row would be interpreted."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for df in (
        layers.raw_rows(spark, sf_dir),
        layers.cleaned_rows(spark, sf_dir),
        layers.cleaned_rows_alternative(spark, sf_dir),
        profiling.audit_table(layers.raw_rows(spark, sf_dir)),
    ):
        code = debug.codegenString(df._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert max(sizes, default=0) < 8000


def test_equal_rows_are_removed_without_a_shuffle_of_wide_rows(spark, sf_dir):
    plan = layers.cleaned_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "HashAggregate" in above and "Generate explode" in above


def test_rows_per_cleaning_task_do_not_grow_with_the_input(spark, sf_dir, monkeypatch):
    layers.input_state(spark, sf_dir)
    size = layers._BYTES[spark.sparkContext.applicationId, sf_dir]
    for n in (20, 40):
        monkeypatch.setattr(layers, "TASK_BYTES", size // n)
        for rows in (layers.cleaned_rows, layers.cleaned_rows_alternative):
            plan = rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert re.search(rf"hashpartitioning\(l_orderkey.*, {n}\), REPARTITION_BY_NUM", plan)
    monkeypatch.setattr(layers, "TASK_BYTES", size * 100)
    assert layers.cleaning_tasks(spark, sf_dir) == 1


def odd_rows(spark):
    values = ["x", " x ", '"x"', "NaN", '"NaN"', " null", "", " ", "a  b", "a b", "a\tb", "é ",
              "'q'", "7.5", '"7.5"', " -1 ", "1e999", "N/A", "#N/A N/A", None]
    rows = [(i, *[values[(i + k * j) % len(values)] for j in range(len(S.RAW_COLUMNS))])
            for k in range(3) for i in range(len(values))]
    fields = ", ".join(f"`{c}` string" for c in S.RAW_COLUMNS)
    return spark.createDataFrame(rows, f"id long, {fields}")


def test_one_pass_gives_what_two_give(spark):
    rows = odd_rows(spark)
    known = raw.normalise_missing(rows)
    for clean in (
        lambda df, **one: cleaning.clean_bookings(df, keep_invalid=True, **one),
        cleaning.clean_bookings_alternative, profiling.audit_table,
    ):
        once, twice = clean(rows, normalise=True), clean(known)
        assert once.schema.simpleString() == twice.schema.simpleString()
        assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    apart = known.transform(cleaning.clean_text_columns).transform(cleaning.drop_exact_duplicates)
    packed = cleaning.clean_text_columns(rows, normalise=True, distinct=True)
    assert sorted(map(str, packed.collect())) == sorted(map(str, apart.collect()))


def test_rows_that_become_equal_by_different_ways_are_one(spark):
    df = spark.createDataFrame([("a  b", '"q"'), ("a b", "q"), (" a b", "q "), ("NaN", "q"), (None, "q")],
                               "a string, b string")
    got = cleaning.clean_text_columns(df, normalise=True, distinct=True).collect()
    assert sorted(map(tuple, got), key=str) == [("a b", "q"), (None, "q")]


def test_texts_are_cleaned_in_one_pass_by_compiled_code(spark, sf_dir):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", False)  # else the report on code is empty
    try:
        for df in (
            layers.cleaned_rows(spark, sf_dir, True),
            layers.cleaned_rows_alternative(spark, sf_dir),
            profiling.audit_table(layers.bookings_text(spark, sf_dir), normalise=True),
        ):
            executed = df._jdf.queryExecution().executedPlan()
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(executed))
            assert sizes and max(map(int, sizes)) < 8000
            # one lambda function, for the rows that need the long way
            assert executed.toString().count("transform(") == 1
        plan = layers.cleaned_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"HashAggregate\(keys=\[[^\]]*_changed", plan)) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
