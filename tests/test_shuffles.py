"""What is shuffled and stored on the way to a result, besides the result."""

from pyspark.sql import functions as F

from ridelens.operators import profiling
from ridelens.plans import catalog
from ridelens.sources import raw, sinks


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_report_of_repeated_ids_shuffles_its_rows_once(spark):
    rows = [("b", 1), ("a", 2), (None, 3), ("b", 4), (None, 5), ("c", 6), ("a", 7)]
    df = spark.createDataFrame(rows, "`Booking ID` string, n int")
    report = profiling.duplicate_id_report(df)
    assert [r["Booking ID"] for r in report.collect()] == [None, None, "a", "a", "b", "b"]
    assert sorted(r.n for r in report.collect()) == [1, 2, 3, 4, 5, 7]
    assert plan(report).count("- Exchange") == 1


def test_duplicate_rows_shuffle_hashes(spark):
    rows = [("x", 0.0, None), ("x", -0.0, None), ("x", None, None), (None, None, "x"), ("x", None, None)]
    rows += [(None, float("nan"), "y")] * 3 + [("z", 1.0, "z")]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    # One more of each: zeros of both signs, nulls in one place, and two more NaN.
    assert profiling.duplicate_rows(df).first()[0] == 4
    assert "hashpartitioning(_hash" in plan(profiling.duplicate_rows(df))
    assert profiling.duplicate_rows(df.limit(0)).first()[0] == 0


def test_overview_moves_no_wide_row(spark):
    rows = [("a", "2024-01-01", "10:00:00", None), ("a", "2024-01-01", "10:00:00", None), (None, "bad", None, "x"), ("b", "2024-01-02", "10:00:00", "y")]
    df = spark.createDataFrame(rows, "`Booking ID` string, Date string, Time string, other string")
    overview = profiling.audit_overview(df)
    assert overview.first().asDict() == {
        "Rows": 4, "Columns": 4, "Total Missing Cells": 4, "Invalid DateTime": 1,
        "Duplicate Rows": 1, "Duplicate Booking IDs": 1,
    }
    assert "hashpartitioning(_hash" in plan(overview)


def test_distinct_rows_are_not_stored_raw(spark, sf_dir):
    df = catalog.drop_exact_duplicates(spark, sf_dir)
    assert all("/bronze" not in f for f in df.inputFiles())
    text = plan(df)
    assert "hashpartitioning(_changed" not in text and ", _changed" not in "".join(
        line for line in text.split("\n") if "Exchange" in line
    )


def test_cleaned_table_is_written_without_a_shuffle(spark, tmp_path):
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    df = spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 3).alias("Year"), (F.col("id") % 5).alias("Month"))
    sinks.write_cleaned(df, str(tmp_path / "apart"), ["Year", "Month"], gather=False)
    sinks.write_cleaned(df, str(tmp_path / "gathered"), ["Year", "Month"])
    apart, gathered = (spark.read.parquet(str(tmp_path / n)) for n in ("apart", "gathered"))
    assert apart.exceptAll(gathered).count() == 0 and apart.count() == 1000
    assert len(apart.inputFiles()) == 4 * 15  # each task its own files
    assert spark.conf.get(setting) == before


def test_csv_round_trip_is_compressed(spark, sf_dir, tmp_path):
    assert all(f.endswith(".csv.gz") for f in catalog.read_clean_bookings_csv(spark, sf_dir).inputFiles())
    df = spark.createDataFrame([(' a "b"', 1.5), (None, None)], "t string, n double")
    sinks.export_csv(df, str(tmp_path / "one"), "gzip")
    back = raw.read_optional_report(spark, str(tmp_path / "one"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
