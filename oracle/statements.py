"""What each registered query must return, as SQL over the given tables."""

from __future__ import annotations

from itertools import combinations

from oracle.base import (
    KEY, NUMBERS, RAW, TEXT, clean_sql, mean, money, on_alt, on_audit, on_clean, on_raw, pct, q,
    rnd, strip_sql,
)
from ridelens.operators.insights import RECOMMENDATIONS  # fixed sentences

CLEAN = RAW + [
    "DateTime", "Year", "Month", "Month_Name", "Day", "Day_of_Week", "Day_Name", "Hour",
    "Is_Weekend", "Time_Period", "Is_Completed", "Is_Cancelled", "Is_Incomplete",
    "Is_No_Driver_Found", "Booking_Outcome", "Revenue", "Fare_Per_KM", "Has_Booking_Value",
    "Has_Ride_Distance", "Has_Driver_Rating", "Has_Customer_Rating", "Has_Payment_Method",
    "Has_VTAT", "Has_CTAT",
]
_TYPE_INT = {
    "Year", "Month", "Day", "Day_of_Week", "Hour", "Is_Weekend", "Is_Completed", "Is_Cancelled",
    "Is_Incomplete", "Is_No_Driver_Found", "Has_Booking_Value", "Has_Ride_Distance",
    "Has_Driver_Rating", "Has_Customer_Rating", "Has_Payment_Method", "Has_VTAT", "Has_CTAT",
}
WIDE = ["Vehicle Type", "Pickup Location", "Drop Location", "Avg VTAT", "Avg CTAT",
        "Ride Distance", "Driver Ratings", "Customer Rating", "Payment Method", "Hour",
        "Day_of_Week", "Is_Weekend", "Time_Period"]
PRE = ["Vehicle Type", "Pickup Location", "Drop Location", "Hour", "Day_of_Week", "Is_Weekend",
       "Time_Period", "Payment Method"]
CATEGORICAL = ["Vehicle Type", "Pickup Location", "Drop Location", "Time_Period", "Payment Method"]


def _type(c: str) -> str:
    if c in NUMBERS or c in ("Revenue", "Fare_Per_KM"):
        return "double"
    if c == "DateTime":
        return "timestamp_ntz"
    return "int" if c in _TYPE_INT else "string"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cols(names: list[str]) -> str:
    return ", ".join(q(n) for n in names)


def per_column(table: str, names: list[str], select, label: str = "Column") -> str:
    """UNION ALL of one aggregate row per column."""
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS {q(label)}, {select(c)} FROM {table}" for c in names
    )


def missing(c: str) -> str:
    return f"count(*) FILTER (WHERE {q(c)} IS NULL)"


def one(x: str) -> str:
    """An integer count as BIGINT."""
    return f"cast(coalesce({x}, 0) AS bigint)"


def flag_sum(c: str) -> str:
    return one(f"sum({q(c)})")


BOOKINGS = 'count("Booking ID")'
R1 = rnd(money('"Revenue"'))
R3 = rnd(money('"Booking Value"'))
DONE = flag_sum("Is_Completed")
LOST = flag_sum("Is_Cancelled")


def mean2(c: str) -> str:
    return rnd(mean(q(c)))


def grouped(keys: list[str], measures: dict[str, str], rates: dict[str, tuple[str, str]] | None
            = None, source: str = "clean", digits: int | None = 2, tail: str = "",
            where: str = "true") -> str:
    present = " AND ".join(f"{q(k)} IS NOT NULL" for k in keys)
    inner = (f"SELECT {cols(keys)}, {', '.join(f'{e} AS {q(n)}' for n, e in measures.items())} "
             f"FROM {source} WHERE {present} AND ({where}) GROUP BY {cols(keys)}")
    extra = ""
    for name, (part, whole) in (rates or {}).items():
        value = pct(q(part), q(whole))
        extra += f", {rnd(value) if digits == 2 else value} AS {q(name)}"
    return f"SELECT *{extra} FROM ({inner}) {tail}"


LONG = {"Total_Bookings": BOOKINGS, "Completed_Bookings": DONE, "Cancelled_Bookings": LOST,
        "Revenue": R1}
LONG_RATES = {"Completion_Rate": ("Completed_Bookings", "Total_Bookings"),
              "Cancellation_Rate": ("Cancelled_Bookings", "Total_Bookings")}
SHORT = {"Bookings": BOOKINGS, "Completed": DONE, "Cancelled": LOST, "Revenue": R1}
SHORT_RATES = {"Completion_Rate": ("Completed", "Bookings"),
               "Cancellation_Rate": ("Cancelled", "Bookings")}
_DAYS = ("(VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),"
         "(5,'Saturday'),(6,'Sunday')) AS d(pos, day)")


def on_days(report: str, names: list[str]) -> str:
    return (f"SELECT day AS \"Day_Name\", {cols(names)} FROM {_DAYS} "
            f"LEFT JOIN ({report}) r ON r.\"Day_Name\" = d.day")


FILTER = ("\"Vehicle Type\" IN ('ECONOMY','LARGE','PROMO') AND \"Booking Status\" IN "
          "('Completed','Cancelled by Driver','Incomplete') AND \"Payment Method\" IN "
          "('UPI','Cash','Wallet') AND \"Is_Weekend\" = 0 AND \"Hour\" BETWEEN 6 AND 20")
FILTERED = f"(SELECT * FROM clean WHERE {FILTER})"
ROUTE = "(SELECT *, \"Pickup Location\" || ' → ' || \"Drop Location\" AS \"Route\" FROM {})"


def value_share(table: str, column: str, count: str = "Count", share: str = "Percentage") -> str:
    return (f"SELECT {q(column)}, n AS {q(count)}, {rnd('cast(n AS double) / sum(n) OVER () * 100')}"
            f" AS {q(share)} FROM (SELECT {q(column)}, count(*) AS n FROM {table} GROUP BY 1)")


def long_metrics(source: str, metrics: list[tuple[str, str]], label="Metric", value="Value") -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(n)} AS {q(label)}, {e} AS {q(value)} FROM {source}" for n, e in metrics
    )


def numeric_rows(table: str, names: list[str], order: bool = True) -> str:
    def select(c: str) -> str:
        quartiles = ", ".join(
            f"{rnd(f'quantile_cont({q(c)}, {p})', 6)} AS {q(n)}"
            for n, p in [("25%", .25), ("50%", .5), ("75%", .75)])
        return (f"count({q(c)}) AS \"count\", {rnd(mean(q(c)), 6)} AS \"mean\", "
                f"{rnd(f'stddev_samp({q(c)})', 6)} AS \"std\", min({q(c)}) AS \"min\", "
                f"{quartiles}, max({q(c)}) AS \"max\"")
    return per_column(table, names, select)


def value_counts_cte(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS \"Column\", {q(c)} AS \"Value\", count(*) AS \"Count\" FROM {table} "
        f"GROUP BY 2" for c in names)


def best(label: str, by: str) -> str:
    return f"(SELECT {q(label)} FROM s ORDER BY {q(by)} DESC, {q(label)} LIMIT 1)"


SECTION = {"bookings": BOOKINGS, "completed": DONE, "cancelled": LOST, "revenue": R3}
SECTION_RATES = {"completion_rate": ("completed", "bookings"),
                 "cancellation_rate": ("cancelled", "bookings")}
SLIM = {"bookings": BOOKINGS, "completed": DONE, "revenue": R3}
SLIM_RATES = {"completion_rate": ("completed", "bookings")}


def section(key: str, slim: bool = False, tail: str = "", source: str = "clean") -> str:
    if slim:
        return grouped([key], SLIM, SLIM_RATES, source, None, tail)
    return grouped([key], SECTION, SECTION_RATES, source, None, tail)


def reasons(status: str, column: str, source: str = "clean", limit: int = 10) -> str:
    return (f"SELECT {q(column)} AS \"Reason\", count(*) AS \"Bookings\" FROM {source} "
            f"WHERE \"Booking Status\" = {lit(status)} AND {q(column)} IS NOT NULL "
            f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}")


def reason_json(report: str) -> str:
    return (f"(SELECT '{{' || string_agg('\"' || \"Reason\" || '\":' || \"Bookings\", ',' "
            f"ORDER BY \"Bookings\" DESC, \"Reason\") || '}}' FROM ({report}))")


def cancel_report(status: str, column: str) -> str:
    return (f"SELECT {q(column)}, n AS \"Cancelled_Bookings\", "
            f"{rnd('cast(n AS double) / sum(n) OVER () * 100')} AS \"Percentage\" FROM ("
            f"SELECT {q(column)}, {BOOKINGS} AS n FROM clean WHERE \"Booking Status\" = "
            f"{lit(status)} AND {q(column)} IS NOT NULL GROUP BY 1)")


def counts(key: str, source: str, tail: str = "") -> str:
    return grouped([key], {"Bookings": "count(*)"}, None, source, 2, tail)


def kpi_row(source: str, revenue: str) -> list[tuple[str, str]]:
    def over(c):
        return rnd(mean(f'CASE WHEN "Is_Completed" = 1 THEN {q(c)} END'))

    def ratio(c):
        return rnd(f"coalesce({pct(flag_sum(c), 'count(*)')}, 0)")

    return [
        ("total_bookings", "count(*)"), ("completed_bookings", DONE), ("cancelled_bookings", LOST),
        ("incomplete_bookings", flag_sum("Is_Incomplete")),
        ("no_driver_found", flag_sum("Is_No_Driver_Found")),
        ("completion_rate", ratio("Is_Completed")), ("cancellation_rate", ratio("Is_Cancelled")),
        ("incomplete_rate", ratio("Is_Incomplete")),
        ("no_driver_found_rate", ratio("Is_No_Driver_Found")),
        ("completed_ride_revenue", revenue), ("average_booking_value", over("Booking Value")),
        ("average_ride_distance", over("Ride Distance")),
        ("average_driver_rating", over("Driver Ratings")),
        ("average_customer_rating", over("Customer Rating")),
    ]


R2 = rnd(money('CASE WHEN "Is_Completed" = 1 THEN "Booking Value" END'))


def wide(source: str, pairs: list[tuple[str, str]]) -> str:
    return f"SELECT {', '.join(f'{e} AS {q(n)}' for n, e in pairs)} FROM {source}"


def corr_rows(table: str, names: list[str]) -> str:
    pairs = {p: f"c{i}" for i, p in enumerate([(a, a) for a in names] + list(combinations(names, 2)))}
    row = ", ".join(
        f"corr(cast({q(a)} AS double), cast({q(b)} AS double)) AS {n}" for (a, b), n in pairs.items())

    def out(a, b):
        n = pairs.get((a, b)) or pairs[(b, a)]
        return f"{rnd(f'CASE WHEN isnan({n}) THEN NULL ELSE {n} END', 3)} AS {q(b)}"

    rows = " UNION ALL ".join(
        f"SELECT {lit(a)} AS \"Column\", {', '.join(out(a, b) for b in names)} FROM c" for a in names)
    return f", c AS (SELECT {row} FROM {table}) {rows}"


CORR = ["Avg VTAT", "Avg CTAT", "Booking Value", "Ride Distance", "Driver Ratings",
        "Customer Rating", "Revenue", "Fare_Per_KM", "Hour", "Is_Completed", "Is_Cancelled"]
CORR_SHORT = ["Avg VTAT", "Avg CTAT", "Booking Value", "Ride Distance", "Driver Ratings",
              "Customer Rating", "Hour", "Is_Completed"]


def bucket_case(x: str) -> str:
    return (f"CASE WHEN {x} < 0 THEN NULL WHEN {x} <= 5 THEN '0-5 km' WHEN {x} <= 10 THEN '5-10 km' "
            f"WHEN {x} <= 20 THEN '10-20 km' WHEN {x} <= 30 THEN '20-30 km' "
            f"WHEN {x} <= 40 THEN '30-40 km' WHEN {x} <= 50 THEN '40-50 km' "
            f"WHEN {x} > 50 THEN '50+ km' END")


def bucket_report(source: str) -> str:
    return ("SELECT b AS \"Distance_Bucket\", coalesce(n, 0) AS \"Completed_Rides\" FROM (VALUES "
            "('0-5 km'),('5-10 km'),('10-20 km'),('20-30 km'),('30-40 km'),('40-50 km'),('50+ km')) "
            f"AS l(b) LEFT JOIN (SELECT {bucket_case(q('Ride Distance'))} AS k, count(*) AS n "
            f"FROM {source} WHERE \"Is_Completed\" = 1 GROUP BY 1) ON k = b")


def daily(source: str) -> str:
    return (f", d AS (SELECT cast(\"DateTime\" AS date) AS day, {R3} AS v FROM {source} "
            "WHERE \"Is_Completed\" = 1 GROUP BY 1), spine AS (SELECT cast(unnest(generate_series("
            "(SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS date) AS day) "
            "SELECT spine.day AS \"Day\", coalesce(v, 0) AS \"Booking Value\" "
            "FROM spine LEFT JOIN d ON spine.day = d.day")


HASH = ("((l_orderkey % 2147483647 * 1103515245 + l_partkey * 12345 + l_suppkey * 40503 + "
        "l_linenumber * 2654435) % 2147483647)")
TARGET = "cast(coalesce(\"Booking Status\" = 'Completed', false) AS int) AS \"Target_Completed\""
SPLIT = (f", t AS (SELECT *, {TARGET} FROM clean), p AS (SELECT *, row_number() OVER (PARTITION BY "
         f"\"Target_Completed\" ORDER BY {HASH}, {KEY}) AS rn, count(*) OVER (PARTITION BY "
         "\"Target_Completed\") AS nc FROM t), split AS (SELECT *, cast(rn <= floor(nc * 0.2 + 0.5) "
         "AS int) AS \"Is_Test\" FROM p)")
SCORED = (f", s0 AS (SELECT {TARGET}, ((l_orderkey + l_partkey * 7 + l_suppkey * 3) % 1000) / 1000.0 "
          "AS x FROM clean), s AS (SELECT \"Target_Completed\" AS y, cast(x AS double) AS x, "
          "cast(x >= 0.5 AS int) AS p FROM s0), cm AS (SELECT "
          "count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, "
          "count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM s)")
AUC = ("(SELECT (sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) FROM (SELECT y, "
       "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, "
       "count(*) FILTER (y = 1) OVER () AS n1, count(*) FILTER (y = 0) OVER () AS n0 FROM s) "
       "GROUP BY n1, n0)")


def ratio(part: str, whole: str) -> str:
    return f"coalesce(cast({part} AS double) / nullif({whole}, 0), 0)"


def statements() -> dict[str, str]:
    o: dict[str, str] = {}
    # sources and sinks
    o["read_raw_bookings"] = on_raw("SELECT * FROM bookings_raw")
    for name in ("read_clean_bookings", "read_clean_bookings_csv"):
        o[name] = on_clean("SELECT * FROM clean")
    o["export_filtered"] = on_clean(f"SELECT * FROM clean WHERE {FILTER}")
    kpis = kpi_row("clean", R2)
    # profiling
    def total_missing(names):
        return " + ".join(missing(c) for c in names)

    def overview(names, table):
        return (f"SELECT count(*) AS \"Rows\", {len(names)} AS \"Columns\", {total_missing(names)} AS "
                f"\"Total Missing Cells\", count(*) FILTER (try_cast(\"Date\" || ' ' || \"Time\" AS "
                f"timestamp) IS NULL) AS \"Invalid DateTime\", count(*) - (SELECT count(*) FROM "
                f"(SELECT DISTINCT * FROM {table})) AS \"Duplicate Rows\", count(*) - (SELECT count(*) "
                f"FROM (SELECT DISTINCT \"Booking ID\" FROM {table})) AS \"Duplicate Booking IDs\" "
                f"FROM {table}")

    o["audit_overview"] = on_audit(overview(RAW, "audit"))
    preview = (
        ", prev0 AS (SELECT *, try_cast(\"Date\" || ' ' || \"Time\" AS timestamp) AS \"DateTime\" "
        "FROM audit), prev AS (SELECT *, year(\"DateTime\") AS \"Year\", month(\"DateTime\") AS "
        "\"Month\", monthname(\"DateTime\") AS \"Month Name\", day(\"DateTime\") AS \"Day\", "
        "dayname(\"DateTime\") AS \"Day Name\", cast(hour(\"DateTime\") AS int) AS \"Hour\", "
        "isodow(\"DateTime\") - 1 AS \"Day of Week\", cast(coalesce(isodow(\"DateTime\") >= 6, false) "
        "AS int) AS \"Is Weekend\", cast(\"Booking Status\" = 'Completed' AS int) AS \"Is Completed\", "
        "cast(\"Booking Status\" ILIKE '%cancelled%' AS int) AS \"Is Cancelled\", CASE WHEN "
        "\"Booking Status\" = 'Completed' THEN \"Booking Value\" ELSE 0 END AS \"Revenue\", CASE WHEN "
        "\"Ride Distance\" > 0 THEN \"Booking Value\" / \"Ride Distance\" END AS \"Fare Per KM\" "
        "FROM prev0) ")
    extra = ["DateTime", "Year", "Month", "Month Name", "Day", "Day Name", "Hour", "Day of Week",
             "Is Weekend", "Is Completed", "Is Cancelled", "Revenue", "Fare Per KM"]
    o["audit_overview_with_features"] = on_audit(preview + overview(RAW + extra, "prev"))
    o["feature_preview"] = on_audit(
        preview + "SELECT \"Booking ID\", \"Booking Status\", \"DateTime\", \"Hour\", \"Day Name\", "
        "\"Is Weekend\", \"Booking Value\", \"Ride Distance\", \"Revenue\", \"Fare Per KM\" "
        f"FROM prev ORDER BY {KEY} LIMIT 10")
    o["table_preview"] = on_raw(f"SELECT * FROM bookings_raw ORDER BY {KEY} LIMIT 10")
    o["schema_info"] = on_audit(per_column("audit", RAW, lambda c: (
        f"{RAW.index(c) + 1} AS \"Position\", {lit(_type(c))} AS \"Data_Type\", "
        f"count({q(c)}) AS \"Non_Null\"")))
    o["missing_values"] = on_audit(per_column("audit", RAW, lambda c: (
        f"{missing(c)} AS \"Missing Count\", {rnd(pct(missing(c), 'count(*)'))} AS \"Missing %\"")))
    typed = lambda c: (
        f"{missing(c)} AS \"Missing_Count\", {rnd(pct(missing(c), 'count(*)'))} AS "
        f"\"Missing_Percentage\", {lit(_type(c))} AS \"Data_Type\"")
    o["missing_values_typed"] = on_clean(per_column("clean", CLEAN, typed))
    o["data_dictionary"] = on_clean(per_column("clean", CLEAN, lambda c: (
        f"{typed(c)}, count(DISTINCT {q(c)}) AS \"Unique_Values\"")))
    o["duplicate_rows"] = on_audit(
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM audit)) AS "
        "\"Duplicate Rows\" FROM audit")
    o["duplicate_ids_first"] = on_audit(
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT \"Booking ID\" FROM audit)) AS "
        "\"Duplicate Values\" FROM audit")
    o["duplicate_ids_all"] = on_clean(
        "SELECT count(\"Booking ID\") AS duplicate_booking_ids_found, cast(coalesce(sum(n), 0) AS "
        "bigint) AS rows_with_duplicate_booking_ids FROM (SELECT \"Booking ID\", count(*) AS n FROM "
        "clean GROUP BY 1 HAVING count(*) > 1)")
    o["duplicate_summary"] = on_audit(
        "SELECT 'Duplicate complete rows' AS \"Metric\", count(*) - (SELECT count(*) FROM (SELECT "
        "DISTINCT * FROM audit)) AS \"Count\" FROM audit UNION ALL SELECT 'Duplicate Booking IDs', "
        "count(*) - (SELECT count(*) FROM (SELECT DISTINCT \"Booking ID\" FROM audit)) FROM audit")
    o["duplicate_id_report"] = on_clean(
        "SELECT * FROM clean QUALIFY count(*) OVER (PARTITION BY \"Booking ID\") > 1")
    o["status_summary"] = on_audit(value_share("audit", "Booking Status"))
    o["status_report_clean"] = on_clean(value_share("clean", "Booking Status"))
    o["vehicle_report_clean"] = on_clean(value_share("clean", "Vehicle Type"))
    o["categorical_summary"] = on_audit(per_column("audit", TEXT, lambda c: (
        f"count(DISTINCT {q(c)}) AS \"Unique Values\", {missing(c)} AS \"Missing\"")))
    o["top_categories"] = on_audit(
        f", v AS ({value_counts_cte('audit', TEXT)}) SELECT * FROM (SELECT *, cast(row_number() OVER "
        "(PARTITION BY \"Column\" ORDER BY \"Count\" DESC, \"Value\" ASC NULLS LAST) AS int) AS "
        "\"Rank\" FROM v) WHERE \"Rank\" <= 20")
    o["numeric_summary"] = on_audit(numeric_rows("audit", NUMBERS))
    describe_text = per_column("audit", TEXT, lambda c: (
        f"count({q(c)}) AS \"count\", count(DISTINCT {q(c)}) AS \"unique\""))
    o["describe_all"] = on_audit(
        f", v AS ({value_counts_cte('audit', TEXT)}), r AS (SELECT *, row_number() OVER (PARTITION BY "
        "\"Column\" ORDER BY \"Count\" DESC, \"Value\") AS k FROM v WHERE \"Value\" IS NOT NULL), "
        f"t AS ({describe_text}), n AS ({numeric_rows('audit', NUMBERS)}) "
        "SELECT t.\"Column\", t.\"count\", t.\"unique\", r.\"Value\" AS \"top\", r.\"Count\" AS "
        "\"freq\", NULL AS \"mean\", NULL AS \"std\", NULL AS \"min\", NULL AS \"25%\", NULL AS "
        "\"50%\", NULL AS \"75%\", NULL AS \"max\" FROM t JOIN r ON r.\"Column\" = t.\"Column\" AND "
        "k = 1 UNION ALL SELECT \"Column\", \"count\", NULL, NULL, NULL, \"mean\", \"std\", \"min\", "
        "\"25%\", \"50%\", \"75%\", \"max\" FROM n")
    o["numeric_quality"] = on_audit(per_column("audit", NUMBERS, lambda c: (
        f"count(*) FILTER ({q(c)} < 0) AS \"Negative Count\", count(*) FILTER ({q(c)} = 0) AS "
        f"\"Zero Count\", {missing(c)} AS \"Missing Count\"")))
    o["datetime_audit"] = on_audit(
        ", t AS (SELECT try_cast(\"Date\" || ' ' || \"Time\" AS timestamp) AS ts FROM audit) SELECT "
        "count(*) - count(ts) AS \"Invalid DateTime\", min(ts) AS \"Minimum DateTime\", max(ts) AS "
        "\"Maximum DateTime\" FROM t")
    for name, low in (("rating_validation", 0), ("rating_validation_alt", 1)):
        o[name] = on_audit(per_column("audit", ["Driver Ratings", "Customer Rating"], lambda c: (
            f"min({q(c)}) AS \"Min\", max({q(c)}) AS \"Max\", count(*) FILTER ({q(c)} < {low} OR "
            f"{q(c)} > 5) AS \"Outside {low}-5\", {missing(c)} AS \"Missing\"")))
    o["identifier_audit"] = on_audit(per_column("audit", ["Booking ID", "Customer ID"], lambda c: (
        f"{missing(c)} AS \"Missing\", count(DISTINCT {q(c)}) AS \"Unique\", count(*) - (SELECT "
        f"count(*) FROM (SELECT DISTINCT {q(c)} FROM audit)) AS \"Duplicate Values\"")))
    gaps = NUMBERS + ["Reason for cancelling by Customer", "Driver Cancellation Reason",
                      "Incomplete Rides Reason", "Payment Method"]
    gap_cols = ", ".join(f"{rnd(pct(missing(c), 'count(*)'))} AS {q(c)}" for c in gaps)
    o["missingness_by_status"] = on_audit(
        f"SELECT \"Booking Status\", {gap_cols} FROM audit WHERE \"Booking Status\" IS NOT NULL "
        "GROUP BY 1")
    checks = [(c, "Must be >= 0", f"{q(c)} < 0") for c in
              ["Avg VTAT", "Avg CTAT", "Booking Value", "Ride Distance"]]
    checks += [(c, "Must be between 0 and 5", f"{q(c)} < 0 OR {q(c)} > 5") for c in
               ["Driver Ratings", "Customer Rating"]]
    checks += [(c, "Must be 0 or 1", f"{q(c)} NOT IN (0, 1)") for c in
               ["Cancelled Rides by Customer", "Cancelled Rides by Driver", "Incomplete Rides"]]
    o["numeric_validation"] = on_clean(" UNION ALL ".join(
        f"SELECT {lit(c)} AS \"column\", {lit(r)} AS \"rule\", count(*) FILTER ({bad}) AS "
        f"\"invalid_values\" FROM coerced" for c, r, bad in checks))
    o["cleaning_summary"] = on_clean(
        f", dup AS (SELECT \"Booking ID\", count(*) AS n FROM deduped GROUP BY 1 HAVING count(*) > 1) "
        f"SELECT (SELECT count(*) FROM bookings_raw) AS original_rows, 21 AS original_columns, "
        "(SELECT count(*) FROM bookings_raw) - (SELECT count(*) FROM deduped) AS "
        "exact_duplicate_rows_removed, (SELECT count(*) FROM valid WHERE \"DateTime\" IS NULL) AS "
        "invalid_datetime_rows_removed, (SELECT count(\"Booking ID\") FROM dup) AS "
        "duplicate_booking_ids_found, (SELECT cast(coalesce(sum(n), 0) AS bigint) FROM dup) AS "
        f"rows_with_duplicate_booking_ids, count(*) AS final_rows, {len(CLEAN)} AS final_columns, "
        f"{total_missing(CLEAN)} AS missing_values_remaining, {DONE} AS completed_bookings, {LOST} AS "
        f"cancelled_bookings, {flag_sum('Is_Incomplete')} AS incomplete_bookings, "
        f"{flag_sum('Is_No_Driver_Found')} AS no_driver_found_bookings, {R1} AS "
        "total_revenue_completed_rides FROM clean")

    # cleaning and features
    o["clean_text"] = on_raw(
        f"SELECT {KEY}, {', '.join(f'{clean_sql(q(c))} AS {q(c)}' for c in TEXT)} FROM bookings_raw")
    o["audit_strip"] = on_raw(
        f"SELECT {KEY}, {', '.join(f'{strip_sql(q(c))} AS {q(c)}' for c in TEXT)} FROM bookings_raw")
    o["coerce_numeric"] = on_raw(
        f"SELECT {KEY}, {', '.join(f'try_cast({q(c)} AS double) AS {q(c)}' for c in NUMBERS)} "
        "FROM bookings_raw")
    ok = {"Driver Ratings": "x BETWEEN 0 AND 5", "Customer Rating": "x BETWEEN 0 AND 5",
          "Cancelled Rides by Customer": "x IN (0, 1)", "Cancelled Rides by Driver": "x IN (0, 1)",
          "Incomplete Rides": "x IN (0, 1)"}
    nulled = ", ".join(
        f"CASE WHEN {ok.get(c, 'x >= 0').replace('x', f'try_cast({q(c)} AS double)')} THEN "
        f"try_cast({q(c)} AS double) END AS {q(c)}" for c in NUMBERS)
    o["null_invalid_numeric"] = on_raw(f"SELECT {KEY}, {nulled} FROM bookings_raw")
    o["parse_datetime"] = on_raw(
        f"SELECT {KEY}, \"Date\", \"Time\", try_cast(\"Date\" || ' ' || \"Time\" AS timestamp) AS "
        "\"DateTime\" FROM bookings_raw WHERE try_cast(\"Date\" || ' ' || \"Time\" AS timestamp) IS "
        "NOT NULL")
    o["drop_exact_duplicates"] = on_clean("SELECT * FROM deduped")
    derived = {
        "calendar_features": ["Year", "Month", "Month_Name", "Day", "Day_of_Week", "Day_Name", "Hour",
                              "Is_Weekend"],
        "time_period": ["Time_Period"],
        "outcome_flags": ["Is_Completed", "Is_Cancelled", "Is_Incomplete", "Is_No_Driver_Found"],
        "booking_outcome": ["Booking_Outcome"], "revenue_col": ["Revenue"],
        "fare_per_km": ["Fare_Per_KM"], "availability_flags": CLEAN[-7:],
    }
    for name, names in derived.items():
        o[name] = on_clean(f"SELECT {KEY}, {cols(names)} FROM clean")
    o["time_period_alt"] = on_alt(f"SELECT {KEY}, \"Time_Period\" FROM alt")
    o["route_label"] = on_clean(f"SELECT {KEY}, \"Route\" FROM {ROUTE.format('clean')}")
    o["month_label"] = on_clean(
        f"SELECT {KEY}, \"Year\" || '-' || lpad(cast(\"Month\" AS varchar), 2, '0') AS "
        "\"Month_Label\" FROM clean")
    o["clean_bookings"] = on_clean("SELECT * FROM clean")
    o["clean_bookings_alt"] = on_alt("SELECT * FROM alt")

    # filters and spines
    o["filter_equals"] = on_clean(
        f"SELECT {KEY}, \"Payment Method\" FROM clean WHERE \"Payment Method\" = 'UPI'")
    o["normalise_headers"] = on_clean(
        f"SELECT {KEY}, \"Booking ID\" AS \"booking id\", \"Vehicle Type\" AS \"vehicle type\", "
        "\"Booking Value\" AS \"booking value\" FROM clean")
    o["first_matching_column"] = on_clean(f"SELECT {KEY}, \"Booking Value\" AS \"Found\" FROM clean")
    o["filter_in_list"] = on_clean(
        f"SELECT {KEY}, \"Payment Method\" FROM clean WHERE \"Payment Method\" IN ('UPI', 'Cash')")
    o["filter_hour_between"] = on_clean(
        f"SELECT {KEY}, \"Hour\" FROM clean WHERE \"Hour\" BETWEEN 7 AND 9")
    o["filter_day_type"] = on_clean(
        f"SELECT {KEY}, \"Day_Name\" FROM clean WHERE \"Is_Weekend\" = 1")
    o["filter_bookings"] = on_clean(f"SELECT {KEY}, \"Vehicle Type\", \"Hour\" FROM {FILTERED}")
    o["filter_nonblank_reason"] = on_clean(
        f"SELECT {KEY}, \"Driver Cancellation Reason\" FROM clean WHERE "
        "lower(trim(\"Driver Cancellation Reason\")) NOT IN ('', 'nan')")
    o["distinct_values_sorted"] = on_clean(
        "SELECT DISTINCT \"Vehicle Type\" FROM clean WHERE \"Vehicle Type\" IS NOT NULL")
    demand_names = [*SHORT, *SHORT_RATES]
    o["reindex_spine"] = on_clean(on_days(
        grouped(["Day_Name"], SHORT, SHORT_RATES), demand_names))
    o["zero_fill_buckets"] = on_clean(
        bucket_report("clean"))
    o["resample_spine"] = on_clean(daily("clean"))

    # reports
    labels = ["Total Bookings", "Completed Bookings", "Cancelled Bookings", "Incomplete Bookings",
              "No Driver Found", "Completion Rate (%)", "Cancellation Rate (%)", "Incomplete Rate (%)",
              "No Driver Found Rate (%)", "Completed Ride Revenue", "Average Booking Value",
              "Average Ride Distance", "Average Driver Rating", "Average Customer Rating"]
    o["executive_kpis"] = on_clean(long_metrics("clean", [
        (label, f"cast({e} AS double)") for label, (_, e) in zip(labels, kpi_row("clean", R1))]))
    o["insight_kpis"] = on_clean(wide("clean", kpis))

    def over_done(c):
        value = rnd(mean(f'CASE WHEN "Is_Completed" = 1 THEN {q(c)} END'), 6)
        return f"CASE WHEN {DONE} > 0 THEN {value} ELSE 0 END"

    def share0(c):
        return f"coalesce({pct(flag_sum(c), 'count(*)')}, 0)"

    o["dashboard_kpis"] = on_clean(wide(FILTERED, [
        ("total_bookings", "count(*)"), ("completed", DONE), ("cancelled", LOST),
        ("no_driver", flag_sum("Is_No_Driver_Found")), ("completion_rate", share0("Is_Completed")),
        ("cancellation_rate", share0("Is_Cancelled")),
        ("no_driver_rate", share0("Is_No_Driver_Found")), ("revenue", R2),
        ("average_booking_value", over_done("Booking Value")),
        ("average_distance", over_done("Ride Distance"))]))
    o["booking_status_analysis"] = on_clean(
        "SELECT *, " + rnd("cast(\"Bookings\" AS double) / (SELECT count(*) FROM clean) * 100")
        + " AS \"Booking_Percentage\" FROM (" + grouped(["Booking Status"], {
            "Bookings": BOOKINGS, "Revenue": R1, "Avg_Booking_Value": mean2("Booking Value"),
            "Avg_Ride_Distance": mean2("Ride Distance")}) + ")")
    for name in ("read_optional_report",):
        o[name] = o["booking_status_analysis"]
    o["vehicle_performance"] = on_clean(grouped(["Vehicle Type"], LONG | {
        "Avg_Booking_Value": mean2("Booking Value"), "Avg_Ride_Distance": mean2("Ride Distance"),
        "Avg_Driver_Rating": mean2("Driver Ratings"),
        "Avg_Customer_Rating": mean2("Customer Rating")}, LONG_RATES))
    o["write_report_csv"] = o["vehicle_performance"]
    o["hourly_demand"] = on_clean(grouped(["Hour"], SHORT, SHORT_RATES))
    o["day_of_week"] = on_clean(on_days(grouped(["Day_Name"], SHORT, SHORT_RATES), demand_names))
    o["time_period_analysis"] = on_clean(grouped(["Time_Period"], SHORT, SHORT_RATES))
    done = "(SELECT * FROM clean WHERE \"Is_Completed\" = 1)"
    bv, rd = q("Booking Value"), q("Ride Distance")
    o["revenue_summary"] = on_clean(long_metrics(done, [
        ("Total Revenue", rnd(money(bv))), ("Average Revenue per Completed Ride", rnd(mean(bv))),
        ("Median Revenue per Completed Ride", rnd(f"quantile_cont({bv}, 0.5)")),
        ("Minimum Booking Value", rnd(f"min({bv})")), ("Maximum Booking Value", rnd(f"max({bv})")),
        ("Average Ride Distance", rnd(mean(rd))),
        ("Average Fare per KM", rnd(mean(q("Fare_Per_KM"))))]))
    o["monthly_revenue"] = on_clean(grouped(["Year", "Month"], {
        "Completed_Bookings": BOOKINGS, "Revenue": R3, "Avg_Booking_Value": mean2("Booking Value")},
        source=done))
    o["month_trend"] = on_clean(
        "SELECT \"Year\" || '-' || lpad(cast(\"Month\" AS varchar), 2, '0') AS \"Month\", \"Revenue\" "
        "FROM (" + grouped(["Year", "Month"], {"Revenue": R3}, source=done) + ")")
    by_customer = ("Cancelled by Customer", "Reason for cancelling by Customer")
    by_driver = ("Cancelled by Driver", "Driver Cancellation Reason")
    o["customer_cancel_reasons"] = on_clean(cancel_report(*by_customer))
    o["driver_cancel_reasons"] = on_clean(cancel_report(*by_driver))
    o["chart_customer_reasons"] = on_clean(reasons(*by_customer))
    o["chart_driver_reasons"] = on_clean(reasons(*by_driver))
    pickup = grouped(["Pickup Location"], LONG | {"Avg_Ride_Distance": mean2("Ride Distance")},
                     LONG_RATES)
    route = grouped(["Pickup Location", "Drop Location"], LONG | {
        "Avg_Ride_Distance": mean2("Ride Distance"), "Avg_Booking_Value": mean2("Booking Value")},
        LONG_RATES)
    o["pickup_analysis"] = on_clean(pickup)
    o["drop_analysis"] = on_clean(grouped(["Drop Location"], LONG, LONG_RATES))
    o["route_analysis"] = on_clean(route)
    o["chart_top_pickups"] = on_clean(
        pickup + " ORDER BY \"Total_Bookings\" DESC, \"Pickup Location\" LIMIT 15")
    o["chart_top_routes"] = on_clean(
        f"SELECT * FROM {ROUTE.format('(' + route + ')')} ORDER BY \"Total_Bookings\" DESC, "
        "\"Pickup Location\", \"Drop Location\" LIMIT 15")
    slim = {"Bookings": BOOKINGS, "Completed": DONE, "Revenue": R1}
    o["top_vehicles_by_revenue"] = on_clean(grouped(["Vehicle Type"], slim | {
        "Cancellation_Rate": rnd(pct(LOST, "count(\"Is_Cancelled\")"))},
        tail="ORDER BY \"Revenue\" DESC, \"Vehicle Type\" LIMIT 10"))
    o["top_pickups"] = on_clean(grouped(["Pickup Location"], slim,
        tail="ORDER BY \"Bookings\" DESC, \"Pickup Location\" LIMIT 20"))
    o["top_routes"] = on_clean(
        "SELECT * FROM " + ROUTE.format("(" + grouped(["Pickup Location", "Drop Location"], slim) + ")")
        + " ORDER BY \"Bookings\" DESC, \"Pickup Location\", \"Drop Location\" LIMIT 20")
    o["payment_analysis"] = on_clean(
        "SELECT *, " + rnd("cast(\"Bookings\" AS double) / sum(\"Bookings\") OVER () * 100")
        + " AS \"Booking_Percentage\" FROM (" + grouped(["Payment Method"], {
            "Bookings": BOOKINGS, "Completed_Bookings": DONE, "Revenue": R1,
            "Avg_Booking_Value": mean2("Booking Value")},
            {"Completion_Rate": ("Completed_Bookings", "Bookings")}) + ")")
    dr, cr = q("Driver Ratings"), q("Customer Rating")
    o["rating_summary"] = on_clean(long_metrics("clean", [
        ("Average Driver Rating", f"coalesce({rnd(mean(dr))}, 0)"),
        ("Average Customer Rating", f"coalesce({rnd(mean(cr))}, 0)"),
        ("Median Driver Rating", rnd(f"quantile_cont({dr}, 0.5)")),
        ("Median Customer Rating", rnd(f"quantile_cont({cr}, 0.5)"))]))
    for name, c, label in (("driver_rating_distribution", dr, "Driver_Rating"),
                           ("customer_rating_distribution", cr, "Customer_Rating")):
        o[name] = on_clean(f"SELECT {c} AS {q(label)}, count(*) AS \"Count\" FROM clean WHERE {c} "
                           "IS NOT NULL GROUP BY 1")
    waits = {"Avg_VTAT": mean2("Avg VTAT"), "Avg_CTAT": mean2("Avg CTAT"), "Bookings": BOOKINGS}
    o["wait_by_status"] = on_clean(grouped(["Booking Status"], waits))
    o["wait_by_vehicle"] = on_clean(grouped(["Vehicle Type"], waits))
    o["distance_summary"] = on_clean(long_metrics(done, [
        ("Average Distance", rnd(mean(rd))), ("Median Distance", rnd(f"quantile_cont({rd}, 0.5)")),
        ("Minimum Distance", rnd(f"min({rd})")), ("Maximum Distance", rnd(f"max({rd})"))]))

    # statistics, windows, top-k
    o["distance_buckets"] = on_clean(bucket_report("clean"))
    o["cut_right_closed"] = on_clean(
        f"SELECT {KEY}, {bucket_case(rd)} AS \"Distance_Bucket\" FROM clean")
    o["correlation_matrix"] = on_clean(corr_rows("clean", CORR))
    o["write_indexed_csv"] = o["correlation_matrix"]
    o["correlation_matrix_short"] = on_alt(corr_rows("alt", CORR_SHORT))
    o["histogram_equal_width"] = on_clean(
        f", x AS (SELECT {rd} AS v FROM {done} WHERE {rd} IS NOT NULL), b AS (SELECT min(v) AS lo, "
        "max(v) AS hi FROM x), w AS (SELECT lo, (hi - lo) / 25 AS w FROM b), h AS (SELECT "
        "least(cast(floor((v - lo) / w) AS int) + 1, 25) AS bin, count(*) AS n FROM x, w GROUP BY 1) "
        f"SELECT cast(i AS int) AS \"Bin\", {rnd('lo + w * (i - 1)', 6)} AS \"Lower\", "
        f"{rnd('lo + w * i', 6)} AS \"Upper\", coalesce(n, 0) AS \"Count\" FROM range(1, 26) r(i) "
        "CROSS JOIN w LEFT JOIN h ON bin = i")
    o["histogram_rating"] = on_clean(
        f", x AS (SELECT cast({dr} AS decimal(28,6)) AS v FROM {done} WHERE {dr} IS NOT NULL), "
        "steps AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10]::decimal(10,2)[]) AS w), "
        "chosen AS (SELECT min(w) AS w FROM steps WHERE (SELECT floor(max(v) / w) - floor(min(v) / w) "
        "FROM x) < 10), bounds AS (SELECT w, cast(floor(min(v) / w) AS bigint) AS lo, "
        "cast(floor(max(v) / w) AS bigint) AS hi FROM x, chosen GROUP BY w), places AS (SELECT w, lo, "
        "unnest(range(lo, hi + 1)) AS spot FROM bounds) SELECT cast(spot - lo + 1 AS int) AS \"Bin\", "
        "cast(spot * w AS double) AS \"Lower\", cast((spot + 1) * w AS double) AS \"Upper\", "
        "(SELECT count(*) FROM x WHERE v >= spot * w AND v < (spot + 1) * w) AS \"Count\" FROM places")
    o["daily_revenue"] = on_clean(daily("clean"))
    o["dash_daily_revenue"] = on_clean(daily(FILTERED))
    o["share_of_total"] = on_clean(value_share("clean", "Pickup Location", "Bookings", "Share"))
    o["first_occurrence_flag"] = on_clean(
        f"SELECT {KEY}, \"Booking ID\", cast(row_number() OVER (PARTITION BY \"Booking ID\" ORDER BY "
        f"{KEY}) > 1 AS int) AS \"Is_Duplicate\" FROM clean")
    o["group_size_flag"] = on_clean(
        f"SELECT {KEY}, \"Booking ID\", cast(count(*) OVER (PARTITION BY \"Booking ID\") > 1 AS int) "
        "AS \"Is_Repeated_ID\" FROM clean")
    o["argmax"] = on_clean(
        f", s AS ({grouped(['Hour'], SHORT, SHORT_RATES)}) SELECT {best('Hour', 'Bookings')} AS "
        f"\"Peak_Hour\", {best('Hour', 'Revenue')} AS \"Best_Revenue_Hour\"")
    o["top_k"] = on_clean(
        f"SELECT {KEY}, {bv} FROM clean WHERE {bv} IS NOT NULL ORDER BY {bv} DESC, {KEY} LIMIT 20")
    o["row_cap"] = on_clean(
        f"SELECT {KEY}, \"DateTime\" FROM {FILTERED} ORDER BY {KEY} LIMIT 5000")
    o["fixed_size_sample"] = on_clean(
        f"SELECT {rd}, {bv} FROM {done} WHERE {rd} IS NOT NULL AND {bv} IS NOT NULL ORDER BY {HASH}, "
        f"{KEY} LIMIT 5000")

    o["dash_value_vs_distance"] = on_clean(
        f"SELECT {rd}, {bv} FROM {FILTERED} WHERE \"Is_Completed\" = 1 AND {rd} IS NOT NULL AND {bv} "
        f"IS NOT NULL ORDER BY {HASH}, {KEY} LIMIT 5000")

    # insights
    routes = ROUTE.format("clean")
    o["vehicle_insights"] = on_clean(section("Vehicle Type"))
    o["hourly_insights"] = on_clean(section("Hour"))
    o["time_period_insights"] = on_clean(section("Time_Period"))
    o["location_insights"] = on_clean(
        section("Pickup Location", tail="ORDER BY bookings DESC, \"Pickup Location\" LIMIT 10"))
    o["route_insights"] = on_clean(
        section("Route", True, "ORDER BY bookings DESC, \"Route\" LIMIT 10", routes))
    o["payment_insights"] = on_clean(section("Payment Method", True))

    def top(key, picks, slim=False, source="clean"):
        return on_clean(f", s AS ({section(key, slim, source=source)}) SELECT {picks}")

    def peak(c):
        return f"(SELECT max({c}) FROM s)"

    o["vehicle_highlights"] = top("Vehicle Type",
        f"{best('Vehicle Type', 'bookings')} AS highest_demand_vehicle, "
        f"{best('Vehicle Type', 'revenue')} AS highest_revenue_vehicle, "
        f"{best('Vehicle Type', 'completion_rate')} AS highest_completion_vehicle")
    o["hourly_highlights"] = top("Hour",
        f"{best('Hour', 'bookings')} AS peak_hour, {peak('bookings')} AS peak_hour_bookings, "
        f"{best('Hour', 'revenue')} AS highest_revenue_hour, {peak('revenue')} AS "
        "highest_hourly_revenue")
    o["time_period_highlights"] = top("Time_Period",
        f"{best('Time_Period', 'bookings')} AS highest_demand_period")
    o["location_highlights"] = top("Pickup Location",
        f"{best('Pickup Location', 'bookings')} AS highest_demand_pickup, {peak('bookings')} AS "
        "highest_demand_pickup_bookings")
    o["route_highlights"] = top("Route",
        f"{best('Route', 'bookings')} AS highest_volume_route, {peak('bookings')} AS "
        "highest_volume_route_bookings", True, routes)
    o["payment_highlights"] = top("Payment Method",
        f"{best('Payment Method', 'bookings')} AS most_used_payment_method, {peak('bookings')} AS "
        "most_used_payment_bookings", True)
    cd = "count(*) FILTER (\"Booking Status\" = 'Cancelled by Driver')"
    cc = "count(*) FILTER (\"Booking Status\" = 'Cancelled by Customer')"
    o["cancellation_insights"] = on_clean(
        f"SELECT {cd} + {cc} AS total_cancelled, {cd} AS driver_cancellation_count, {cc} AS "
        f"customer_cancellation_count, {reason_json(reasons(*by_driver))} AS "
        f"top_driver_cancellation_reasons, {reason_json(reasons(*by_customer))} AS "
        "top_customer_cancellation_reasons FROM clean")
    o["incomplete_insights"] = on_clean(
        f"SELECT {flag_sum('Is_Incomplete')} AS total_incomplete, "
        f"{reason_json(reasons('Incomplete', 'Incomplete Rides Reason'))} AS top_incomplete_reasons "
        "FROM clean")
    o["rating_insights"] = on_clean(wide(done, [
        ("average_driver_rating", rnd(mean(dr))), ("average_customer_rating", rnd(mean(cr))),
        ("driver_rating_min", rnd(f"min({dr})")), ("driver_rating_max", rnd(f"max({dr})")),
        ("customer_rating_min", rnd(f"min({cr})")), ("customer_rating_max", rnd(f"max({cr})"))]))
    o["revenue_insights"] = on_clean(
        f", s AS ({grouped(['Vehicle Type'], {'revenue': R3}, source=done)}) " + wide(done, [
            ("completed_ride_revenue", rnd(money(bv))),
            ("average_completed_booking_value", rnd(mean(bv))),
            ("average_completed_ride_distance", rnd(mean(rd))),
            ("top_revenue_vehicle", best("Vehicle Type", "revenue"))]))

    def winner(key, source="clean"):
        return (f"(SELECT {q(key)} FROM {source} WHERE {q(key)} IS NOT NULL GROUP BY 1 ORDER BY "
                f"count(\"Booking ID\") DESC, 1 LIMIT 1)")

    comma = lambda x: f"format('{{:,}}', cast({x} AS bigint))"
    two = lambda x: f"format('{{:.2f}}', {x})"
    sentences = [
        f"'The dataset contains ' || {comma('total_bookings')} || ' bookings, with ' || "
        f"{comma('completed_bookings')} || ' completed rides and a ' || {two('completion_rate')} || "
        "'% completion rate.'",
        f"{comma('cancelled_bookings')} || ' bookings were cancelled, representing ' || "
        f"{two('cancellation_rate')} || '% of all bookings.'",
        f"{comma('no_driver_found')} || ' bookings had no driver found, representing ' || "
        f"{two('no_driver_found_rate')} || '% of total bookings.'",
        f"'Completed rides generated approximately ' || {comma('round(completed_ride_revenue)')} || "
        "' in booking value.'",
        f"'The highest booking volume occurs at hour ' || {winner('Hour')} || ':00.'",
        f"'The highest-demand vehicle category is ' || {winner('Vehicle Type')} || '.'",
        f"'The highest-volume pickup location is ' || {winner('Pickup Location')} || '.'",
        f"'The most frequently used payment method is ' || {winner('Payment Method')} || '.'",
    ]
    o["key_findings"] = on_clean(f", k AS ({wide('clean', kpis)}) " + " UNION ALL ".join(
        f"SELECT {i} AS \"Position\", {s} AS \"Finding\" FROM k" for i, s in enumerate(sentences, 1)))
    frac = lambda c: rnd(f"{flag_sum(c)} / cast(count(*) AS double)", 4)
    o["insights_summary"] = on_alt(wide("alt", [
        ("total_bookings", "count(*)"), ("completed_bookings", DONE),
        ("cancellation_rate", frac("Is_Cancelled")), ("completion_rate", frac("Is_Completed")),
        ("no_driver_rate", frac("Is_No_Driver_Found")), ("completed_revenue", R1),
        ("peak_booking_hour", winner("Hour", "alt")), ("top_vehicle", winner("Vehicle Type", "alt")),
        ("top_pickup_location", winner("Pickup Location", "alt")),
        ("top_payment_method", winner("Payment Method", "alt"))]))

    # the document: every value by its path
    number = lambda x: f"cast(cast({x} AS decimal(28,6)) AS varchar)"
    text = lambda x: f"cast({x} AS varchar)"

    def single(path, source, values):
        return [f"SELECT {lit(f'{path}.{n}')} AS path, {as_(n)} AS value FROM ({source})" for n, as_ in values]

    def listed(path, source, order, values):
        ranked = f"(SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({source}))"
        return [f"SELECT {lit(path)} || '[' || i || '].{n}' AS path, {as_(q(n))} AS value FROM {ranked}"
                for n, as_ in values]

    def reason_leaves(path, report):
        return [f"SELECT {lit(path)} || '.' || \"Reason\" AS path, {number('\"Bookings\"')} AS value "
                f"FROM ({report})"]

    def measured(key, slim=False, key_as=text):
        names = ["bookings", "completed", "completion_rate", "revenue"]
        names += [] if slim else ["cancelled", "cancellation_rate"]
        return [(key, key_as), *[(n, number) for n in names]]

    def values_of(key, label_names, number_names, slim=False, source="clean", label_as=text):
        s_ = f"WITH s AS ({section(key, slim, source=source)}) SELECT "
        picks = [f"{best(key, by)} AS {n}" for n, by in label_names]
        picks += [f"{peak(by)} AS {n}" for n, by in number_names]
        return s_ + ", ".join(picks), [(n, label_as) for n, _ in label_names] + [(n, number) for n, _ in number_names]

    kpi_names = [(n, number) for n, _ in kpis]
    leaves = ["SELECT 'project' AS path, 'Ride bookings' AS value", "SELECT 'title', 'Ride booking analytics'",
              f"SELECT 'dataset.rows', {number('count(*)')} FROM clean", "SELECT 'dataset.source_file', 'bookings'"]
    leaves += single("executive_kpis", "SELECT * FROM k", kpi_names)
    for path, key, slim, source, labels, numbers, lists in (
        ("vehicle_insights", "Vehicle Type", False, "clean",
         [("highest_demand_vehicle", "bookings"), ("highest_revenue_vehicle", "revenue"),
          ("highest_completion_vehicle", "completion_rate")], [],
         ("vehicle_summary", "bookings DESC, \"Vehicle Type\"", "")),
        ("hourly_insights", "Hour", False, "clean",
         [("peak_hour", "bookings"), ("highest_revenue_hour", "revenue")],
         [("peak_hour_bookings", "bookings"), ("highest_hourly_revenue", "revenue")],
         ("hourly_summary", "\"Hour\"", "")),
        ("time_period_insights", "Time_Period", False, "clean", [("highest_demand_period", "bookings")], [],
         ("period_summary", "\"Time_Period\"", "")),
        ("location_insights", "Pickup Location", False, "clean", [("highest_demand_pickup", "bookings")],
         [("highest_demand_pickup_bookings", "bookings")],
         ("top_pickup_locations", "bookings DESC, \"Pickup Location\"", "LIMIT 10")),
        ("route_insights", "Route", True, routes, [("highest_volume_route", "bookings")],
         [("highest_volume_route_bookings", "bookings")],
         ("top_routes", "bookings DESC, \"Route\"", "LIMIT 10")),
        ("payment_insights", "Payment Method", True, "clean", [("most_used_payment_method", "bookings")],
         [("most_used_payment_bookings", "bookings")], ("payment_summary", "\"Payment Method\"", "")),
    ):
        as_ = number if key == "Hour" else text
        leaves += single(path, *values_of(key, labels, numbers, slim, source, as_))
        name, order, limit = lists
        rows_ = section(key, slim, f"ORDER BY {order} {limit}" if limit else "", source)
        leaves += listed(f"{path}.{name}", rows_, order, measured(key, slim, as_))
    leaves += single("cancellation_insights", f"SELECT {cd} + {cc} AS total_cancelled, {cd} AS "
                     f"driver_cancellation_count, {cc} AS customer_cancellation_count FROM clean",
                     [(n, number) for n in ("total_cancelled", "driver_cancellation_count",
                                            "customer_cancellation_count")])
    leaves += reason_leaves("cancellation_insights.top_driver_cancellation_reasons", reasons(*by_driver))
    leaves += reason_leaves("cancellation_insights.top_customer_cancellation_reasons", reasons(*by_customer))
    leaves += [f"SELECT 'incomplete_insights.total_incomplete', {number(flag_sum('Is_Incomplete'))} FROM clean"]
    leaves += reason_leaves("incomplete_insights.top_incomplete_reasons",
                            reasons("Incomplete", "Incomplete Rides Reason"))
    rating = [("average_driver_rating", rnd(mean(dr))), ("average_customer_rating", rnd(mean(cr))),
              ("driver_rating_min", rnd(f"min({dr})")), ("driver_rating_max", rnd(f"max({dr})")),
              ("customer_rating_min", rnd(f"min({cr})")), ("customer_rating_max", rnd(f"max({cr})"))]
    leaves += single("rating_insights", wide(done, rating), [(n, number) for n, _ in rating])
    value = [("completed_ride_revenue", rnd(money(bv))), ("average_completed_booking_value", rnd(mean(bv))),
             ("average_completed_ride_distance", rnd(mean(rd)))]
    leaves += single("revenue_insights", wide(done, value), [(n, number) for n, _ in value])
    leaves += [f"SELECT 'revenue_insights.top_revenue_vehicle', (WITH s AS ("
               f"{grouped(['Vehicle Type'], {'revenue': R3}, source=done)}) SELECT {best('Vehicle Type', 'revenue')})"]
    leaves += [f"SELECT 'key_findings[{i}]', {x} FROM k" for i, x in enumerate(sentences)]
    leaves += [f"SELECT 'recommendations[{i}]', {lit(x)}" for i, x in enumerate(RECOMMENDATIONS)]
    model = (f", k AS ({wide('clean', kpis)}){SCORED}, scores AS (SELECT {rnd(ratio('tp + tn', 'tp + tn + fp + fn'), 6)}"
             f" AS \"Accuracy\", {rnd(ratio('tp', 'tp + fp'), 6)} AS \"Precision\", {rnd(ratio('tp', 'tp + fn'), 6)} AS "
             f"\"Recall\", {rnd(ratio('2 * tp', '2 * tp + fp + fn'), 6)} AS \"F1 Score\", {rnd(AUC, 6)} AS \"ROC-AUC\" "
             f"FROM cm), matrix AS (WITH {corr_rows('clean', CORR)[2:]}), "
             "features AS (SELECT \"Column\" AS feature, \"Is_Completed\" AS importance FROM matrix WHERE "
             "\"Is_Completed\" IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 10)")
    score_names = ["Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"]
    leaves += [f"SELECT {lit(f'ai_insights.model_metrics.{n}')}, {number(q(n))} FROM scores" for n in score_names]
    leaves += listed("ai_insights.top_predictive_features", "SELECT * FROM features", "importance DESC, feature",
                     [("feature", text), ("importance", number)])
    for name in ("insights_document", "write_insights_json"):
        o[name] = on_clean(f"{model} " + " UNION ALL ".join(leaves))
    heads = ["# Ride bookings — Business Insights", "", "## Executive KPIs", "", "", "## Key Findings", "", "",
             "## Operational Recommendations", "", "", "## AI Model", "", "", "### Top Predictive Features", ""]
    shown = [("Total Bookings", "total_bookings"), ("Completed Bookings", "completed_bookings"),
             ("Cancelled Bookings", "cancelled_bookings"), ("Incomplete Bookings", "incomplete_bookings"),
             ("No Driver Found", "no_driver_found"), ("Completion Rate", "completion_rate"),
             ("Cancellation Rate", "cancellation_rate"), ("Incomplete Rate", "incomplete_rate"),
             ("No Driver Found Rate", "no_driver_found_rate"),
             ("Completed Ride Revenue", "completed_ride_revenue"),
             ("Average Booking Value", "average_booking_value"), ("Average Ride Distance", "average_ride_distance"),
             ("Average Driver Rating", "average_driver_rating"),
             ("Average Customer Rating", "average_customer_rating")]

    def shown_as(n):
        if n.endswith("_rate") and n.startswith(("completion", "cancellation", "incomplete", "no_driver")):
            return f"{two(n)} || '%'"
        return two(n) if n.startswith("average") else comma(f"round({n})")

    lines = [f"SELECT {lit(h)} AS value" for h in heads]
    lines += [f"SELECT {lit(f'- {label}: **')} || {shown_as(n)} || '**' FROM k" for label, n in shown]
    lines += [f"SELECT '- ' || {x} FROM k" for x in sentences]
    lines += [f"SELECT {lit(f'- {x}')}" for x in RECOMMENDATIONS]
    lines += [f"SELECT {lit(f'- {n}: **')} || {text(q(n))} || '**' FROM scores" for n in score_names]
    lines += [f"SELECT '- ' || feature || ': ' || {text('importance')} FROM features"]
    o["write_insights_markdown"] = on_clean(f"{model} " + " UNION ALL ".join(lines))
    o["recommendations"] = " UNION ALL ".join(
        f"SELECT {i} AS \"Position\", {lit(x)} AS \"Recommendation\"" for i, x in enumerate(RECOMMENDATIONS, 1))

    # dashboard
    o["dash_status_counts"] = on_clean(counts("Booking Status", FILTERED))
    o["dash_hourly"] = on_clean(counts("Hour", FILTERED))
    o["dash_vehicle"] = on_clean(grouped(["Vehicle Type"], {
        "Bookings": BOOKINGS, "Completed": DONE, "Cancelled": LOST, "Revenue": R3},
        {"Completion Rate": ("Completed", "Bookings"), "Cancellation Rate": ("Cancelled", "Bookings")},
        FILTERED, None))
    o["dash_time_period"] = on_clean(counts("Time_Period", FILTERED))
    o["dash_day_of_week"] = on_clean(on_days(counts("Day_Name", FILTERED), ["Bookings"]))
    o["dash_payment"] = on_clean(grouped(["Payment Method"], {"Bookings": BOOKINGS, "Revenue": R3},
                                         None, FILTERED))
    for name, key in (("dash_top_pickups", "Pickup Location"), ("dash_top_drops", "Drop Location")):
        o[name] = on_clean(counts(key, FILTERED, f"ORDER BY \"Bookings\" DESC, {q(key)} LIMIT 15"))
    o["dash_top_routes"] = on_clean(grouped(["Route"], {
        "Bookings": BOOKINGS, "Completed": DONE, "Revenue": R3},
        {"Completion Rate": ("Completed", "Bookings")}, ROUTE.format(FILTERED), None,
        "ORDER BY \"Bookings\" DESC, \"Route\" LIMIT 15"))
    o["dash_driver_reasons"] = on_clean(reasons(*by_driver))
    o["dash_customer_reasons"] = on_clean(reasons(*by_customer))
    done_f = f"(SELECT * FROM {FILTERED} WHERE \"Is_Completed\" = 1)"
    o["dash_rating_means"] = on_clean(wide(done_f, [
        ("Average Driver Rating", rnd(mean(dr))), ("Average Customer Rating", rnd(mean(cr))),
        ("Average Ride Distance", rnd(mean(rd)))]))

    # alternative rules
    done_a = "(SELECT * FROM alt WHERE \"Is_Completed\" = 1)"
    o["nb_vehicle"] = on_alt(
        "SELECT *, cast(\"Completed\" AS double) / \"Bookings\" AS \"Completion_Rate\" FROM ("
        + grouped(["Vehicle Type"], {"Bookings": "count(*)", "Completed": DONE, "Revenue": R1},
                  source="alt") + ")")
    for name, key, tail in (
        ("nb_status_counts", "Booking Status", ""), ("nb_period_counts", "Time_Period", ""),
        ("nb_payment_counts", "Payment Method", ""),
        ("nb_top_pickups", "Pickup Location", "ORDER BY \"Bookings\" DESC, 1 LIMIT 10"),
        ("nb_top_drops", "Drop Location", "ORDER BY \"Bookings\" DESC, 1 LIMIT 10"),
    ):
        o[name] = on_alt(counts(key, "alt", tail))
    o["nb_customer_reasons"] = on_alt(reasons(*by_customer, source="alt"))
    o["nb_hourly"] = on_alt(counts("Hour", "alt", ""))
    o["nb_daily"] = on_alt(counts("Day_Name", "alt", ""))
    o["sort_by_time"] = on_clean(f"SELECT {KEY}, \"DateTime\" FROM clean ORDER BY ALL")
    o["nb_driver_reasons"] = on_alt(reasons(*by_driver, source="alt"))
    frac6 = lambda c: rnd(f"{flag_sum(c)} / cast(count(*) AS double)", 6)
    number = lambda x: f"cast({x} AS double)"
    o["nb_kpis"] = on_alt(long_metrics("alt", [
        ("Total Bookings", number("count(*)")), ("Completed Bookings", number(DONE)),
        ("Cancelled Bookings", number(LOST)),
        ("Incomplete Bookings", number(flag_sum("Is_Incomplete"))),
        ("No Driver Found", number(flag_sum("Is_No_Driver_Found"))),
        ("Completion Rate", frac6("Is_Completed")), ("Cancellation Rate", frac6("Is_Cancelled")),
        ("No Driver Found Rate", frac6("Is_No_Driver_Found")),
        ("Incomplete Rate", frac6("Is_Incomplete")), ("Completed Ride Revenue", R1),
        ("Average Booking Value", rnd(mean('CASE WHEN "Is_Completed" = 1 THEN "Booking Value" END'))),
        ("Average Ride Distance", rnd(mean('CASE WHEN "Is_Completed" = 1 THEN "Ride Distance" END'))),
        ("Average Driver Rating", rnd(mean(dr))), ("Average Customer Rating", rnd(mean(cr)))]))
    o["nb_monthly_revenue"] = on_alt(grouped(["Year", "Month"], {"Revenue": R1}, source=done_a))
    o["nb_revenue_by_vehicle"] = on_alt(grouped(["Vehicle Type"], {"Revenue": R1}, source=done_a))
    o["nb_describe"] = on_alt(numeric_rows(
        "alt", ["Driver Ratings", "Customer Rating", "Ride Distance", "Avg VTAT", "Avg CTAT"]))

    # learning
    o["ml_target"] = on_clean(f"SELECT {KEY}, {TARGET} FROM clean")
    o["ml_features_prebooking"] = on_clean(f"SELECT {KEY}, {cols(PRE)}, {TARGET} FROM clean")
    o["ml_features_wide"] = on_clean(f"SELECT {KEY}, {cols(WIDE)}, {TARGET} FROM clean")
    o["target_distribution"] = on_clean(
        f"SELECT \"Target_Completed\", count(*) AS \"Count\" FROM (SELECT {TARGET} FROM clean) "
        "GROUP BY 1")
    o["stratified_split"] = on_clean(
        f"{SPLIT} SELECT {KEY}, \"Target_Completed\", \"Is_Test\" FROM split")
    train = "(SELECT * FROM split WHERE \"Is_Test\" = 0)"
    o["impute_median"] = on_clean(f"{SPLIT} " + per_column(
        train, [c for c in WIDE if c not in CATEGORICAL],
        lambda c: f"{rnd(f'quantile_cont({q(c)}, 0.5)', 6)} AS \"Value\""))
    o["impute_mode"] = on_clean(
        f"{SPLIT}, v AS ({value_counts_cte(train, CATEGORICAL)}) SELECT \"Column\", \"Value\" FROM v "
        "WHERE \"Value\" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY \"Column\" ORDER BY "
        "\"Count\" DESC, \"Value\") = 1")
    o["save_load_model"] = on_clean(
        f"{SPLIT} SELECT count(*) AS \"Rows\", count(*) AS \"Same\" FROM split WHERE \"Is_Test\" = 1")
    pre_numbers = [c for c in PRE if c not in CATEGORICAL]
    pre_texts = [c for c in CATEGORICAL if c in PRE]
    gaps = ", ".join(
        [f"(SELECT quantile_cont({q(c)}, 0.5) FROM {train}) AS {q(c)}" for c in pre_numbers]
        + [f"(SELECT {q(c)} FROM {train} WHERE {q(c)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
           f"AS {q(c)}" for c in pre_texts])
    filled = lambda c: f"coalesce(r.{q(c)}, g.{q(c)})"
    tested = "(SELECT * FROM split WHERE \"Is_Test\" = 1)"
    slots = [f"SELECT 0 AS block, {i} AS spot, {lit(f'numeric__{c}')} AS name, "
             f"(SELECT cast(sum({filled(c)}) AS double) FROM {tested} r, g) AS total"
             for i, c in enumerate(pre_numbers)]
    slots += [f"SELECT {i} AS block, row_number() OVER (ORDER BY v) AS spot, {lit(f'categorical__{c}_')} || v AS name, "
              f"(SELECT cast(count(*) AS double) FROM {tested} r, g WHERE {filled(c)} = v) AS total "
              f"FROM (SELECT DISTINCT {filled(c)} AS v FROM {train} r, g)" for i, c in enumerate(pre_texts, 1)]
    o["column_transform"] = on_clean(
        f"{SPLIT}, g AS (SELECT {gaps}) SELECT cast(row_number() OVER (ORDER BY block, spot) - 1 AS int) AS \"Slot\", "
        f"name AS \"Feature\", total AS \"Total\" FROM ({' UNION ALL '.join(slots)})")
    o["class_weights"] = on_clean(
        f"SELECT \"Target_Completed\", n AS \"Count\", cast(sum(n) OVER () AS double) / (n * 2) AS "
        f"\"Weight\" FROM (SELECT \"Target_Completed\", count(*) AS n FROM (SELECT {TARGET} FROM "
        "clean) GROUP BY 1)")
    f1 = ratio("2 * tp", "2 * tp + fp + fn")
    o["metrics_binary"] = on_clean(SCORED + " " + long_metrics("cm", [
        ("Accuracy", rnd(ratio("tp + tn", "tp + tn + fp + fn"), 6)),
        ("Precision", rnd(ratio("tp", "tp + fp"), 6)), ("Recall", rnd(ratio("tp", "tp + fn"), 6)),
        ("F1 Score", rnd(f1, 6)), ("ROC-AUC", rnd(AUC, 6))], value="Score"))
    o["roc_auc"] = on_clean(f"{SCORED} SELECT {rnd(AUC, 6)} AS roc_auc")
    o["confusion_matrix"] = on_clean(
        f"{SCORED} SELECT 'Actual_Not_Completed' AS \"Actual\", tn AS \"Predicted_Not_Completed\", fp "
        "AS \"Predicted_Completed\" FROM cm UNION ALL SELECT 'Actual_Completed', fn, tp FROM cm")
    n = [ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fp + fn")]
    p = [ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), f1]
    acc = ratio("tp + tn", "tp + tn + fp + fn")
    rows = [("Not Completed", n, "tn + fp"), ("Completed", p, "tp + fn"),
            ("accuracy", [acc] * 3, "tp + tn + fp + fn"),
            ("macro avg", [f"({a} + {b}) / 2" for a, b in zip(n, p)], "tp + tn + fp + fn"),
            ("weighted avg", [f"({a} * (tn + fp) + {b} * (tp + fn)) / (tp + tn + fp + fn)"
                              for a, b in zip(n, p)], "tp + tn + fp + fn")]
    o["classification_report"] = on_clean(SCORED + " " + " UNION ALL ".join(
        f"SELECT {lit(label)} AS \"Class\", {rnd(v[0], 6)} AS \"Precision\", {rnd(v[1], 6)} AS "
        f"\"Recall\", {rnd(v[2], 6)} AS \"F1\", {support} AS \"Support\" FROM cm"
        for label, v, support in rows))
    return o
