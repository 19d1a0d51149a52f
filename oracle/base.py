"""The bookings tables as SQL common table expressions.

Written apart from the DataFrame code so that the two check each other.
"""

from __future__ import annotations

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

TEXT = [
    "Date", "Time", "Booking ID", "Booking Status", "Customer ID", "Vehicle Type",
    "Pickup Location", "Drop Location", "Reason for cancelling by Customer",
    "Driver Cancellation Reason", "Incomplete Rides Reason", "Payment Method",
]
NUMBERS = [
    "Avg VTAT", "Avg CTAT", "Cancelled Rides by Customer", "Cancelled Rides by Driver",
    "Incomplete Rides", "Booking Value", "Ride Distance", "Driver Ratings", "Customer Rating",
]
RAW = [
    "Date", "Time", "Booking ID", "Booking Status", "Customer ID", "Vehicle Type",
    "Pickup Location", "Drop Location", "Avg VTAT", "Avg CTAT", "Cancelled Rides by Customer",
    "Reason for cancelling by Customer", "Cancelled Rides by Driver", "Driver Cancellation Reason",
    "Incomplete Rides", "Incomplete Rides Reason", "Booking Value", "Ride Distance",
    "Driver Ratings", "Customer Rating", "Payment Method",
]


def q(name: str) -> str:
    return f'"{name}"'


def _tenths(n: str) -> str:
    return f"(cast(({n}) // 10 as varchar) || '.' || cast(({n}) % 10 as varchar))"


def _pick(index: str, labels: list[str]) -> str:
    branches = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {index} {branches} END"


_TRIP = "status IN ('Completed', 'Incomplete')"

_RAW_EXPR = {
    "Date": "CASE WHEN m % 997 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END",
    "Time": "lpad(cast(sec // 3600 as varchar), 2, '0') || ':' || "
            "lpad(cast(sec % 3600 // 60 as varchar), 2, '0') || ':' || "
            "lpad(cast(sec % 60 as varchar), 2, '0')",
    "Booking ID": "'\"CNR' || l_orderkey || '\"'",
    "Booking Status": "CASE m % 10 WHEN 3 THEN '  ' || status || ' ' "
                      "WHEN 7 THEN replace(status, ' ', '  ') ELSE status END",
    "Customer ID": "'\"CID' || o_custkey || '\"'",
    "Vehicle Type": "p_type",
    "Pickup Location": "pickup",
    "Drop Location": "drop_at",
    "Avg VTAT": "CASE WHEN status = 'No Driver Found' THEN NULL WHEN m % 1031 = 0 THEN 'abc' ELSE "
                + _tenths("20 + m % 181") + " END",
    "Avg CTAT": f"CASE WHEN {_TRIP} THEN " + _tenths("100 + m % 351") + " END",
    "Cancelled Rides by Customer": "CASE WHEN status = 'Cancelled by Customer' THEN "
                                   "CASE WHEN m % 211 = 0 THEN '2' ELSE '1.0' END END",
    "Reason for cancelling by Customer": "CASE WHEN status = 'Cancelled by Customer' THEN "
        + _pick("m % 5", ["Wrong Address", "Change of plans",
                          "Driver is not moving towards pickup location",
                          "Driver asked to cancel", "AC is not working"]) + " END",
    "Cancelled Rides by Driver": "CASE WHEN status = 'Cancelled by Driver' THEN '1.0' END",
    "Driver Cancellation Reason": "CASE WHEN status = 'Cancelled by Driver' THEN "
        + _pick("m % 4", ["Customer related issue", "The customer was coughing/sick",
                          "Personal & Car related issues",
                          "More than permitted people in there"]) + " END",
    "Incomplete Rides": "CASE WHEN status = 'Incomplete' THEN '1.0' END",
    "Incomplete Rides Reason": "CASE WHEN status = 'Incomplete' THEN "
        + _pick("m % 3", ["Customer Demand", "Vehicle Breakdown", "Other Issue"]) + " END",
    "Booking Value": f"CASE WHEN {_TRIP} THEN CASE WHEN m % 1009 = 0 THEN '-' ELSE '' END || "
                     "cast(cast(l_extendedprice as decimal(12,2)) as varchar) END",
    "Ride Distance": f"CASE WHEN {_TRIP} THEN CASE WHEN m % 1013 = 0 THEN '0.0' ELSE "
                     "cast(cast(l_quantity as int) as varchar) || '.' || (m % 10) END END",
    "Driver Ratings": "CASE WHEN status = 'Completed' THEN CASE WHEN m % 1019 = 0 THEN '7.5' ELSE "
                      + _tenths("30 + 2 * cast(round(l_discount * 100) as bigint)") + " END END",
    "Customer Rating": "CASE WHEN status = 'Completed' THEN " + _tenths("30 + m % 21") + " END",
    "Payment Method": f"CASE WHEN {_TRIP} THEN "
        + _pick("cast(substr(o_orderpriority, 1, 1) as int) - 1",
                ["UPI", "Cash", "Wallet", "Credit Card", "Debit Card"]) + " END",
}

_LINES = f"""
keyed AS (
  SELECT {KEY}, l_quantity, l_discount, o_custkey, o_orderdate, o_orderpriority, p_type,
         pn.n_name AS pickup, dn.n_name AS drop_at,
         (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey*13) % 100 AS h,
         (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709) % 86400 AS sec,
         l_orderkey + 3*l_partkey + l_suppkey AS m
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
  JOIN nation pn ON c_nationkey = pn.n_nationkey
  JOIN nation dn ON s_nationkey = dn.n_nationkey
),
lines AS (
  SELECT *, CASE WHEN h < 62 THEN 'Completed' WHEN h < 80 THEN 'Cancelled by Driver'
                 WHEN h < 87 THEN 'Cancelled by Customer' WHEN h < 94 THEN 'No Driver Found'
                 ELSE 'Incomplete' END AS status
  FROM keyed
),
raw_once AS (
  SELECT {KEY}, {", ".join(f"{e} AS {q(c)}" for c, e in _RAW_EXPR.items())}
  FROM lines
),
bookings_raw AS (
  SELECT * FROM raw_once UNION ALL SELECT * FROM raw_once WHERE l_orderkey % 500 = 0
)"""


def strip_sql(x: str) -> str:
    out = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    out = f"regexp_replace({out}, '^\"+|\"+$', '', 'g')"
    return f"regexp_replace({out}, '^''+|''+$', '', 'g')"


def clean_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(x)}, '\\s+', ' ', 'g')"


_AUDIT = f""",
audit AS (
  SELECT {KEY}, {", ".join(
    (f"{strip_sql(q(c))} AS {q(c)}" if c in TEXT else f"try_cast({q(c)} AS double) AS {q(c)}")
    for c in RAW)}
  FROM bookings_raw
)"""

_VALID = {
    "Avg VTAT": "{0} >= 0", "Avg CTAT": "{0} >= 0", "Booking Value": "{0} >= 0",
    "Ride Distance": "{0} >= 0", "Driver Ratings": "{0} BETWEEN 0 AND 5",
    "Customer Rating": "{0} BETWEEN 0 AND 5", "Cancelled Rides by Customer": "{0} IN (0, 1)",
    "Cancelled Rides by Driver": "{0} IN (0, 1)", "Incomplete Rides": "{0} IN (0, 1)",
}
_HAS = {
    "Booking Value": "Has_Booking_Value", "Ride Distance": "Has_Ride_Distance",
    "Driver Ratings": "Has_Driver_Rating", "Customer Rating": "Has_Customer_Rating",
    "Payment Method": "Has_Payment_Method", "Avg VTAT": "Has_VTAT", "Avg CTAT": "Has_CTAT",
}

_CALENDAR = """
    cast(year("DateTime") AS int) AS "Year", cast(month("DateTime") AS int) AS "Month",
    monthname("DateTime") AS "Month_Name", cast(day("DateTime") AS int) AS "Day",
    cast(isodow("DateTime") - 1 AS int) AS "Day_of_Week", dayname("DateTime") AS "Day_Name",
    cast(hour("DateTime") AS int) AS "Hour" """

_CLEAN = f""",
deduped AS (
  SELECT DISTINCT {KEY}, {", ".join(f"{clean_sql(q(c))} AS {q(c)}" for c in RAW)}
  FROM bookings_raw
),
coerced AS (
  SELECT {KEY}, {", ".join(
    (f"try_cast({q(c)} AS double) AS {q(c)}" if c in NUMBERS else q(c)) for c in RAW)}
  FROM deduped
),
valid AS (
  SELECT {KEY}, {", ".join(
    (f"CASE WHEN {_VALID[c].format(q(c))} THEN {q(c)} END AS {q(c)}" if c in NUMBERS else q(c))
    for c in RAW)}, try_cast("Date" || ' ' || "Time" AS timestamp) AS "DateTime"
  FROM coerced
),
dated AS (
  SELECT *, {_CALENDAR} FROM valid WHERE "DateTime" IS NOT NULL
),
flagged AS (
  SELECT *, cast("Day_of_Week" >= 5 AS int) AS "Is_Weekend",
    CASE WHEN "Hour" <= 5 THEN 'Night' WHEN "Hour" <= 11 THEN 'Morning'
         WHEN "Hour" <= 16 THEN 'Afternoon' WHEN "Hour" <= 20 THEN 'Evening'
         ELSE 'Late Evening' END AS "Time_Period",
    cast("Booking Status" = 'Completed' AS int) AS "Is_Completed",
    cast("Booking Status" ILIKE '%cancelled%' AS int) AS "Is_Cancelled",
    cast("Booking Status" = 'Incomplete' AS int) AS "Is_Incomplete",
    cast("Booking Status" = 'No Driver Found' AS int) AS "Is_No_Driver_Found",
    CASE "Booking Status" WHEN 'Completed' THEN 'Completed'
      WHEN 'Cancelled by Customer' THEN 'Customer Cancelled'
      WHEN 'Cancelled by Driver' THEN 'Driver Cancelled'
      WHEN 'No Driver Found' THEN 'No Driver Found'
      WHEN 'Incomplete' THEN 'Incomplete' ELSE 'Other' END AS "Booking_Outcome"
  FROM dated
),
clean AS (
  SELECT *,
    CASE WHEN "Is_Completed" = 1 THEN "Booking Value" ELSE 0 END AS "Revenue",
    CASE WHEN "Is_Completed" = 1 AND "Ride Distance" > 0
         THEN "Booking Value" / "Ride Distance" END AS "Fare_Per_KM",
    {", ".join(f"cast({q(c)} IS NOT NULL AS int) AS {q(f)}" for c, f in _HAS.items())}
  FROM flagged
)"""

_ALT = f""",
alt_dated AS (
  SELECT DISTINCT *, try_cast("Date" || ' ' || "Time" AS timestamp) AS "DateTime" FROM audit
),
alt_flagged AS (
  SELECT *, {_CALENDAR},
    coalesce(isodow("DateTime") >= 6, false) AS "Is_Weekend",
    CASE WHEN "DateTime" IS NULL THEN 'Unknown' WHEN hour("DateTime") BETWEEN 5 AND 11 THEN 'Morning'
         WHEN hour("DateTime") BETWEEN 12 AND 16 THEN 'Afternoon'
         WHEN hour("DateTime") BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END AS "Time_Period",
    cast("Booking Status" = 'Completed' AS int) AS "Is_Completed",
    cast("Booking Status" IN ('Cancelled by Driver', 'Cancelled by Customer') AS int)
      AS "Is_Cancelled",
    cast("Booking Status" = 'Incomplete' AS int) AS "Is_Incomplete",
    cast("Booking Status" = 'No Driver Found' AS int) AS "Is_No_Driver_Found",
    "Booking Status" AS "Booking_Outcome"
  FROM alt_dated
),
alt AS (
  SELECT *,
    CASE WHEN "Is_Completed" = 1 THEN coalesce("Booking Value", 0) ELSE 0 END AS "Revenue",
    CASE WHEN "Ride Distance" > 0 THEN "Booking Value" / "Ride Distance" END AS "Fare_Per_KM",
    {", ".join(f"cast({q(c)} IS NOT NULL AS int) AS {q('Has_' + c.replace(' ', '_'))}"
               for c in _HAS)}
  FROM alt_flagged
)"""


def on_raw(select: str) -> str:
    """A statement over ``bookings_raw``: raw text, one row per export line."""
    return f"WITH {_LINES}\n{select}"


def on_audit(select: str) -> str:
    """A statement over ``audit``: stripped text, numbers coerced, nothing dropped."""
    return f"WITH {_LINES}{_AUDIT}\n{select}"


def on_clean(select: str) -> str:
    """A statement over ``clean`` (and the steps before it)."""
    return f"WITH {_LINES}{_CLEAN}\n{select}"


def on_alt(select: str) -> str:
    """A statement over ``alt``: the alternative cleaning rules."""
    return f"WITH {_LINES}{_AUDIT}{_ALT}\n{select}"


def money(x: str) -> str:
    """Order-independent sum, 0 for none."""
    return f"coalesce(cast(sum(cast({x} AS decimal(28,6))) AS double), 0)"


def mean(x: str) -> str:
    return f"cast(sum(cast({x} AS decimal(28,6))) AS double) / nullif(count({x}), 0)"


def rnd(x: str, digits: int = 2) -> str:
    return f"cast(round(cast({x} AS decimal(38,10)), {digits}) AS double)"


def pct(part: str, whole: str) -> str:
    return f"(cast({part} AS double) / nullif({whole}, 0) * 100)"
