"""Column names, types and fixed domain values of the bookings tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The bookings data model. They must equal the published data
# set for results to agree, so they are stated plainly here.
# ---------------------------------------------------------------------------

RAW_COLUMNS = [
    "Date",
    "Time",
    "Booking ID",
    "Booking Status",
    "Customer ID",
    "Vehicle Type",
    "Pickup Location",
    "Drop Location",
    "Avg VTAT",
    "Avg CTAT",
    "Cancelled Rides by Customer",
    "Reason for cancelling by Customer",
    "Cancelled Rides by Driver",
    "Driver Cancellation Reason",
    "Incomplete Rides",
    "Incomplete Rides Reason",
    "Booking Value",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
    "Payment Method",
]

NON_NEGATIVE_COLUMNS = ["Avg VTAT", "Avg CTAT", "Booking Value", "Ride Distance"]
RATING_COLUMNS = ["Driver Ratings", "Customer Rating"]
INDICATOR_COLUMNS = [
    "Cancelled Rides by Customer",
    "Cancelled Rides by Driver",
    "Incomplete Rides",
]
NUMERIC_COLUMNS = [
    "Avg VTAT",
    "Avg CTAT",
    "Cancelled Rides by Customer",
    "Cancelled Rides by Driver",
    "Incomplete Rides",
    "Booking Value",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
]
TEXT_COLUMNS = [c for c in RAW_COLUMNS if c not in NUMERIC_COLUMNS]
ID_COLUMNS = ["Booking ID", "Customer ID"]

# Columns whose gaps depend on the booking status.
STATUS_DEPENDENT_COLUMNS = [
    "Avg VTAT",
    "Avg CTAT",
    "Cancelled Rides by Customer",
    "Reason for cancelling by Customer",
    "Cancelled Rides by Driver",
    "Driver Cancellation Reason",
    "Incomplete Rides",
    "Incomplete Rides Reason",
    "Booking Value",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
    "Payment Method",
]

COMPLETED = "Completed"
CANCELLED_BY_CUSTOMER = "Cancelled by Customer"
CANCELLED_BY_DRIVER = "Cancelled by Driver"
NO_DRIVER_FOUND = "No Driver Found"
INCOMPLETE = "Incomplete"

# status -> Booking_Outcome label; anything else is "Other"
OUTCOME_LABELS = {
    COMPLETED: "Completed",
    CANCELLED_BY_CUSTOMER: "Customer Cancelled",
    CANCELLED_BY_DRIVER: "Driver Cancelled",
    NO_DRIVER_FOUND: "No Driver Found",
    INCOMPLETE: "Incomplete",
}

AVAILABILITY_FLAGS = {
    "Booking Value": "Has_Booking_Value",
    "Ride Distance": "Has_Ride_Distance",
    "Driver Ratings": "Has_Driver_Rating",
    "Customer Rating": "Has_Customer_Rating",
    "Payment Method": "Has_Payment_Method",
    "Avg VTAT": "Has_VTAT",
    "Avg CTAT": "Has_CTAT",
}

# (last hour of the period, label), in order; later hours take the default
TIME_PERIODS = [(5, "Night"), (11, "Morning"), (16, "Afternoon"), (20, "Evening")]
TIME_PERIOD_DEFAULT = "Late Evening"
# the alternative scheme: hours before 5 are night as well
TIME_PERIODS_ALT = [(4, "Night"), (11, "Morning"), (16, "Afternoon"), (21, "Evening")]
TIME_PERIOD_ALT_DEFAULT = "Night"
TIME_PERIOD_ALT_MISSING = "Unknown"

WEEKDAYS = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]

MONTHS = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]

# (upper bound of the right-closed interval, label); the first also takes 0
DISTANCE_BUCKETS = [
    (5.0, "0-5 km"),
    (10.0, "5-10 km"),
    (20.0, "10-20 km"),
    (30.0, "20-30 km"),
    (40.0, "30-40 km"),
    (50.0, "40-50 km"),
    (float("inf"), "50+ km"),
]

CORRELATION_COLUMNS = [
    "Avg VTAT",
    "Avg CTAT",
    "Booking Value",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
    "Revenue",
    "Fare_Per_KM",
    "Hour",
    "Is_Completed",
    "Is_Cancelled",
]
CORRELATION_COLUMNS_SHORT = [
    "Avg VTAT",
    "Avg CTAT",
    "Booking Value",
    "Ride Distance",
    "Driver Ratings",
    "Customer Rating",
    "Hour",
    "Is_Completed",
]

# Spellings a delimited file uses for "no value".
MISSING_TOKENS = [
    "",
    "null",
    "NULL",
    "NaN",
    "nan",
    "NA",
    "N/A",
    "n/a",
    "<NA>",
    "None",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
]

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

_DERIVED_TYPES = {
    "DateTime": T.TimestampNTZType(),
    "Year": T.IntegerType(),
    "Month": T.IntegerType(),
    "Month_Name": T.StringType(),
    "Day": T.IntegerType(),
    "Day_of_Week": T.IntegerType(),
    "Day_Name": T.StringType(),
    "Hour": T.IntegerType(),
    "Is_Weekend": T.IntegerType(),
    "Time_Period": T.StringType(),
    "Is_Completed": T.IntegerType(),
    "Is_Cancelled": T.IntegerType(),
    "Is_Incomplete": T.IntegerType(),
    "Is_No_Driver_Found": T.IntegerType(),
    "Booking_Outcome": T.StringType(),
    "Revenue": T.DoubleType(),
    "Fare_Per_KM": T.DoubleType(),
} | {flag: T.IntegerType() for flag in AVAILABILITY_FLAGS.values()}

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c in NUMERIC_COLUMNS else T.StringType())
        for c in RAW_COLUMNS
    ]
    + [T.StructField(c, t) for c, t in _DERIVED_TYPES.items()]
)
CLEAN_COLUMNS = CLEAN_SCHEMA.fieldNames()
