"""A bookings table derived from order, line, party and place tables.

One booking per order line. The text columns carry the dirt a raw export has:
padding, quotes, "no value" spellings, bad dates and out-of-range numbers, plus
exact copies of some rows. No join is hinted: the optimizer broadcasts a side
only while its size is under the broadcast threshold, and adaptive execution
splits skewed partitions of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens import schema as S

# A unique key of one line; kept beside the 21 bookings columns.
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# Reason texts in the order the remainder selects them.
CUSTOMER_REASONS = [
    "Wrong Address",
    "Change of plans",
    "Driver is not moving towards pickup location",
    "Driver asked to cancel",
    "AC is not working",
]
DRIVER_REASONS = [
    "Customer related issue",
    "The customer was coughing/sick",
    "Personal & Car related issues",
    "More than permitted people in there",
]
INCOMPLETE_REASONS = ["Customer Demand", "Vehicle Breakdown", "Other Issue"]
PAYMENT_METHODS = ["UPI", "Cash", "Wallet", "Credit Card", "Debit Card"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def _tenths(n: Column) -> Column:
    """A count of tenths as text: 123 gives ``12.3``."""
    n = n.cast("bigint")
    return F.concat_ws(".", F.floor(n / 10).cast("string"), (n % 10).cast("string"))


def bookings_text(spark: SparkSession, sf_dir: str, by_key: int = 0) -> DataFrame:
    """The 21 text columns as a raw export would spell them, plus ``ROW_KEY``.

    ``by_key`` brings rows of one key together while they are narrow, so that a removal of
    equal rows needs no shuffle of the wide ones. It is the number of partitions: a task
    compares its wide rows in memory, and left to itself the engine makes tasks by the
    bytes of the narrow rows.
    """
    line = _table(spark, sf_dir, "lineitem").select(*ROW_KEY, "l_quantity", "l_discount")
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    nation = _table(spark, sf_dir, "nation")
    customer = _table(spark, sf_dir, "customer").join(
        nation.select("n_nationkey", F.col("n_name").alias("pickup")),
        F.col("c_nationkey") == F.col("n_nationkey"),
    ).select("c_custkey", "pickup")
    supplier = _table(spark, sf_dir, "supplier").join(
        nation.select("n_nationkey", F.col("n_name").alias("drop_at")),
        F.col("s_nationkey") == F.col("n_nationkey"),
    ).select("s_suppkey", "drop_at")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type")

    # Customers meet the orders, not the lines, of which there are several times as many.
    ordered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    joined = (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .drop("s_suppkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .drop("p_partkey")
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .drop("o_orderkey")
    )
    if by_key:
        # Whole numbers only: 0.0 and -0.0 are equal prices of different hashes.
        joined = joined.repartition(by_key, *ROW_KEY[:4])
    ok, ln, pk, sk = (F.col(c) for c in ROW_KEY[:4])
    keyed = joined.withColumns(
        {
            "h": (ok * 31 + ln * 17 + pk * 7 + sk * 13) % 100,
            "sec": (ok * 7919 + pk * 104729 + sk * 1299709) % 86400,
            "m": ok + pk * 3 + sk,
        }
    ).withColumn(
        "status",
        F.when(F.col("h") < 62, S.COMPLETED)
        .when(F.col("h") < 80, S.CANCELLED_BY_DRIVER)
        .when(F.col("h") < 87, S.CANCELLED_BY_CUSTOMER)
        .when(F.col("h") < 94, S.NO_DRIVER_FOUND)
        .otherwise(S.INCOMPLETE),
    )
    h_status, m, sec = F.col("status"), F.col("m"), F.col("sec")
    # Columns of their own, because many use them: spelled out in each, the generated method
    # for a row passes 8,000 bytes of code, which the JVM does not compile.
    keyed = keyed.withColumns(
        {
            "missing": F.when(m % 3 == 1, "null").when(m % 3 == 2, "NaN"),
            "trip": h_status.isin(S.COMPLETED, S.INCOMPLETE),
            "done": h_status == S.COMPLETED,
            "by_customer": h_status == S.CANCELLED_BY_CUSTOMER,
            "by_driver": h_status == S.CANCELLED_BY_DRIVER,
            "incomplete": h_status == S.INCOMPLETE,
        }
    )
    missing, trip, done = F.col("missing"), F.col("trip"), F.col("done")

    def present(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(missing)

    def two(n: Column) -> Column:
        return F.lpad(F.floor(n).cast("string"), 2, "0")

    by_customer, by_driver, incomplete = F.col("by_customer"), F.col("by_driver"), F.col("incomplete")
    text = {
        "Date": F.when(m % 997 == 0, "not-a-date").otherwise(
            F.to_date("o_orderdate").cast("string")
        ),
        "Time": F.concat_ws(":", two(sec / 3600), two(sec % 3600 / 60), two(sec % 60)),
        "Booking ID": F.concat(F.lit('"CNR'), ok.cast("string"), F.lit('"')),
        "Booking Status": F.when(m % 10 == 3, F.concat(F.lit("  "), h_status, F.lit(" ")))
        .when(m % 10 == 7, F.replace(h_status, F.lit(" "), F.lit("  ")))
        .otherwise(h_status),
        "Customer ID": F.concat(F.lit('"CID'), F.col("o_custkey").cast("string"), F.lit('"')),
        "Vehicle Type": F.col("p_type"),
        "Pickup Location": F.col("pickup"),
        "Drop Location": F.col("drop_at"),
        "Avg VTAT": present(
            h_status != S.NO_DRIVER_FOUND,
            F.when(m % 1031 == 0, "abc").otherwise(_tenths(m % 181 + 20)),
        ),
        "Avg CTAT": present(trip, _tenths(m % 351 + 100)),
        "Cancelled Rides by Customer": present(
            by_customer, F.when(m % 211 == 0, "2").otherwise("1.0")
        ),
        "Reason for cancelling by Customer": present(by_customer, _pick(m % 5, CUSTOMER_REASONS)),
        "Cancelled Rides by Driver": present(by_driver, F.lit("1.0")),
        "Driver Cancellation Reason": present(by_driver, _pick(m % 4, DRIVER_REASONS)),
        "Incomplete Rides": present(incomplete, F.lit("1.0")),
        "Incomplete Rides Reason": present(incomplete, _pick(m % 3, INCOMPLETE_REASONS)),
        "Booking Value": present(
            trip,
            F.concat(
                F.when(m % 1009 == 0, "-").otherwise(""),
                F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
            ),
        ),
        "Ride Distance": present(
            trip,
            F.when(m % 1013 == 0, "0.0").otherwise(
                F.concat_ws(
                    ".", F.col("l_quantity").cast("int").cast("string"), (m % 10).cast("string")
                )
            ),
        ),
        "Driver Ratings": present(
            done,
            F.when(m % 1019 == 0, "7.5").otherwise(
                _tenths(F.rint(F.col("l_discount") * 100) * 2 + 30)
            ),
        ),
        "Customer Rating": present(done, _tenths(m % 21 + 30)),
        "Payment Method": present(
            trip, _pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, PAYMENT_METHODS)
        ),
    }
    rows = keyed.select(*ROW_KEY, *[text[c].alias(c) for c in S.RAW_COLUMNS])
    # Two copies of the marked rows from one pass over the joins.
    copies = F.when(ok % 500 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).drop("copy")
