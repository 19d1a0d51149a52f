"""Readers of bookings files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens import schema as S
from ridelens.functions import numbers, text
from ridelens.functions.tables import over_array


def normalise_missing(df: DataFrame) -> DataFrame:
    """NULL for every spelling of "no value" in the text columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def known(row: Column) -> Column:
        return F.transform(row, lambda value: text.missing_to_null(value))

    return over_array(df, names, known)


def read_raw_bookings(
    spark: SparkSession, path: str, extra_columns: Sequence[T.StructField] = ()
) -> DataFrame:
    """Bookings CSV with a header, every column as text.

    No schema inference: it would read the file twice and turn times into
    timestamps. ``extra_columns`` follow the 21 in the file. Ids written as
    ``\"\"\"CNR1\"\"\"`` come out with one pair of quotes, as cleaning expects.
    """
    schema = T.StructType(S.RAW_SCHEMA.fields + list(extra_columns))
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return normalise_missing(rows)


def read_clean_bookings(
    spark: SparkSession, path: str, extra_columns: Sequence[T.StructField] = ()
) -> DataFrame:
    """The cleaned table from Parquet, with the fixed types."""
    schema = T.StructType(S.CLEAN_SCHEMA.fields + list(extra_columns))
    return spark.read.schema(schema).parquet(path)


def read_clean_bookings_csv(
    spark: SparkSession, path: str, extra_columns: Sequence[T.StructField] = ()
) -> DataFrame:
    """The cleaned table from CSV: read as text, then repaired to the fixed types.

    A value that does not parse becomes NULL.
    """
    fields = S.CLEAN_SCHEMA.fields + list(extra_columns)
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    rows = normalise_missing(
        spark.read.schema(as_text)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    typed = []
    for f in fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            col = numbers.to_double(col)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            col = numbers.to_double(col).cast(f.dataType)
        elif not isinstance(f.dataType, T.StringType):
            col = col.try_cast(f.dataType)
        typed.append(col.alias(f.name))
    return rows.select(*typed)


def _readable(df: DataFrame) -> bool:
    """Whether the files can be parsed at all; a report is small."""
    try:
        df.isEmpty()
    except PySparkException:
        return False
    return True


def read_optional_report(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """A CSV or JSON report; no rows if the path is absent or holds no such report.

    JSON may be indented. A document that is not JSON, or an empty file, gives no rows.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown report format: {fmt}")
    absent = spark.createDataFrame([], schema)
    try:
        if fmt == "csv":
            found = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
        else:
            reader = spark.read.schema(schema).option("multiLine", True)
            found = reader.option("mode", "DROPMALFORMED").json(path)
        return found if _readable(found) else absent
    except AnalysisException:  # no such path
        return absent
