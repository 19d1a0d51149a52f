"""Small helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.plans.layers import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one all executors share; nothing is created yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/ridelens-llm/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage like a checkpoint, survives lost executors, and keeps column
    pruning for the readers.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(column: Column, by: int) -> Column:
    """crc32 of the value's text, modulo ``by``: a fold that any engine can recompute."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(by))


def held_out(column: Column) -> Column:
    """Rows kept out of every training: crc32(id as text) mod 4 is 2. A missing id is held out."""
    return F.coalesce(crc32_mod(column, 4) == 2, F.lit(True))


def literal_table(
    spark: SparkSession, rows: list[tuple[int | float | None, ...]], schema: str
) -> DataFrame:
    """A table of literal numbers; only for rows of a proven bound."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    columns = [F.col(name).cast(kind).alias(name) for name, kind in fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in fields])
    spelled = ", ".join(
        "(" + ", ".join("NULL" if v is None else f"{v!r}" for v in row) + ")" for row in rows
    )
    names = ", ".join(f"`{name}`" for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {spelled} AS t({names})").select(*columns)  # noqa: S608


def sortable(number: Column) -> Column:
    """A long as sixteen characters that sort like the long."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def count_at_most(value: Column, splitters: list[str]) -> Column:
    """How many of the sorted ``splitters`` (without commas) are at or below ``value``.

    Looked up in two steps, among every so-many-th of them and then between two of
    those; the splitters are one constant of the expression.
    """
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    parts = [splitters[i : i + step] for i in range(0, len(splitters), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= value))

    coarse = below(F.split(F.lit(",".join(p[0] for p in parts)), ","))
    inner = F.split(F.lit(";".join(",".join(p) for p in parts)), ";")
    inside = below(F.split(F.element_at(inner, F.greatest(coarse, F.lit(1))), ","))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inside).cast("int")
