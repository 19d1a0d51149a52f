"""Small table shapes: fixed rows, one-row frames side by side, long forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table, of the size of the literal, made without Python rows."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    entries = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def over_array(
    df: DataFrame,
    columns: Sequence[str],
    change: Callable[[Column], Column],
    distinct: bool = False,
    drop: Sequence[str] = (),
) -> DataFrame:
    """The text columns as ``change`` makes them from their array, as one expression.

    An expression per column puts them all into one generated method, and a method above
    8,000 bytes of code is never compiled by the JVM: every row would be interpreted.

    ``distinct`` leaves one of each set of equal rows, compared while the texts are still
    one array: copied as a whole, which is cheaper than column by column. ``drop`` names
    columns that only ``change`` reads; they are not compared.
    """
    rest = [c for c in df.columns if c not in drop]
    if not columns:
        kept = df.select(*rest)
        return kept.dropDuplicates() if distinct else kept
    place = {c: i for i, c in enumerate(columns)}
    changed = df.select(
        *[c for c in rest if c not in place],
        change(F.array(*[F.col(c) for c in columns])).alias("_changed"),
    )
    if distinct:
        changed = changed.dropDuplicates()
    return changed.select(
        *[F.col("_changed")[place[c]].alias(c) if c in place else F.col(c) for c in rest]
    )


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row.

    The frames are stacked and the single value of each column is kept; no join.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])


def long_rows(
    df: DataFrame, key: str, rows: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]
) -> DataFrame:
    """A one-row frame as one row per entry: ``key`` and the entry's values."""
    entries = [
        F.struct(F.lit(label).alias(key), *[v.alias(n) for v, n in zip(values, names)])
        for label, values in rows
    ]
    return df.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def share(part: Column, frame: DataFrame, measure: str) -> Column:
    """``part`` as a percentage of the total of ``measure`` over ``frame``.

    The total is a scalar subquery, so the rows need not meet in one partition.
    """
    total = frame.agg(F.sum(measure).alias("total")).scalar()
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """An array of (path, value) with every single value inside ``value``, as text."""
    nothing = F.expr("cast(array() as array<struct<path:string,value:string>>)")
    if isinstance(kind, T.StructType):
        parts = [
            _leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind
        ]
        return F.concat(nothing, *parts)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(
            value,
            lambda x, i: _leaves(
                x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            ),
        )
        return F.coalesce(F.flatten(inner), nothing)
    if isinstance(kind, T.MapType):
        inner = F.transform(
            F.map_entries(value),
            lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"])),
        )
        return F.coalesce(F.flatten(inner), nothing)
    number = isinstance(kind, T.NumericType)
    text = (value.cast("decimal(28,6)") if number else value).cast("string")
    return F.array(F.struct(path.alias("path"), text.alias("value")))


def flattened(document: DataFrame) -> DataFrame:
    """(path, value) for every single value of a small nested document, in its order.

    Paths are names joined by dots, with ``[position]`` in arrays and keys in maps;
    numbers have six decimals.
    """
    parts = [_leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in document.schema]
    return document.select(F.explode(F.concat(*parts)).alias("leaf")).select("leaf.*")
