"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.tables import stored


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step: each node hands its neighbours (the larger ones in a large star, the
    smaller ones and itself in a small star) to the least node that it knows."""
    near = links.select("u", "v") if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("x"), "m").unionByName(
            least.select(F.col("u").alias("x"), "m")
        )
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("x"), F.least("u", "m").alias("m")
        )
    out = moved.filter(F.col("x") != F.col("m"))
    return out.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node that each linked node reaches. ``links`` has u and v.

    Rows (u, v) point from the larger to the smaller node. A node with many links is
    handled by joins on counted minima, never gathered. Ends when a step changes nothing;
    each pair of steps is written to the shared folder.
    """
    ordered = links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter(F.col("u") != F.col("v"))
    now, seen = stored(ordered.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("class"))
        seen = state
        now = stored(_stars(_stars(now, small=False), small=True), "links")
