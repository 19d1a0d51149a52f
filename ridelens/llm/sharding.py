"""Shards of near equal bytes from sampled splitters, with DataFrame operations only.

Records are ordered by a hash of their text, so equal texts are neighbours. A sample
weighted by size gives quantile boundaries; records fall into the ranges between them,
exact sizes per range are counted, and ranges that hold too much are sampled again and
subdivided. A group of equal texts larger than a hundredth of a shard leaves this order:
it has ranges of its own, ordered by id, so a group of any size is spread over tasks.

Large groups go first, each whole if it fits a shard and range by range if not, to the
emptiest shard. The others fill the shards to one level in their order. Running totals
are taken within ranges and over the bounded list of ranges, never over all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridelens.llm.tables import count_at_most, literal_table, sortable, stored, table

SHARDS = 16
#: Fewest ranges that the boundaries make; a range is subdivided beyond twice the mean.
RANGES = 256
#: Rows a range has on average, once there are more than ``RANGES`` times as many.
RANGE_ROWS = 4_000_000
#: Samples per wanted range.
SAMPLES = 32
#: A group of equal texts counts as large from this part of a shard on.
LARGE = 0.01


def _position() -> Column:
    """Order of records: small groups by text hash, then large groups by hash and id."""
    large = F.concat(F.lit("1"), sortable(F.col("_key")), sortable(F.col("_id")))
    return F.when(F.col("_big"), large).otherwise(
        F.concat(F.lit("0"), sortable(F.col("_key")), F.lit("0" * 16))
    )


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[str]:
    """Boundaries so that no range holds over twice the mean beside its largest record.

    Each round brings at most about ``ranges`` boundaries to the driver. A round whose
    samples show no new boundary cuts each overfull range before its last position, so
    every round divides something and the promise holds when they end.
    """
    mean, found, turn = max(1, total / ranges), [], 0  # the turn draws another sample
    while True:
        ranged = rows.withColumn("_range", count_at_most(F.col("_at"), found))
        sizes = ranged.groupBy("_range").agg(
            (F.sum("size") - F.max("size")).alias("bytes"),
            F.min("_at").alias("low"),
            F.max("_at").alias("high"),
        )
        last = {r["_range"]: r.high for r in sizes.collect() if r.low != r.high and r.bytes > 2 * mean}
        if not last:
            return found
        weight = F.greatest(F.col("size").cast("double"), F.lit(mean / SAMPLES))
        point = F.shiftrightunsigned(F.xxhash64("_id", "_key", F.lit(turn)), 11) / F.lit(2.0**53)
        of_range = Window.partitionBy("_range").orderBy("_at")
        drawn = (
            ranged.filter(F.col("_range").isin(list(last)))
            .filter(point < F.col("size") * SAMPLES / mean)
            .withColumn("_cut", F.floor((F.sum(weight).over(of_range) - weight) / mean))
        )
        cuts = drawn.groupBy("_range", "_cut").agg(F.min("_at").alias("at")).collect()
        new = {c["at"] for c in cuts} - set(found)
        turn += 1
        found = sorted(set(found) | (new or set(last.values())))


def _levels(loads: list[int], fill: int) -> list[int]:
    """Bytes each shard takes so that ``fill`` more bytes leave the shards level."""
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    take, left = [0] * len(loads), fill
    for n in range(1, len(order) + 1):
        gap = loads[order[n]] - loads[order[n - 1]] if n < len(order) else left
        step = min(gap, left // n) if n < len(order) else left // n
        for s in order[:n]:
            take[s] += step
        left -= step * n
    for s in order[:left]:
        take[s] += 1
    return take


def _placement(
    segments: list, shards: int, target: float
) -> tuple[list[tuple[int, int, int, int | None]], list[int]]:
    """(range, group, bytes before, shard) per segment, and the running room of the shards.

    A segment is the part of a range in one large group, or outside all of them.
    """
    whole: dict[int, int] = {}
    for r in segments:
        if r.big:
            whole[r.group] = whole.get(r.group, 0) + r.bytes
    units: dict[tuple, int] = {}
    for r in segments:
        if r.big:
            unit = (r.group,) if whole[r.group] <= target else (r.group, r.range)
            units[unit] = units.get(unit, 0) + r.bytes
    loads, shard_of = [0] * shards, {}
    for unit, size in sorted(units.items(), key=lambda u: (-u[1], u[0])):
        shard_of[unit] = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard_of[unit]] += size
    rows, before = [], 0
    for r in sorted(segments, key=lambda r: (r.big, r.range, r.group)):
        if r.big:
            shard = shard_of.get((r.group,), shard_of.get((r.group, r.range)))
            rows.append((r.range, r.group, 0, shard))
        else:
            rows.append((r.range, r.group, before, None))
            before += r.bytes
    room, running = [], 0
    for take in _levels(loads, before):
        running += take
        room.append(running)
    return rows, room


def assign_shards(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = RANGES,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row.

    Size is the text's UTF-8 bytes plus 1; a null text has none. The law is ``bytes``:
    shards differ by little more than their largest document or group. Equal texts
    share a shard unless all of them together are more than an even shard. Slots are
    gapless from 0 in each shard. ``grown_shard`` is null under this law. A null id
    counts as the smallest id; rows that repeat id and text each get a slot. Other
    columns are not read. Empty in, empty out.

    There are about ``ranges`` ranges, or as many more as it takes for ``range_rows`` rows
    each, so that no task orders more with the corpus. What reaches the driver is that many
    boundaries and range sizes, and at most ``shards / LARGE`` large groups.
    """
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    slim = stored(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"),
            F.coalesce(docs[id_col].cast("bigint"), F.lit(-(2**63))).alias("_id"),
        ),
        "sizes",
    )
    n_rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(ranges, n_rows // range_rows)
    target = total / shards
    large = (
        slim.groupBy("_key")
        .agg(F.sum("size").alias("_bytes"))
        .filter(F.col("_bytes") >= max(2, target * LARGE))
        .select("_key", F.lit(True).alias("_large"))
    )
    # At most shards / LARGE groups can be that large.
    rows = stored(
        slim.join(F.broadcast(large), "_key", "left")
        .withColumn("_big", F.coalesce("_large", F.lit(False)))
        .drop("_large")
        .withColumn("_at", _position()),
        "grouped",
    )
    group = F.when(F.col("_big"), F.col("_key")).otherwise(0)
    ranged = rows.withColumn("_range", count_at_most(F.col("_at"), _splitters(rows, total, ranges)))
    ranged = ranged.withColumn("_group", group)
    segments = (
        ranged.groupBy("_big", "_range", "_group")
        .agg(F.sum("size").alias("bytes"))
        .select(F.col("_big").alias("big"), F.col("_range").alias("range"), F.col("_group").alias("group"), "bytes")
        .collect()
    )
    placed, room = _placement(segments, shards, target)
    numbered = [(i, *row) for i, row in enumerate(placed)]
    plan = literal_table(
        spark, numbered, "_segment int, _range int, _group bigint, _before bigint, _to int"
    )
    of_segment = Window.partitionBy("_segment")
    peers = of_segment.orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("size").over(peers)
    ends = F.array(*[F.lit(x).cast("bigint") for x in room])
    by_room = F.least(F.size(F.filter(ends, lambda end: end < F.col("_upto"))), F.lit(shards - 1))
    sharded = (
        ranged.join(F.broadcast(plan), ["_range", "_group"])
        .withColumn("_upto", upto)
        .withColumn("shard", F.coalesce("_to", by_room).cast("int"))
    )
    counts = sharded.groupBy("_segment", "shard").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn(
        "_first",
        F.sum("_n").over(Window.partitionBy("shard").orderBy("_segment")) - F.col("_n"),
    ).drop("_n")
    in_shard = Window.partitionBy("_segment", "shard").orderBy("_key", "_id", "text_crc32")
    # One row per segment and shard: bounded like the segments.
    return (
        sharded.withColumn("_row", F.row_number().over(in_shard) - 1)
        .join(F.broadcast(offsets), ["_segment", "shard"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_first") + F.col("_row")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
