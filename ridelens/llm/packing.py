"""Pack token pieces into windows by minimum bin slack.

Only the count of pieces per length matters for the choice of windows, and lengths
end at the window size. So Spark counts pieces per length, a plan of bounded size is
made from that table (at most ``window`` lengths, whatever the corpus), and Spark
hands each piece its place in the plan.

A plan step takes the longest length left and fills the rest of the window with the
multiset of other lengths that comes closest to it: a subset-sum over a bit set, one
bit per reachable fill, walked back to counts per length. The multiset is applied as
often as the counts allow, so a step stands for many equal windows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ridelens.llm.tables import stored, table
from ridelens.llm.word_tokens import CACHED_BYTES, encoder

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Rows that one task orders to number the pieces of one length.
RUN_ROWS = 1000
#: Characters of text that one call of the encoder holds.
TEXT_AT_ONCE = 1_000_000


class Place(NamedTuple):
    """Pieces of ``length`` numbered ``first`` to ``until`` go, ``each`` to a sequence,
    from ``at`` on, to the sequences from ``sequence`` on."""

    length: int
    first: int
    until: int
    each: int
    at: int
    sequence: int


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths that fills ``capacity`` best without passing it.

    ``counts`` says how many pieces of each length there are. Longer lengths are
    offered first, and the search ends at an exact fill. Empty if nothing fits.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and 0 < n <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + take
            fill -= length * take
    return chosen


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with counts, number of equal windows) until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = closest_fill(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        plan.append((chosen, times))
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[Place]:
    used: dict[int, int] = {}
    out, sequence = [], 0
    for chosen, times in plan:
        at = 0
        for length in sorted(chosen, reverse=True):
            first, each = used.get(length, 0), chosen[length]
            out.append(Place(length, first, first + each * times, each, at, sequence))
            used[length] = first + each * times
            at += each * length
        sequence += times
    return out


def token_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
    cached_bytes: int = CACHED_BYTES,
) -> DataFrame:
    """Token ids of each document, cut into pieces of at most ``window``.

    A document is its ids and then ``end_id``; null and empty text give ``end_id``
    alone. Only the last piece of a document can be shorter than the window.
    ``with_ids`` adds the ids themselves as an array; ``cached_bytes`` bounds the words that
    a Python worker remembers, more of them cost memory and spare time. The ids column keeps its type
    and may be null or repeated; other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
    if with_ids:
        schema.add("ids", T.ArrayType(T.LongType()))
    end, step = np.array([end_id], "<u4").tobytes(), window * 4

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, cached_bytes).encode_all
        for batch in batches:
            names = batch.column("id")
            texts, at = batch.column("text"), 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and size < TEXT_AT_ONCE:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                rows, start, length, crc, total, ids = [], [], [], [], [], []
                for row, raw in enumerate(encode(some), at):
                    raw += end
                    for cut in range(0, len(raw), step):
                        piece = raw[cut : cut + step]
                        rows.append(row)
                        start.append(cut // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(raw) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
                columns = [names.take(pa.array(rows, pa.int64())), start, length, crc, total]
                columns += [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) if isinstance(c, list) else c for c in columns],
                    names=schema.names,
                )
                at += len(some)

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(tokenise, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and more) with ``sequence_id`` and ``offset``.

    Each piece of 1 to ``window`` tokens gets a place; offsets are gapless from 0 in
    each sequence, sequence ids gapless from 0 over all. ``pieces`` is read twice and
    must give the same rows each time: pass a stored table. Empty in, empty out.
    """
    spark = pieces.sparkSession
    # At most `window` rows come to the driver.
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Runs per length, in a constant array: a rare length is one run. The crc spreads null ids.
    runs = [max(1, math.ceil(counts.get(n, 0) / RUN_ROWS)) for n in range(1, window + 1)]
    of_length = F.split(F.lit(",".join(map(str, runs))), ",").cast("array<bigint>")
    run = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(of_length, F.col("length").cast("int")))
    numbered = pieces.withColumn("_run", run)
    before = (
        numbered.groupBy("length", "_run")
        .agg(F.count("*").alias("_n"))
        .select(
            "length",
            "_run",
            (
                F.sum("_n").over(Window.partitionBy("length").orderBy("_run")) - F.col("_n")
            ).alias("_before"),
        )
    )
    order = Window.partitionBy("length", "_run").orderBy("doc_id", "start", "ids_crc32")
    numbered = numbered.withColumn("_row", F.row_number().over(order) - 1).join(
        before, ["length", "_run"]
    )
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_row"))
    plan = spark.createDataFrame(
        places(plan_windows(counts, window)),
        "length long, first long, until long, each long, at long, sequence long",
    ).withColumnRenamed("length", "_length")
    number = F.col("_number")
    since = number - F.col("first")
    # The plan's size is bounded by the window size, not by the corpus.
    return numbered.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & (number >= F.col("first")) & (number < F.col("until")),
    ).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(since / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + since % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used) of pieces packed with their ids; padded to ``window``,
    except where the used length is a power of two."""
    joined = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),  # one window
        F.sum("length").alias("used"),
    )
    ids = F.flatten(F.col("parts.ids"))
    power = F.expr("bit_count(used) = 1")
    pad = F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(window) - F.col("used")).cast("int"))
    return joined.select(
        "sequence_id", F.when(power, ids).otherwise(F.concat(ids, pad)).alias("ids"), "used"
    )


def pack_documents(
    docs: DataFrame, window: int = WINDOW, cached_bytes: int = CACHED_BYTES
) -> DataFrame:
    """All documents as packed pieces: tokens first, written to the shared folder, then places."""
    pieces = token_pieces(docs, window=window, cached_bytes=cached_bytes)
    return pack(stored(pieces, "pieces"), window)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; no other stage's workers share the memory, so more words are remembered."""
    return pack_documents(table(spark, sf_dir, "documents"), cached_bytes=256 << 20)
