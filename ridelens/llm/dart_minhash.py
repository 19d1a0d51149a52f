"""Near-duplicates by DartMinHash signatures and banding.

Every element of a document has a plane of random darts, the same in all documents:
one side is a weight, the other a rank. A document's darts are those of its elements
with a weight coordinate up to the element's weight. Each dart belongs to one of ``k``
coordinates, and per coordinate the dart of the lowest rank is the signature. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Only the part of the plane that is needed is thrown: regions double in
rank until every coordinate has a dart, so a signature costs about ``k log k`` darts,
however long the document is.

Signatures are cut into bands; documents that share a band are candidates, and each
candidate pair is decided by its exact similarity. A bucket is not paired out. Its
members are compared with one pivot first, the member that shares most buckets with
others. Afterwards only members of different classes can still be unlinked, and of
those only pairs pass whose odd sketches allow the similarity: the sketches' differing
bits never outnumber the differing shingles, so no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.components import components
from ridelens.llm.shingles import WORDS, mixed, shingles_of_words, word_hashes
from ridelens.llm.tables import stored, table

SIMILARITY = 0.8
BANDS, ROWS = 28, 5
#: Longs in an odd sketch, of 64 bits each.
SKETCH = 32
_FIRST_RANK = 0.25
_MOST_PER_REGION = 32.0
_DARTS_AT_ONCE = 500_000
_TEXTS_AT_ONCE = 500


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2 ... darts in a region of area ``mean``."""
    n = np.arange(1, int(mean + 12 * mean**0.5) + 20)
    return np.cumsum(np.exp(-mean) * np.concatenate([[1.0], np.cumprod(mean / n)]))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(
    table_: np.ndarray,
    k: int,
    elements: np.ndarray,
    weights: np.ndarray,
    owners: np.ndarray,
    ring: int,
) -> None:
    """Throw the darts of one doubling of the rank and keep the lowest ranks in ``table_``."""
    low, high = (0.0, _FIRST_RANK) if ring == 0 else (_FIRST_RANK * 2 ** (ring - 1), _FIRST_RANK * 2**ring)
    heaviest = weights.max(initial=0.0)
    layer = 0
    while True:
        floor, top = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0**layer)
        if floor >= heaviest:
            return
        here = np.flatnonzero(weights > floor)
        pieces = int(np.ceil((high - low) * (top - floor) / _MOST_PER_REGION))
        width = (high - low) / pieces
        chances = _poisson(width * (top - floor))
        for piece in range(pieces):
            place = np.uint64(((ring * 64 + layer) * 1_000_003 + piece) * 0x9E3779B97F4A7C15 % 2**64)
            drawn = mixed(elements[here] + place)
            count = np.searchsorted(chances, _unit(drawn), side="right")
            some = np.flatnonzero(count)
            n = count[some]
            base = np.repeat(drawn[some], n)
            turn = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
            dart = mixed(base + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            rank = low + width * (piece + _unit(mixed(dart + np.uint64(1))))
            at = np.repeat(here[some], n)
            if layer or heaviest < 1 or weights[here].min() < top:
                inside = floor + (top - floor) * _unit(mixed(dart + np.uint64(2))) < weights[at]
                dart, rank, at = dart[inside], rank[inside], at[inside]
            coordinate = (mixed(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(table_, owners[at] * k + coordinate, rank)
        layer += 1


def signatures(
    documents: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS
) -> np.ndarray:
    """A row of ``k`` lowest ranks per document of (elements, weights); the rank stands for
    its dart. Documents without weight have infinite ranks."""
    sizes = [len(e) for e, _ in documents]
    out = np.full(len(documents) * k, np.inf)
    if not sum(sizes):
        return out.reshape(len(documents), k)
    elements = np.concatenate([e for e, _ in documents])
    weights = np.concatenate([w for _, w in documents]).astype(np.float64)
    owners = np.repeat(np.arange(len(documents)), sizes)
    total = np.bincount(owners, weights, len(documents))
    wanted = k * (np.log(k) + 1) / np.maximum(total, 1e-12)
    rings = np.maximum(0, np.ceil(np.log2(wanted / _FIRST_RANK))).astype(np.int64)
    ring, open_ = 0, total > 0
    while open_.any():
        at = np.flatnonzero(open_[owners])
        _throw(out, k, elements[at], weights[at], owners[at], ring)
        full = np.isfinite(out.reshape(-1, k)).all(axis=1)
        open_ &= ~(full & (ring >= rings))
        ring += 1
    return out.reshape(len(documents), k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of hashed bands per signature, as signed longs."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def weighted_shingles(
    text: str | None, words: int = WORDS, weights: str = "set"
) -> tuple[np.ndarray, np.ndarray]:
    """(different shingle hashes, sorted; weights): each 1, or how often it occurs."""
    found, counts = np.unique(shingles_of_words(word_hashes(text), words), return_counts=True)
    return found, (np.ones(len(found)) if weights == "set" else counts.astype(np.float64))


def expanded(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set whose Jaccard similarities are those of the whole-numbered weights: an
    element of weight n becomes n elements."""
    if not len(found) or weights.max() <= 1:
        return found
    n = weights.astype(np.int64)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    several = mixed(np.repeat(found, n) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(np.where(turn == 0, np.repeat(found, n), several))


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs; bit i tells whether the number of elements in block i is odd."""
    block = (mixed(elements) >> np.uint64(48)).astype(np.int64) % (SKETCH * 64)
    odd = (np.bincount(block, minlength=SKETCH * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signed(docs: DataFrame, *, words: int = WORDS, weights: str = "set") -> DataFrame:
    """(id, digest, bands) of ``docs`` (id, text). Equal digests are equal weighted shingles;
    a text without words has a digest of its own spelling and no bands."""
    kind = docs.schema["id"].dataType
    fields = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("digest", T.StringType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column("id"), batch.column("text"), 0
            while at < len(ids):
                held, digests, to, size = [], [], at, 0
                while to < len(ids) and size < _DARTS_AT_ONCE:
                    text = texts[to].as_py() or ""
                    found = weighted_shingles(text, words, weights)
                    raw = found[0].tobytes() + found[1].tobytes() if len(found[0]) else b"text " + text.encode()
                    digests.append(xxhash.xxh3_128_hexdigest(raw))
                    held.append(found)
                    size += len(found[0]) + 1500
                    to += 1
                keys = band_keys(signatures(held))
                bands = [k.tolist() if len(e) else None for k, (e, _) in zip(keys, held, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(digests), pa.array(bands, pa.list_(pa.int64()))],
                    names=fields.names,
                )
                at = to

    return docs.mapInArrow(sign, fields)


def _prepared(docs: DataFrame, words: int, weights: str) -> DataFrame:
    """(id, n, sketch, elements) of ``docs`` (id, text): what comparisons need."""
    fields = T.StructType(
        [
            docs.schema["id"],
            T.StructField("n", T.LongType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
            T.StructField("elements", T.ArrayType(T.LongType())),
        ]
    )

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                sets = [
                    expanded(*weighted_shingles(t.as_py(), words, weights)) for t in part.column("text")
                ]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([odd_sketch(x) for x in sets], longs),
                        pa.array([x.view(np.int64) for x in sets], longs),
                    ],
                    names=fields.names,
                )

    return docs.select("id", "text").mapInArrow(prepare, fields)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose elements are at least ``least`` similar."""
    fields = T.StructType([pairs.schema["u"], pairs.schema["v"]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], []
            for name in ("a", "b"):
                lists = batch.column(name)
                held.append((lists.values.to_numpy(), lists.offsets.to_numpy()))
            (a, a_at), (b, b_at) = held
            for i in range(len(batch)):
                x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            rows = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    of_v = sets.select(F.col("id").alias("v"), F.col("elements").alias("b"))
    of_u = sets.select(F.col("id").alias("u"), F.col("elements").alias("a"))
    both = pairs.join(of_v, "v").join(of_u, "u")
    return both.select("u", "v", "a", "b").mapInArrow(compare, fields)


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot; (u, v) with u the pivot."""
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    pivots = members.join(weight, "id").groupBy("key").agg(
        F.max(F.struct("weight", F.xxhash64("id").alias("h"), F.col("id").alias("u"))).alias("p")
    )
    joined = members.join(pivots.select("key", "p.u"), "key").filter(F.col("u") != F.col("id"))
    return joined.select("u", F.col("id").alias("v")).distinct()


def _open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members in different classes that may still be similar enough.

    Members outside the bucket's largest class meet all members, so the members of that
    class, however many, never meet each other.
    """
    rows = members.filter("n > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("class", "id").alias("class")
    )
    several = (
        rows.groupBy("key", "class")
        .agg(F.count("*").alias("members"))
        .groupBy("key")
        .agg(F.count("*").alias("classes"), F.max(F.struct("members", "class"))["class"].alias("largest"))
        .filter("classes > 1")
        .select("key", "largest")
    )
    mine = rows.join(several, "key").join(sets.select("id", F.col("n").alias("size"), "sketch"), "id")
    other = mine.filter(F.col("class") != F.col("largest")).select(
        F.col("key").alias("k"),
        F.col("id").alias("u"),
        F.col("class").alias("of"),
        F.col("size").alias("u_size"),
        F.col("sketch").alias("u_sketch"),
    )
    differ = sum(
        (F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("u_sketch")[i])) for i in range(SKETCH)),
        F.lit(0),
    )
    # Similar enough means at most this many elements in just one of the two.
    most = (F.col("size") + F.col("u_size")) * ((1 - least) / (1 + least)) + 1e-6
    joined = mine.join(
        other,
        (F.col("key") == F.col("k"))
        & (F.col("class") != F.col("of"))
        & ((F.col("class") == F.col("largest")) | (F.col("u") < F.col("id")))
        & (F.abs(F.col("size") - F.col("u_size")) <= most)
        & (differ <= most),
    )
    return joined.select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = SIMILARITY,
    weights: str = "set",
) -> DataFrame:
    """doc_id, class_id, class_size and kept for every row.

    Two documents are linked if the Jaccard similarity of their shingles of ``words``
    words is at least ``least``; with ``weights="count"`` shingles weigh as often as they
    occur. Classes are connected components, named by their smallest id, which is the
    one kept. Texts shorter than ``words`` words are one shingle; null counts as empty;
    texts without words are near only to texts of the same spelling. A null id is in no
    class and is kept. Rows that repeat an id are one document, linked by what any of
    them is near to. Other columns are not read. Empty in, empty out.

    ``BANDS`` and ``ROWS`` find a pair at 0.8 with a chance of 99.998 %, and with more
    above it.
    """
    slim = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
    table_ = stored(signed(slim.filter("id IS NOT NULL"), words=words, weights=weights), "signed")
    leads = table_.groupBy("digest").agg(F.min("id").alias("lead"))
    led = table_.select("id", "digest").join(leads, "digest").select("id", "lead")
    # Documents of one shingle set are one node: its smallest id.
    nodes = table_.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))
    keys = nodes.select("id", F.explode("bands").alias("key")).distinct()
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keys.join(counts, "key"), "members")
    wanted = members.select("id").distinct()
    sets = stored(_prepared(slim.join(wanted, "id", "left_semi"), words, weights), "sets")

    repeats = led.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    same = led.filter("id != lead").join(repeats, "id").select(F.col("lead").alias("u"), F.col("id").alias("v"))
    labels = components(_verified(_first_pairs(members), sets, least).unionByName(same))
    links = stored(_verified(_open_pairs(members, labels, sets, least), sets, least), "links")
    if not links.isEmpty():
        old = labels.select(F.col("node").alias("u"), F.col("class").alias("v"))
        labels = components(links.unionByName(old))

    classes = led.join(labels.withColumnRenamed("node", "lead"), "lead", "left").select(
        "id", F.coalesce("class", "lead").alias("class_id")
    )
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("class_size")).filter("class_size > 1")
    known = classes.join(sizes, "class_id", "left").select(
        F.col("id").alias("doc_id"),
        "class_id",
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (F.col("id") == F.col("class_id")).alias("kept"),
    )
    nameless = slim.filter("id IS NULL").select(
        F.col("id").alias("doc_id"),
        F.col("id").alias("class_id"),
        F.lit(1).cast("bigint").alias("class_size"),
        F.lit(True).alias("kept"),
    )
    return known.unionByName(nameless)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each class, with all their columns.

    If ids repeat, an id's different texts are nodes of their own, so only the near copy
    goes, and rows equal in id and text are one. Null ids all stay.
    """
    ids = docs.filter(docs[id_col].isNotNull()).groupBy(docs[id_col].alias("id"))
    if ids.agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        lost = near_duplicates(docs, id_col=id_col, text_col=text_col).filter(~F.col("kept"))
        lost = lost.select(F.col("doc_id").alias("_lost"))
        return docs.join(lost, docs[id_col] == lost["_lost"], "left_anti")
    name = "_node"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    node = F.struct(docs[id_col].alias("id"), F.sha2(text, 256).alias("digest"))
    rows = docs.withColumn(name, F.when(docs[id_col].isNotNull(), node))
    lost = near_duplicates(rows, id_col=name, text_col=text_col).filter(~F.col("kept"))
    lost = lost.select(F.col("doc_id").alias("_lost")).distinct()
    left = stored(rows.join(lost, rows[name] == lost["_lost"], "left_anti"), "left")
    # Repeated rows are combined in each task first; the other columns decide between them.
    whole = F.struct(*[left[c] for c in docs.columns])
    one = left.filter(left[name].isNotNull()).groupBy(name).agg(F.max_by(whole, F.to_json(whole)).alias("_row"))
    return left.filter(left[name].isNull()).select(*docs.columns).unionByName(one.select("_row.*"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
