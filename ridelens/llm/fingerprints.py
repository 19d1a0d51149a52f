"""Bottom-k fingerprints: the smallest hashes of a document's shingles.

A fingerprint of a union comes from the fingerprints of its parts, so they merge across
parts of a corpus. From two of them follow resemblance and containment, from one the
number of different shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.shingles import WORDS, mixed, shingles_of_words, word_hashes
from ridelens.llm.tables import count_at_most, sortable, table

K = 256
_BYTES = 6
_SPAN = 2.0 ** (8 * _BYTES)
SALTS = 64
_ROWS_AT_ONCE = 500
#: Most text that one run of documents has, as far as the approximate quantiles go and
#: while there are no more than ``MOST_RUNS`` runs. A run is streamed, so a longer one
#: costs no memory, only a longer task.
RUN_BYTES = 1 << 28
MOST_RUNS = 16_384
#: Characters in a shingle of a text that has too few words.
CHARACTERS = 5
_CHARACTER_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def text_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the different shingles of a text, sorted.

    Shingles are runs of ``words`` words. A text with fewer, such as one of signs or one
    written without spaces, has runs of ``CHARACTERS`` characters instead, lower-cased and
    with white space as one blank; a text shorter than that is one shingle, one of white
    space only and an empty one have none.
    """
    hashes = word_hashes(text)
    if len(hashes) >= words:
        return np.unique(shingles_of_words(hashes, words))
    plain = " ".join((text or "").lower().split())
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.unique(shingles_of_words(mixed(points + _CHARACTER_SEED), CHARACTERS))


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The ``k`` smallest different 48-bit hashes of ``text_shingles``, sorted."""
    hashes = text_shingles(text, words)  # sorted, so the upper bits are sorted too
    upper = hashes[: k + 8] >> np.uint64(64 - 8 * _BYTES)
    return np.unique(upper)[:k]


def spelled(values: np.ndarray) -> str:
    """Base64 of the hashes, six big-endian bytes each."""
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - _BYTES :] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def merged(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    if not sketches:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate(sketches))[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Number of different shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPAN / float(a[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty documents, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged([a, b], k)
    if len(a) >= k or len(b) >= k:  # beyond the last hash of a full one nothing is known
        last = min(x[-1] for x in (a, b) if len(x) >= k)
        union = union[union <= last]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, shared, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if ``a`` is empty."""
    if not len(a):
        return 1.0
    union = distinct_count(merged([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / max(distinct_count(a, k), 1.0))


def merge_by(documents: DataFrame, by: str, *, text_col: str = "text", k: int = K) -> DataFrame:
    """(``by``, fingerprint, distinct_shingles) of all documents of each value of ``by``.

    Tasks merge what they read first; then salted parts merge, then the parts' results,
    so a hot value is never one task's work. Null is a value of its own.
    """
    kind = documents.schema[by].dataType
    part = T.StructType(
        [T.StructField(by, kind), T.StructField("_salt", T.IntegerType()), T.StructField("_f", T.StringType())]
    )
    out = T.StructType(
        [T.StructField(by, kind), T.StructField("fingerprint", T.StringType()), T.StructField("distinct_shingles", T.DoubleType())]
    )

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % SALTS
        for frame in frames:
            rows = [
                (value, salt, spelled(merged([sketch(t, k) for t in group["_text"]], k)))
                for value, group in frame.groupby("_by", dropna=False)
            ]
            result = pd.DataFrame(rows, columns=part.names)
            result[by] = result[by].astype(object).where(result[by].notna(), None)
            yield result

    def together(group: pd.DataFrame) -> str:
        return spelled(merged([parsed(f) for f in group["_f"]], k))

    def salted(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: group[by][:1], "_salt": group["_salt"][:1], "_f": [together(group)]})

    def final(group: pd.DataFrame) -> pd.DataFrame:
        f = together(group)
        return pd.DataFrame(
            {by: group[by][:1], "fingerprint": [f], "distinct_shingles": [distinct_count(parsed(f), k)]}
        )

    slim = documents.select(documents[by].alias("_by"), documents[text_col].cast("string").alias("_text"))
    return (
        slim.mapInPandas(local, part)
        .groupBy(by, "_salt")
        .applyInPandas(salted, part)
        .groupBy(by)
        .applyInPandas(final, out)
    )


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _fields(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )


def _measured(text: str, own: np.ndarray, following: str, after: np.ndarray, k: int) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else sketch(changed, k)
    return (
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        spelled(own),
        spelled(other),
        resemblance(own, other, k),
        resemblance(own, after, k),
    )


def fingerprint_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K
) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other.

    The next document follows in ascending id (the first after the last; a single one
    follows itself); a null id comes first, rows that repeat an id follow each other in
    the order of their text's hash. A null text is empty; two texts without any sign but
    white space have likeness 1. Texts of fewer than five words are compared by their
    characters. Other columns are not read. Empty in, empty out.

    Texts move once, into runs of ascending ids; the first document of each run also
    goes to the end of the run before it, so every run is measured by itself. The
    boundaries between runs are approximate quantiles of the ids; ``runs`` is the
    session's number of shuffle partitions, or more so that a run has at most
    ``RUN_BYTES``, up to ``MOST_RUNS``: so many ids reach the driver at most.
    """
    kind = docs.schema[id_col].dataType
    fields = _fields(kind)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    values = [kinds.get(f.dataType.typeName(), pa.string()) for f in fields.fields[1:]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The document that waits for the next one: run, id, text, sketch.
        waiting, ids, rows, like = None, [], [], None

        def full() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, like), *(pa.array(c, v) for c, v in zip(columns, values, strict=True))],
                names=fields.names,
            )

        for batch in batches:
            like = batch.schema.field("id").type
            columns = [batch.column(c) for c in ("run", "ahead", "id", "text")]
            for run, ahead, name, text in zip(*columns, strict=True):
                run, ahead = run.as_py(), ahead.as_py()
                if ahead and waiting is None:  # a second row with the id of the next run's first
                    continue
                text = text.as_py()
                own = sketch(text, k)
                if waiting is not None:
                    ids.append(waiting[1])
                    rows.append(_measured(waiting[2], waiting[3], text, own, k))
                waiting = None if ahead else (run, name.as_py(), text, own)
                if len(rows) >= _ROWS_AT_ONCE:
                    yield full()
                    ids, rows = [], []
        if rows:
            yield full()

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(
        docs[id_col].alias("id"),
        text.alias("text"),
        sortable(F.coalesce(docs[id_col].cast("bigint"), F.lit(-(2**63)))).alias("key"),
    )
    starts = _run_starts(docs, docs[id_col], text)
    runs = len(starts)
    run = count_at_most(F.col("key"), starts) - 1
    here = F.struct(run.alias("run"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(run - 1, F.lit(max(1, runs))).alias("run"), F.lit(True).alias("ahead"))
    first = F.col("key") == F.element_at(F.split(F.lit(",".join(starts)), ","), run + 1)
    placed = keyed.withColumn("to", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))))
    ordered = (
        placed.select(F.col("to.run").alias("run"), F.col("to.ahead").alias("ahead"), "id", "text", "key")
        .repartitionByRange(max(1, runs), "run")
        .sortWithinPartitions("run", "ahead", "key", F.xxhash64("text"))
        .select("run", "ahead", "id", "text")
    )
    return ordered.mapInArrow(measure, fields)


def _run_starts(docs: DataFrame, doc_id: Column, text: Column) -> list[str]:
    """The smallest key of each run of ascending ids, sorted; some ids that are there."""
    key = F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))
    rows, size, least = docs.agg(F.count("*"), F.sum(F.octet_length(text)), F.min(key)).first()
    if not rows:
        return []
    least_runs = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = max(least_runs, min(MOST_RUNS, size // RUN_BYTES))
    shares = [i / runs for i in range(1, runs)]
    cuts = docs.agg(F.percentile_approx(key, shares, 20 * runs)).first()[0] if shares else []
    return [_sortable_number(x) for x in sorted({least, *(cuts or [])})]


def _sortable_number(x: int) -> str:
    """What ``tables.sortable`` makes of the number."""
    return f"{(x + 2**63) % 2**64:016X}"


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
