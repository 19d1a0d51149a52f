"""Product-quantised vector codes, trained by exact k-means with norm-of-sum bounds.

Vectors become whole numbers and are cut into equal parts, each with a codebook of its
own. A row keeps, per part, its entry and for each group of entries a lower bound on the
distance to the group's others, stamped with the round in which it was found. The
codebooks of all rounds are kept, so a bound of round s is loosened in round t by how far
the group's entries really are from where they were in round s: the norm of the sum of
their moves, which is at most the sum of the norms. Only groups whose bound
does not exceed the exact distance to the row's own entry are computed again.

Each round is one pass over the stored rows that writes the new rows and, per task, sums
and counts per entry; Spark adds these up. Codebooks are bounded by their parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.tables import new_folder, stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries that share a lower bound.
GROUP = 16
#: Whole numbers of this size or more are refused.
MOST = 1 << 28
#: Up to this size squared distances of parts of 16 are exact in doubles.
_EXACT = 1 << 22
#: Bounds are lowered and compared with this much room for rounding.
_ROOM = 1e-6


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector): components floor(scale * x) as longs, without the rows
    whose vector is null or has a null or non-finite component."""
    x = F.col("x").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = rows["label"] if "label" in rows.columns else F.lit(None).cast("int")
    slim = rows.select(rows[id_col].alias("vec_id"), label.alias("label"), rows[vector_col].alias("x"))
    # A null vector has no verdict and goes as well.
    return slim.filter(~bad).select(
        "vec_id", "label", F.transform(x, lambda v: F.floor(v * scale)).alias("vector")
    )


@dataclass(frozen=True)
class Codebooks:
    """Whole-number entries, one array (rounds, parts, entries, width) of all rounds so far."""

    history: np.ndarray

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def displacement(self, group: int) -> np.ndarray:
        """(rounds, parts, groups): how far a group's farthest entry is now from where it
        was in each round."""
        moved = (self.history[-1] - self.history).astype(np.float64)
        far = np.sqrt((moved**2).sum(axis=3))
        groups = -(-far.shape[2] // group)
        padded = np.zeros((*far.shape[:2], groups * group))
        padded[:, :, : far.shape[2]] = far
        return padded.reshape(*far.shape[:2], groups, group).max(axis=3)

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries replaced by floor(sum / count); entries without parts stay."""
        used = counts > 0
        entries = self.last.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Codebooks(np.concatenate([self.history, entries[None]]))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.last.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to entries, as longs."""
    largest = max(abs(x).max(initial=0), abs(entries).max(initial=0))
    kind = np.float64 if largest <= _EXACT and x.shape[1] <= 16 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return out.astype(np.int64)


def assign_part(
    x: np.ndarray,
    entries: np.ndarray,
    moved: np.ndarray,
    now: int,
    code: np.ndarray | None,
    bound: np.ndarray,
    stamp: np.ndarray,
    group: int = GROUP,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry per row (ties to the lower index), its exact squared distance, the
    groups' bounds and stamps, and the number of distances computed.

    ``bound[i, g]`` in round ``stamp[i, g]`` is no more than row i's distance to any entry
    of group g but its own; ``moved[s, g]`` is the group's displacement since round s.
    Without ``code`` every group is computed.
    """
    rows, groups = len(x), bound.shape[1]
    every, computed = np.arange(rows), 0
    old = np.zeros(rows, np.int64) if code is None else code
    own = ((x - entries[old]) ** 2).sum(1)
    root = np.sqrt(own.astype(np.float64))
    loose = bound.astype(np.float64) - moved[stamp, np.arange(groups)]
    scan = np.ones((rows, groups), bool) if code is None else loose <= root[:, None] * (1 + _ROOM) + _ROOM
    # The best two of a group, as distance and index, of which one may be the row's own.
    first_d = np.full((rows, groups), np.iinfo(np.int64).max)
    second_d, first_j = first_d.copy(), np.zeros((rows, groups), np.int64)
    best_d, best_j = own.copy(), old.copy()
    for g in range(groups):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        low = g * group
        d = distances(x[at], entries[low : low + group])
        computed += d.size
        j = d.argmin(1)  # the first of equals
        lines = np.arange(len(at))
        first_d[at, g], first_j[at, g] = d[lines, j], j + low
        if d.shape[1] > 1:
            d[lines, j] = np.iinfo(np.int64).max
            second_d[at, g] = d.min(1)
        better = (first_d[at, g] < best_d[at]) | ((first_d[at, g] == best_d[at]) & (first_j[at, g] < best_j[at]))
        to = at[better]
        best_d[to], best_j[to] = first_d[to, g], first_j[to, g]
    # Scanned groups: the nearest that is not the row's own, exact in this round.
    nearest = np.where(first_j == best_j[:, None], second_d, first_d)
    fresh = np.sqrt(nearest.astype(np.float64)) * (1 - _ROOM) - _ROOM
    new_bound = np.where(scan, fresh, bound)
    new_stamp = np.where(scan, now, stamp)
    # The entry that a row has left is now one of the others of its group.
    home = old // group
    left = (best_j != old) & ~scan[every, home]
    back = np.minimum(loose[every, home], root) * (1 - _ROOM) - _ROOM
    new_bound[every[left], home[left]] = back[left]
    new_stamp[every[left], home[left]] = now
    return best_j, best_d, new_bound.astype(np.float32), new_stamp.astype(np.int16), computed


_STATE = pa.schema(
    [
        ("kind", pa.string()),
        ("vec_id", pa.int64()),
        ("label", pa.int64()),
        ("vector", pa.list_(pa.int64())),
        ("code", pa.list_(pa.int32())),
        ("bound", pa.list_(pa.float32())),
        ("stamp", pa.list_(pa.int16())),
        ("error", pa.int64()),
        ("part", pa.int32()),
        ("entry", pa.int32()),
        ("n", pa.int64()),
        ("sums", pa.list_(pa.int64())),
    ]
)
_SPARK_STATE = (
    "kind string, vec_id long, label long, vector array<long>, code array<int>, bound array<float>, "
    "stamp array<smallint>, error long, part int, entry int, n long, sums array<long>"
)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).ravel(), kind))


def _matrix(column: pa.Array, rows: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


def _padded(columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns.get(f.name, pa.nulls(rows, f.type)) for f in _STATE], schema=_STATE
    )


def next_round(state: DataFrame, books: Codebooks, group: int = GROUP) -> DataFrame:
    """One pass over ``state``: its rows with new codes (kind ``row``), sums and counts per
    part and entry of each task (kind ``sum``), and its number of computed distances
    (kind ``work``). Rows without codes are computed in full."""
    parts, entries, width = books.last.shape
    now, groups = len(books.history) - 1, -(-entries // group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, last = books.displacement(group), books.last
        sums = np.zeros((parts, entries, width), object)  # whole numbers of any size
        counts, work = np.zeros((parts, entries), np.int64), 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column("vector"), rows, parts * width).reshape(rows, parts, width)
            started = batch.column("code").null_count == 0
            code = _matrix(batch.column("code"), rows, parts).astype(np.int64) if started else None
            shape = (rows, parts, groups)
            bound = _matrix(batch.column("bound"), rows, parts * groups).reshape(shape) if started else np.zeros(shape, np.float32)
            stamp = _matrix(batch.column("stamp"), rows, parts * groups).reshape(shape) if started else np.zeros(shape, np.int16)
            found = [
                assign_part(
                    x[:, p], last[p], moved[:, p], now, None if code is None else code[:, p], bound[:, p], stamp[:, p], group
                )
                for p in range(parts)
            ]
            for p, (best, *_, computed) in enumerate(found):
                work += computed
                counts[p] += np.bincount(best, minlength=entries)
                added = np.zeros((entries, width), np.int64)
                np.add.at(added, best, x[:, p])  # below 2**63: a batch has few rows
                sums[p] += added
            yield _padded(
                {
                    "kind": pa.array(["row"] * rows),
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "vector": batch.column("vector"),
                    "code": _lists(np.stack([f[0] for f in found], 1), pa.int32()),
                    "bound": _lists(np.stack([f[2] for f in found], 1).reshape(rows, -1), pa.float32()),
                    "stamp": _lists(np.stack([f[3] for f in found], 1).reshape(rows, -1), pa.int16()),
                    "error": pa.array(sum(f[1] for f in found), pa.int64()),
                },
                rows,
            )
        part, entry = np.nonzero(counts)
        if len(part):
            yield _padded(
                {
                    "kind": pa.array(["sum"] * len(part)),
                    "part": pa.array(part, pa.int32()),
                    "entry": pa.array(entry, pa.int32()),
                    "n": pa.array(counts[part, entry]),
                    "sums": pa.array([[int(v) for v in sums[p, e]] for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64())),
                },
                len(part),
            )
            yield _padded({"kind": pa.array(["work"]), "n": pa.array([work], pa.int64())}, 1)

    return state.mapInArrow(run, _SPARK_STATE)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Stored with a folder per kind of row, so that each reader opens only its own."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(_SPARK_STATE).parquet(path)


def _totals(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts per entry over all tasks; ``parts * entries`` rows at most."""
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = state.filter("kind = 'sum'").groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()
    sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object)
    for r in rows:
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = [int(r[f"s{i}"]) for i in range(width)]
    return sums, counts


def _first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return Codebooks(np.zeros((1, parts, 0, 0), np.int64))
    all_parts = np.array([r["vector"] for r in rows], np.int64).reshape(len(rows), parts, -1)
    return Codebooks(all_parts.transpose(1, 0, 2)[None])


def _checked(vectors: DataFrame, parts: int) -> None:
    sizes = F.size("vector")
    large = F.max(F.array_max(F.transform("vector", F.abs)))
    low, high, most = vectors.agg(F.min(sizes), F.max(sizes), large).first()
    if low != high or (low or 0) % parts:
        raise ValueError(f"vectors need one length that {parts} divides, not {low} to {high}")
    if (most or 0) >= MOST or (low or 0) * (2 * (most or 0)) ** 2 >= 2**63:
        raise ValueError(f"components are too large for exact distances: {most}")


def encode_vectors(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    group: int = GROUP,
) -> tuple[DataFrame, Codebooks, list[int]]:
    """(vec_id, label, code, error) per kept row, the codebooks of all rounds, and the
    distances computed in each pass.

    Rows whose vector is null or holds null or non-finite components are dropped. All
    others need one length that ``parts`` divides, and components within 2**28 after
    scaling; else this raises. The codebooks start with the ``entries`` smallest ids (a
    missing id is the largest; rows that share an id in order of their vectors), fewer if
    there are fewer rows. Equal vectors have equal codes; ties go to the lower index.
    ``label`` is null where the table has none, other columns are not read. Empty in,
    empty out. Each pass is written to the shared folder.
    """
    vectors = stored(whole_vectors(rows, id_col, vector_col, scale), "vectors")
    _checked(vectors, parts)
    books = _first_codebooks(vectors, parts, entries)
    blank = {f.name: F.lit(None) for f in _STATE if f.name not in vectors.columns}
    kinds = dict(f.strip().rsplit(" ", 1) for f in _SPARK_STATE.split(", "))
    state = vectors.withColumns(blank).select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds])
    work, shape = [], books.last.shape
    for number in range(rounds + 1):
        state = _written(next_round(state.filter("kind is null or kind = 'row'"), books, group), f"codes-{number}")
        work.append(state.filter("kind = 'work'").agg(F.sum("n")).first()[0] or 0)
        if number < rounds:
            books = books.after(*_totals(state, *shape))
    return state.filter("kind = 'row'").select("vec_id", "label", "code", "error"), books, work


def hex_code(code: Column) -> Column:
    """Two hex digits for each index, in part order."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings. The errors per label are added up first and
    stored, so their size is known when they are joined back."""
    codes, books, _ = encode_vectors(table(spark, sf_dir, "embeddings"))
    errors = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    errors = errors.withColumnRenamed("label", "of")
    return codes.join(errors, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id",
        hex_code(F.col("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


def _sql(width: int = 16) -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"near{i} AS MATERIALIZED (SELECT vec_id, label, part, v, xx, (m // {ENTRIES})::BIGINT AS error, "
            f"(m % {ENTRIES})::BIGINT AS entry FROM (SELECT x.vec_id, x.label, x.part, x.v, x.xx, "
            f"min((x.xx - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v))::HUGEINT * {ENTRIES} + b.entry) AS m "
            f"FROM parts x JOIN book{i} b USING (part) GROUP BY ALL))"
        )
        if i < ROUNDS:
            means = ", ".join(f"floor(sum(v[{k}]) / count(*))" for k in range(1, width + 1))
            steps.append(
                f"book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM book{i} b "
                f"LEFT JOIN (SELECT part, entry, [{means}] AS v FROM near{i} GROUP BY part, entry) n USING (part, entry))"
            )
    last = ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, w AS v, list_dot_product(w, w) AS xx
  FROM (SELECT vec_id, label, part, v[part * {width} + 1:(part + 1) * {width}] AS w
        FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS part))
), book0 AS MATERIALIZED (
  SELECT part, entry, v FROM (
    SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts)
  WHERE entry < {ENTRIES}
), {", ".join(steps)}, codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM near{last} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry))
   FROM book{last}) AS codebooks_sha256
FROM codes
"""  # noqa: S608


OP11_SQL = _sql()
