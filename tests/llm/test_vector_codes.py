import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import vector_codes as V


def by_brute_force(rows, parts=4, entries=256, rounds=4):
    """Plain k-means over Python's whole numbers: (vec_id, label, code, error) and entries."""
    kept = [
        (i, label, [math.floor(1024 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for j, xs in members.items():
                books[p][j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, [j for _, j in found], sum(d for d, _ in found)))
    return out, books


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit(c) for c in ("code", "error", "kind", "part", "x", "of")}).repartition(3)
    codes, books, work = V.encode_vectors(df, **options)
    return [tuple(r) for r in codes.collect()], books, work


def same(spark, rows, **options):
    codes, books, work = got(spark, rows, **options)
    want, entries = by_brute_force(rows, options.get("parts", 4), options.get("entries", 256), options.get("rounds", 4))
    assert sorted(codes, key=str) == sorted(want, key=str)
    assert books.last.tolist() == (entries or [[]] * options.get("parts", 4))
    return work


def some_rows(n=400, width=8, seed=1, coarse=4):
    random = np.random.default_rng(seed)
    middles = random.integers(-3, 3, (12, width))
    picked = middles[random.integers(0, 12, n)] + random.integers(-2, 3, (n, width)) / coarse
    return [(i, [float(x) for x in v], i % 3 or None) for i, v in enumerate(picked)]


@pytest.mark.parametrize(("entries", "group"), [(256, 16), (20, 4), (33, 16), (5, 1)])
def test_against_plain_k_means(spark, entries, group):
    work = same(spark, some_rows(), entries=entries, group=group)
    assert all(w <= work[0] + 400 * 4 * entries for w in work)


def test_bounds_spare_distances_and_change_nothing(spark):
    work = same(spark, some_rows(600, 16, coarse=16), entries=64, group=4)
    assert work[0] == 600 * 4 * 64
    assert work[-1] < work[0] * 0.8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5] * 8, 1), (None, [1.0] * 8, 2), (3, None, 1), (4, [nan] + [0.0] * 7, 1), (6, [inf] * 8, None),
        (7, [None] * 8, 1), (5, [0.25] * 8, 1), (5, [0.5] * 8, 1), (9, [-0.0001] * 8, None), (1, [1000.5, -1000.5] * 4, None),
    ]
    same(spark, rows, entries=3, group=2)
    same(spark, rows)


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 4), 0.0, 0.0, float(i % 2)], 0) for i in range(40)]
    same(spark, rows, entries=8, group=2)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * (2.0**17 + i), 3.0 * i, 0.5, -2.0**16], 0) for i in range(50)]
    same(spark, rows, entries=8, group=4)
    with pytest.raises(ValueError, match="too large"):
        got(spark, [(1, [3e38] * 4, 0)])


def test_lengths(spark):
    with pytest.raises(ValueError, match="length"):
        got(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)])
    with pytest.raises(ValueError, match="length"):
        got(spark, [(1, [1.0] * 6, 0)])
    same(spark, [(1, None, 0)])
    same(spark, [])


def test_query_by_brute_force_and_sql(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = by_brute_force(rows)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((i, "".join(f"{j:02x}" for j in code), e, by_label[label], digest) for i, label, code, e in want)
    assert sorted(map(tuple, V.op11_vector_codes(spark, sf_dir).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.execute(V.OP11_SQL).fetchall()) == want
