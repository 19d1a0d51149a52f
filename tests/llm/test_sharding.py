import zlib

import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from ridelens.llm import sharding
from ridelens.llm.sharding import assign_shards
from ridelens.llm.tables import table


def check(rows, shards):
    by_shard: dict[int, list] = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r.slot)
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))


def test_odd_rows(spark):
    rows = assign_shards(odd_documents(spark)).collect()
    check(rows, 16)
    want = [
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows()
    ]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("shards", [1, 5])
def test_near_equal_and_groups_together(spark, shards):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text "), (F.col("id") % 1000).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 37).cast("int"))).alias("text"),
    )
    rows = assign_shards(docs, shards=shards, ranges=32).collect()
    check(rows, shards)
    sizes, places = [0] * shards, {}
    for r in rows:
        sizes[r.shard] += r["size"]
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / shards + 400
    assert all(len(p) == 1 for p in places.values())


def test_a_group_larger_than_a_shard_is_divided(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 2000, "the hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
    )
    rows = assign_shards(docs, shards=8, ranges=64).collect()
    check(rows, 8)
    sizes = [0] * 8
    for r in rows:
        sizes[r.shard] += r["size"]
    assert max(sizes) <= 1.1 * min(sizes)


def test_whole_table_by_its_law(spark, sf_dir):
    """Every row once with its text's size and crc, sizes level but for the largest document
    or group, equal texts together, slots gapless."""
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = sharding.op9_sharding(spark, sf_dir).collect()
    check(rows, 16)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()
    )
    sizes, of_text, together = [0] * 16, {}, {}
    for r in rows:
        sizes[r.shard] += r["size"]
        text = docs[r.doc_id]
        of_text.setdefault(text, set()).add(r.shard)
        together[text] = together.get(text, 0) + r["size"]
    even = sum(sizes) / 16
    whole = [n for n in together.values() if n <= even]
    assert max(sizes) - min(sizes) <= 2 * max(whole)
    assert all(len(s) == 1 for t, s in of_text.items() if together[t] <= even)


def test_ranges_are_divided_without_samples(spark, monkeypatch):
    """No sample is ever drawn; the ranges still end at twice their mean."""
    monkeypatch.setattr(sharding, "SAMPLES", 1e-9)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = assign_shards(docs, shards=2, ranges=4).collect()
    check(rows, 2)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(2)]
    assert abs(sizes[0] - sizes[1]) <= 8


def test_ranges_follow_the_rows(spark, monkeypatch):
    wanted, cut = [], sharding._splitters
    monkeypatch.setattr(sharding, "_splitters", lambda rows, total, ranges: wanted.append(ranges) or cut(rows, total, ranges))
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    check(assign_shards(docs, ranges=4, range_rows=20).collect(), 16)
    assert wanted == [50]


def test_empty(spark):
    assert assign_shards(no_documents(spark)).collect() == []
