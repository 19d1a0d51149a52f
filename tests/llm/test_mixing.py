from collections import defaultdict

from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from ridelens.llm import mixing
from ridelens.llm.mixing import DIMENSIONS, mix, rake, sampled


def test_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame(
        [(s, g, t, 1000 * (i + 1)) for i, (s, g, t) in enumerate(
            (s, g, t) for s in ("a", "b", "c") for g in ("en", "de") for t in ("x", "y"))],
        "source string, lang string, topic string, tokens long",
    )
    targets = {
        "source": {"a": 0.3, "b": 0.3, "c": 0.4},
        "lang": {"en": 0.5, "de": 0.5},
        "topic": {"x": 0.4, "y": 0.6},
    }
    rows = rake(cells, keep=0.2, rounds=20, targets=targets).collect()
    total = sum(r.tokens for r in rows)
    for d in DIMENSIONS:
        sums = defaultdict(float)
        for r in rows:
            assert 0 <= r["_mix_probability"] <= 1
            sums[r[d]] += r.tokens * r["_mix_probability"]
        for value, share in targets[d].items():
            assert abs(sums[value] / (0.2 * total) - share) < 0.01


def test_rounds_end_within_the_tolerance(spark, monkeypatch):
    seen, once = [], mixing._raked_once
    monkeypatch.setattr(mixing, "_raked_once", lambda state: seen.append(1) or once(state))
    cells = spark.createDataFrame(
        [(s, g, t, 10 + 7 * i) for i, (s, g, t) in enumerate(
            (s, g, t) for s in "abcd" for g in ("en", None) for t in "xy")],
        "source string, lang string, topic string, tokens long",
    )
    fine = {r[:3]: r["_mix_probability"] for r in rake(cells, tolerance=1e-9).collect()}
    rounds = len(seen)
    coarse = {r[:3]: r["_mix_probability"] for r in rake(cells, tolerance=1e-3).collect()}
    assert 0 < len(seen) - rounds < rounds < mixing.ROUNDS
    assert len(fine) == 16 and all(abs(coarse[k] - p) < 0.01 for k, p in fine.items())
    sums = defaultdict(float)
    for r in cells.collect():
        sums[r.lang] += r.tokens * fine[r[:3]]
    has = [sum(r.tokens for r in cells.collect() if r.lang == g) for g in ("en", None)]
    assert abs(sums["en"] / sums[None] - (has[0] / has[1]) ** 0.5) < 1e-4


def test_values_without_a_target_are_left_out(spark):
    cells = spark.createDataFrame(
        [("a", "en", "x", 10), ("b", "en", "x", 10)], "source string, lang string, topic string, tokens long"
    )
    got = {r.source: r["_mix_probability"] for r in rake(cells, targets={"source": {"a": 1.0}}).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_odd_rows_keep_their_columns(spark):
    docs = odd_documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["_mix_probability"] <= 1 and r["_mix_kept"] is not None for r in rows)
    assert len({r["_mix_kept"] for r in rows if r.doc_id == 10}) == 1
    everything = sampled(docs, keep=1.0)
    assert everything.columns == docs.columns


def test_share_of_tokens(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.lit("one two three four").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("other").alias("source"),
        F.lit("en").alias("lang"),
    )
    kept = sampled(docs, keep=0.3).groupBy("source").count().collect()
    assert abs(sum(r["count"] for r in kept) - 1200) < 120


def test_empty(spark):
    assert mix(no_documents(spark)).collect() == []


def test_columns_with_the_operators_own_names(spark):
    rows = [(i, "some words here", "en", "a", i, f"note {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _mix_tokens long, _mix_note string")
    kept = mixing.sampled(docs).collect()
    assert 0 < len(kept) < 200
    assert all(r._mix_tokens == r.doc_id and r._mix_note == f"note {r.doc_id}" for r in kept)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 200 and all(r._mix_tokens == 3 and r._mix_note == f"note {r.doc_id}" for r in mixed)


def test_residuals_show_how_far_the_marginals_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.residuals(mixing.mix(docs)).collect()
    assert {r.dimension for r in rows} == set(mixing.DIMENSIONS)
    for d in mixing.DIMENSIONS:
        wanted = sum(r.wanted for r in rows if r.dimension == d)
        got = sum(r.expected for r in rows if r.dimension == d)
        assert got <= wanted * 1.01 and all(0 <= r.residual for r in rows)


def test_rounds_over_few_cells_need_no_shuffle(spark, monkeypatch):
    plans, once = [], mixing._raked_once

    def watched(state):
        raked = once(state)
        plans.append(raked._jdf.queryExecution().executedPlan().toString())
        return raked

    monkeypatch.setattr(mixing, "_raked_once", watched)
    cells = spark.createDataFrame(
        [(s, g, "x", 10 + 7 * i) for i, (s, g) in enumerate((s, g) for s in "abcd" for g in ("en", None))],
        "source string, lang string, topic string, tokens long",
    )
    few = {r[:3]: r["_mix_probability"] for r in rake(cells).collect()}
    assert plans and not any("hashpartitioning" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(mixing, "CELLS_PER_TASK", 3)
    many = {r[:3]: r["_mix_probability"] for r in rake(cells).collect()}
    assert any("hashpartitioning" in p for p in plans)
    assert all(abs(few[k] - p) < 1e-6 for k, p in many.items())
