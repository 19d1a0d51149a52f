"""Forests in stored batches: resumed, merged, and walked by SQL as a table of nodes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ridelens.operators import forests, learning_data, models
from ridelens.plans import catalog, layers
from ridelens.plans.layers import silver
from ridelens.sources.derived import ROW_KEY

SPEC = models.ForestSpec(tuple(learning_data.PREBOOKING_FEATURES), trees=5, depth=6, min_leaf=2)

WALK = """
WITH RECURSIVE walk AS (
  SELECT r.*, t.tree, 0 AS node FROM (SELECT DISTINCT {key} FROM rows) r, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL
  SELECT {w_key}, w.tree, CASE WHEN coalesce(n.threshold >= coalesce(s.value, 0),
    list_contains(n.left_values, coalesce(s.value, 0))) THEN n."left" ELSE n."right" END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NOT NULL
  LEFT JOIN slots s ON {s_key} AND s.slot = n.feature
)
SELECT {w_key}, avg(n.weight_1 / (n.weight_0 + n.weight_1)) AS p
FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NULL
GROUP BY ALL
"""


@pytest.fixture(scope="module")
def grown(spark, sf_dir, tmp_path_factory):
    rows = learning_data.features(silver(spark, sf_dir), SPEC.features, ROW_KEY)
    folder = str(tmp_path_factory.mktemp("forest"))
    return forests.grow(rows, SPEC, folder, batch_trees=2), rows


def test_plain_sql_walks_to_the_same_probabilities(spark, grown, tmp_path):
    forest, rows = grown
    some = rows.orderBy(*ROW_KEY).limit(300)
    forests.nodes(spark, forest).write.parquet(str(tmp_path / "nodes"))
    forests.slots(forest, some, ROW_KEY).write.parquet(str(tmp_path / "slots"))
    some.select(*ROW_KEY).write.parquet(str(tmp_path / "rows"))
    con = duckdb.connect()
    for name in ("nodes", "slots", "rows"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert con.execute("SELECT count(DISTINCT tree) FROM nodes").fetchone()[0] == SPEC.trees
    sql = WALK.format(
        key=", ".join(ROW_KEY),
        w_key=", ".join(f"w.{k}" for k in ROW_KEY),
        s_key=" AND ".join(f"s.{k} = w.{k}" for k in ROW_KEY),
    )
    want = {r[:-1]: r[-1] for r in con.execute(sql).fetchall()}
    scored = forests.predict(forest, some).collect()
    assert len(scored) == len(want) == 300
    for r in scored:
        p = want[tuple(r[k] for k in ROW_KEY)]
        assert r.Completion_Probability == pytest.approx(p, abs=1e-12)
        assert r.Predicted_Completed == int(p > 0.5)
    assert len({round(p, 9) for p in want.values()}) > 20


def test_finished_batches_are_kept(spark, grown):
    forest, rows = grown
    assert [b.getNumTrees for b in forest.batches] == [2, 2, 1] and forest.trees == SPEC.trees
    assert forests.finished_batches(spark, forest.folder) == [0, 1, 2]
    again = forests.grow(rows.limit(0), SPEC, forest.folder, batch_trees=2)  # nothing is left to fit
    assert again.trees == SPEC.trees


def test_a_run_that_ended_goes_on(spark, grown, tmp_path):
    _, rows = grown
    folder = str(tmp_path)
    small = models.ForestSpec(SPEC.features, trees=2, depth=6, min_leaf=2)
    first = forests.grow(rows, small, folder, batch_trees=2)
    whole = forests.grow(rows, SPEC, folder, batch_trees=2)
    assert whole.trees == 5 and whole.batches[0].toDebugString == first.batches[0].toDebugString


def test_importance_is_the_mean_of_the_trees(grown):
    forest, _ = grown
    rows = {r.Feature: r.Importance for r in forests.feature_importance(forest).collect()}
    assert sum(rows.values()) == pytest.approx(1, abs=1e-3)
    assert set(rows) == set(models.feature_names(forest.features))


def test_no_job_before_the_action_on_an_unchanged_input(spark, sf_dir):
    query = catalog.queries()["hourly_demand"]
    query(spark, sf_dir).collect()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("unchanged", "unchanged")
    try:
        query(spark, sf_dir)
        assert list(tracker.getJobIdsForGroup("unchanged")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_refresh_looks_again(spark, tmp_path):
    for name in layers.INPUTS:
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    before = layers.input_state(spark, str(tmp_path))
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    layers.refresh(spark, str(tmp_path))
    assert layers.input_state(spark, str(tmp_path)) != before


def test_split_is_stored_once(spark, sf_dir):
    first = catalog._stored_split(spark, sf_dir)
    assert first.inputFiles() == catalog._stored_split(spark, sf_dir).inputFiles()
    counts = first.groupBy("Target_Completed").agg(F.sum("Is_Test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == int(r.n * 0.2 + 0.5) for r in counts)
