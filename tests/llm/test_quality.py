import zlib

import numpy as np
from helpers import no_documents, odd_documents, odd_rows

from ridelens.llm import quality as Q
from ridelens.llm.tables import table


def test_features_have_length_one_and_are_sparse():
    index, values = Q.features("The cat, the cat! the")
    assert len(index) == len(set(index.tolist())) and abs((values**2).sum() - 1) < 1e-9
    assert Q.features("")[0].size == Q.features(None)[0].size == Q.features(" \n")[0].size == 0


def test_updates_by_hand():
    model = Q.FollowTheLeader(4)
    index, values = np.array([0, 4]), np.array([0.6, 1.0])
    model.update(index, values, 1)
    g = (0.5 - 1) * values
    assert np.allclose(model.n[index], g * g)
    shrunk = np.sign(g) * np.maximum(np.abs(g) - Q.L1, 0)
    want = -shrunk / ((Q.BETA + np.abs(g)) / Q.ALPHA + Q.L2)
    assert np.allclose(model.weights_at(index), want)
    assert model.weights()[1] == 0


def test_learns_and_scores_only_text():
    good = [f"a plain sentence about house number {i} and its garden" for i in range(60)]
    bad = [f"buy### now### {i} $$$ cheap### cheap### cheap###" for i in range(60)]
    weights = Q.fit([t for pair in zip(good, bad, strict=True) for t in pair], [1, 0] * 60)
    assert min(Q.score(t, weights) for t in good) > 0.7 > max(Q.score(t, weights) for t in bad)
    assert Q.score("", weights) == Q.score(None, weights)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 1), (3, 0), (3, 1), (5, None), (None, 1), (7, 0), (99, 1), (8, 5)], "doc_id long, quality int"
    )
    weights = Q.train(docs, labels)
    rows = Q.score_documents(docs, weights).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        out = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert Q.accepted(docs, weights).columns == docs.columns
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score_documents(docs, none).collect()} == {0.5}


def test_held_out_labels_are_not_learned(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    from ridelens.llm.tables import held_out

    seen = labels.filter(~held_out(labels["doc_id"]))
    assert np.array_equal(Q.train(docs, labels), Q.train(docs, seen))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = Q.score_documents(docs, Q.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in clean) >= 0.97 * len(clean)


def test_empty(spark):
    weights = Q.train(no_documents(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score_documents(no_documents(spark), weights).collect() == []
