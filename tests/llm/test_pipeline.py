from helpers import no_documents, odd_documents
from test_dart_minhash import brute as near_brute
from test_exact_dedup import brute as exact_brute

import corpus_pipeline as P
from ridelens.llm.mixing import mix
from ridelens.llm.quality import score, train
from ridelens.llm.tables import table


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(P.STAGES)
    weights = train(docs, table(spark, sf_dir, "labels"))
    one = stages["quality classifier"](spark, docs, sf_dir)
    held = docs.collect()
    assert ids(one) == sorted(r.doc_id for r in held if score(r.text, weights) >= 0.7)
    two = stages["exact dedup"](spark, docs, sf_dir)
    assert ids(two) == sorted(r[0] for r in exact_brute([(r.doc_id, r.text) for r in held]) if r[3])
    three = stages["MinHash near-dedup"](spark, docs, sf_dir)
    assert ids(three) == sorted(set(near_brute([(r.doc_id, r.text) for r in held]).values()))
    four = stages["mixing to target weights"](spark, docs, sf_dir)
    assert ids(four) == ids(mix(docs).filter("_mix_kept"))
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns
    five = stages["packing"](spark, docs, sf_dir)
    assert ids(five.select("doc_id").distinct()) == ids(docs)


def test_run_chains_the_stages(spark, sf_dir):
    packed = P.run(spark, sf_dir)
    kept = set(ids(packed))
    docs = table(spark, sf_dir, "documents")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
    assert kept == set(ids(docs))


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert P.quality_stage(spark, good, sf_dir).count() >= 0.97 * good.count()


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = odd_documents(spark)
    for _, stage in P.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, no_documents(spark), sf_dir).count() == 0
