import hashlib
import re

import numpy as np
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from ridelens.llm import fingerprints as P
from ridelens.llm.tables import table


def shingle_set(text):
    words = re.findall(r"\w+", text.lower())
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    plain = " ".join(text.lower().split())
    return {plain[i : i + 5] for i in range(max(1, len(plain) - 4))} if plain else set()


def exact(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = P.sketch(a), P.sketch(b)
    assert abs(P.resemblance(x, y) - exact(a, b)) < 0.1
    assert abs(P.containment(x, y) - 0.5) < 0.12
    assert abs(P.distinct_count(x) / 1996 - 1) < 0.25
    assert P.distinct_count(P.sketch("a b c d e f")) == 2


def test_texts_of_few_words_are_compared_by_characters():
    def like(a, b):
        return P.resemblance(P.sketch(a), P.sketch(b))

    assert like("!!!", "???") == like("", "x") == like("one two", "three four") == 0
    assert like("", None) == like(" \n", "") == like("Hello  World", "hello world") == 1
    assert like("\ud800!", "\ud800!") == 1  # a lone surrogate is a sign like any other
    first = "吾輩は猫である名前はまだ無いどこで生れたかとんと見当がつかぬ"
    for a, b in [(first + "何でも薄暗い所", first + "今は昔のことなり"), ("!!! ??? ***", "!!! ??? +++")]:
        assert like(a, b) == exact(a, b) > 0.2


def test_merged_parts_are_the_whole():
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    both = np.unique(np.concatenate([P.sketch(a), P.sketch(b)]))
    assert (P.merged([P.sketch(a), P.sketch(b)]) == both).all()
    assert (P.parsed(P.spelled(both)) == both).all()
    assert P.parsed("").size == 0


def check(docs, rows):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    by_id = {r.doc_id: r for r in rows}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = text or "", following or "", by_id[i]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == P.spelled(P.sketch(text))
        assert r.edited_fingerprint == P.spelled(P.sketch(changed))
        assert abs(r.near_edited - exact(text, changed)) < 0.15
        assert abs(r.near_next - exact(text, following)) < 0.15


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = P.fingerprint_documents(docs).collect()
    assert len(rows) == len(odd_rows())
    once = docs.dropDuplicates(["doc_id"]).select("doc_id", "text")
    pairs = [tuple(r) for r in once.collect()]
    check(pairs, P.fingerprint_documents(once).collect())


def test_any_number_of_runs(spark):
    docs = [(i * 3 - 50, f"text {i} " * (i % 50)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            check(docs, P.fingerprint_documents(frame).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_table_by_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(docs, P.op10_fingerprints(spark, sf_dir).collect())


def test_no_more_runs_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN_BYTES", 10)
    monkeypatch.setattr(P, "MOST_RUNS", 20)
    docs = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(P._run_starts(frame, frame["doc_id"], frame["text"])) <= 21
    check(docs, P.fingerprint_documents(frame).collect())


def test_one_document_follows_itself(spark):
    docs = [(5, "a b c d e f g h")]
    check(docs, P.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_merge_by(spark):
    docs = odd_documents(spark).withColumn("source", F.when(F.col("source") != "", F.col("source")))
    got = {r.source: r for r in P.merge_by(docs, "source").collect()}
    held = {}
    for r in docs.select("source", "text").collect():
        held.setdefault(r.source, []).append(P.sketch(r.text))
    assert {s: r.fingerprint for s, r in got.items()} == {s: P.spelled(P.merged(x)) for s, x in held.items()}


def test_empty(spark):
    assert P.fingerprint_documents(no_documents(spark)).collect() == []
