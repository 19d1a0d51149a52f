import itertools
import random
import re

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows

from ridelens.llm import dart_minhash as D
from ridelens.llm.components import components
from ridelens.llm.tables import table


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return None
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, least=0.8):
    """Class (smallest id) of each id, from all pairs."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t) or (t or "")) for i, t in rows]
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        texts = isinstance(s, str) or isinstance(t, str)
        near = s == t if texts else len(s & t) >= least * len(s | t)
        if near:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("n, shared", [(10, 9), (200, 100), (2000, 1800), (1, 1)])
def test_agreement_is_the_similarity(n, shared):
    rng = np.random.default_rng(n)
    new = lambda size: rng.integers(0, 2**63, size).astype(np.uint64)
    common = new(shared)
    one, two = (np.concatenate([common, new(n - shared)]) for _ in range(2))
    s = D.signatures([(one, np.ones(n)), (two, np.ones(n))], 3000)
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.04


def test_agreement_with_weights():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 40, 300), rng.uniform(0.2, 40, 300)
    s = D.signatures([(elements, a), (elements, b)], 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_a_signature_does_not_depend_on_its_batch():
    rng = np.random.default_rng(6)
    docs = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)),) for n in (3, 0, 900)]
    docs = [(e, np.ones(len(e))) for (e,) in docs]
    together = D.signatures(docs)
    for i, d in enumerate(docs):
        assert (D.signatures([d])[0] == together[i]).all()


def test_odd_rows(spark):
    rows = D.near_duplicates(odd_documents(spark)).collect()
    named = [(i, t) for i, t, *_ in odd_rows() if i is not None]
    want = brute(list(dict.fromkeys(named)))
    assert len(rows) == len(odd_rows())
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == want
    assert [(r.class_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    left = D.one_of_each(odd_documents(spark))
    assert left.columns == odd_documents(spark).columns


@pytest.mark.parametrize("weights", ["set", "count"])
def test_a_chain_of_changes_and_a_hot_group(spark, weights):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows, text = [], list(base)
    for i in range(30):  # each is near to its neighbour, the ends are not
        rows.append((i, " ".join(text)))
        text[(i * 5) % 150] = word()
    for i in range(100, 250):  # near copies of one text, many pairs of which are not near
        text = list(base[::-1])
        for at in rng.sample(range(150), 4):
            text[at] = word()
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(word() for _ in range(100))) for i in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs, weights=weights).collect()}
    assert got == brute(rows)


def test_whole_table_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in D.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_only_the_near_copy_of_a_repeated_id_goes(spark):
    word = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    near = word(1) + " more"
    rows = [(1, word(1), "a"), (5, near, "a"), (5, word(2), "a"), (6, word(3), "b"), (6, word(3), "a")]
    rows += [(7, word(3) + " more", "a"), (None, word(1), "a"), (None, word(1), "a"), (-1, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node string")
    left = D.one_of_each(docs)
    assert left.columns == docs.columns
    want = [(1, word(1), "a"), (5, word(2), "a"), (6, word(3), "b"), (-1, None, "a")] + rows[6:8]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def test_open_pairs_of_a_bucket_with_one_large_class(spark):
    """Every pair of different classes that is near enough, each once, none inside a class."""
    sets, groups = {}, {}
    for i in range(60):  # one class of forty, one of ten, ten members of their own
        sets[i] = [*range(90), *range(1000 + i * 10, 1000 + i * 10 + (i % 12))]
        groups[i] = 0 if i < 40 else 40 if i < 50 else i
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{x}" for x in s)) for i, s in sets.items()], "id long, text string"
    )
    prepared = D._prepared(docs, 5, "set")
    members = spark.createDataFrame([(7, i, 60) for i in sets] + [(8, i, 3) for i in (1, 45, 59)], "key long, id long, n long")
    labels = spark.createDataFrame([(i, c) for i, c in groups.items() if i < 50], "node long, class long")
    open_ = D._open_pairs(members, labels, prepared, 0.8)
    got = [tuple(r) for r in open_.collect()]
    assert len(got) == len(set(got)) and all(u < v and groups[u] != groups[v] for u, v in got)
    near = {tuple(r) for r in D._verified(open_, prepared, 0.8).collect()}
    texts = {r.id: shingle_set(r.text) for r in docs.collect()}
    want = {
        (u, v) for u, v in itertools.combinations(sorted(sets), 2)
        if groups[u] != groups[v] and len(texts[u] & texts[v]) >= 0.8 * len(texts[u] | texts[v])
    }
    assert near == want and want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}}


def test_empty(spark):
    assert D.near_duplicates(no_documents(spark)).collect() == []
