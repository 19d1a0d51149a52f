import re

import pytest
from helpers import no_documents, odd_documents, odd_rows

from ridelens.llm import license_scan as L

PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_brute_force(text, rules):
    words = words_of(text)
    base = []
    for phrase, label in PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    joined = (" " + " ".join(words) + " ").encode()
    found = []
    for n, r in enumerate(rules):
        for m in r.pattern.finditer(joined):
            start = joined[: m.start()].count(b" ")
            found.append((r.priority, start, start + len(m.group().split()), n))

    def beats(a, b):  # a contains b and is better
        return a[1] <= b[1] and a[2] >= b[2] and (a[0], -(a[2] - a[1]), a[3]) < (b[0], -(b[2] - b[1]), b[3])

    # Being contained is transitive, so it does not matter whether the better one is kept.
    kept = [f for f in found if not any(beats(o, f) for o in found)]
    labels = {x for _, x in base} | {rules[f[3]].label for f in kept}
    starts = [i for i, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)),
        max((rules[f[3]].trust for f in kept), default=0.0),
    )


def test_query_by_brute_force(spark, sf_dir):
    rules = L.standard_rules()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = L.op13_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: by_brute_force(t, rules) for i, t in texts.items()}
    assert any(r.labels for r in rows) and any(not r.labels for r in rows)


LICENSED = [
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0", 1),
    ("GNU GENERAL PUBLIC LICENSE or GNU General Public License v3", "gpl,gpl-3.0", 2),
    ("text under CC BY-NC-SA 4.0, and CC-BY", "cc-by,cc-by-nc-sa-4.0", 2),
    ("MIT License MIT\nlicense", "mit", 2),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0", 0),
    ("er kommt mit der lizenz", "", 0),
    ("smith license, éMIT License", "", 0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit", 0),
    ("Der MIT License Apache License cc by", "apache,cc-by,mit", 3),
    ("GNU Lesser General Public Licence 2.1", "lgpl-2.1", 0),
]


@pytest.mark.parametrize(("text", "labels", "count"), LICENSED)
def test_texts(text, labels, count):
    got = by_brute_force(text, L.standard_rules())
    assert (got[5], got[1]) == (labels, count)
    found = L.Scanner(L.standard_rules()).scan(L.words_of(text.encode()))
    spelled = {d.label for d in found if d.kept or d.form == "base"}
    assert ",".join(sorted(spelled)) == labels
    assert sum(d.form == "base" for d in found) == count


def test_odd_rows(spark):
    rules = L.standard_rules()
    rows = L.scan_documents(odd_documents(spark)).collect()
    want = sorted(((i, by_brute_force(t, rules)[0]) for i, t, *_ in odd_rows()), key=str)
    assert sorted(((r.doc_id, r.n_words) for r in rows), key=str) == want
    assert L.scan_documents(no_documents(spark)).collect() == []


def test_licenses_lists_what_is_kept(spark):
    docs = spark.createDataFrame([(1, "x Licensed under the MIT License, cc by")], "doc_id long, text string")
    got = [(r.label, r.form, r.first_word, r.last_word) for r in L.licenses(docs).orderBy("first_word").collect()]
    assert got == [("mit", "grant", 1, 5), ("cc-by", "base", 6, 7)]


def test_a_text_of_many_mentions_is_scanned_in_one_sweep():
    words = L.words_of(b"mit license cc by sa 4.0 gnu general public license v2 " * 4000)
    found = L.Scanner(L.standard_rules()).scan(words)
    assert sum(d.form == "base" for d in found) == 12_000
    assert sum(d.kept for d in found) >= 12_000


def test_hundreds_of_rules():
    rules = L.standard_rules()
    assert len(rules) >= 400
    assert all(r.gates and all(r.gates) for r in rules)
