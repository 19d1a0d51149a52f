import hashlib

from helpers import no_documents, odd_documents, odd_rows

from ridelens.llm.exact_dedup import exact_duplicates, one_of_each_text, without_duplicates


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        text = text or ""
        key = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(m[3], keep, len(members), m[3] == keep, sha) for m in members]
    return sorted(out, key=str)


def test_matches_brute_force_on_odd_rows(spark):
    got = [tuple(r) for r in exact_duplicates(odd_documents(spark)).collect()]
    assert sorted(got, key=str) == brute(odd_rows())


def test_a_hot_group_and_any_number_of_salts(spark):
    rows = [(i, "same text", None, None, None) for i in range(-300, 300)] + odd_rows()
    docs = spark.createDataFrame(rows, odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    for salts in (1, 3):
        got = [tuple(r) for r in exact_duplicates(docs.repartition(7), salts=salts).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_extreme_ids(spark):
    rows = [(2**63 - 1, "a"), (-(2**63), "a"), (0, "a")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.keep_id for r in got} == {-(2**63)}


def test_what_stays_has_all_columns(spark):
    docs = odd_documents(spark)
    left = without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7, 8, 9, 10, 10, 11]


UNSAFE_IDS = [
    (1, "a copy", "x"),
    (None, "a copy", "x"),
    (None, "on its own", "x"),
    (2, "a copy", "x"),
    (2, "another text", "x"),
]


def test_a_lost_copy_takes_no_other_text_of_its_id(spark):
    docs = spark.createDataFrame(UNSAFE_IDS, "doc_id long, text string, _sha256 string")
    want = [(1, "a copy", "x"), (2, "another text", "x"), (None, "on its own", "x")]
    for kept in (without_duplicates(docs), one_of_each_text(docs)):
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_one_row_of_those_that_repeat_id_and_text(spark):
    again = [(None, "on its own", "x"), (3, "twice", "b"), (3, "twice", "a"), (3, "t w i c e", "a")]
    docs = spark.createDataFrame(UNSAFE_IDS + again, "doc_id long, text string, _sha256 string")
    want = [(1, "a copy", "x"), (2, "another text", "x"), (None, "on its own", "x"), (3, "t w i c e", "a")]
    for parts in (1, 7):
        kept = one_of_each_text(docs.repartition(parts))
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_one_row_of_each_odd_text(spark):
    docs = odd_documents(spark)
    left = one_of_each_text(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7, 8, 9, 10, 11]


def test_empty(spark):
    assert exact_duplicates(no_documents(spark)).collect() == []
    assert without_duplicates(no_documents(spark)).collect() == []


def test_one_row_of_nothing(spark):
    assert one_of_each_text(no_documents(spark)).collect() == []
