import hashlib
import zlib

import duckdb
import pytest
from helpers import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from ridelens.llm import merkle_manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    fields = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(hashes):
    """The root and, per leaf, the siblings before and after on its path."""
    paths, places = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 16] for i in range(0, len(hashes), 16)]
        for n, at in enumerate(places):
            run, slot = runs[at // 16], at % 16
            paths[n].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        hashes, places = [sha("".join(r)) for r in runs], [at // 16 for at in places]
    return (hashes[0] if hashes else None), paths


def by_brute_force(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found, roots = [], []
    for source in sources:
        own = [(r[0], leaf_of(r), r) for r in rows if r[3] == source]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = tree([x[1] for x in own])
        roots.append(root)
        found.append((own, paths))
    root, across = tree(roots)
    out = []
    for (own, paths), subroot, beyond in zip(found, roots, across, strict=True):
        for (doc_id, leaf, r), path in zip(own, paths, strict=True):
            path = path + beyond
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and r[1] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                now = leaf_of((r[0], lower, *r[2:]))
            for a, b in path:
                now = sha(a + now + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((doc_id, leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def query_rows(docs, **options):
    rows = M.manifest(docs, tampered=M.tampered_leaf(docs), **options)
    steps = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    end = M.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, ""), 256), end.alias("e"), (F.col("e") == F.col("root")))
    return sorted(map(tuple, rows.collect()), key=str)


def test_query_by_brute_force_and_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    want = by_brute_force(rows)
    assert sorted(map(tuple, M.op12_merkle_manifest(spark, sf_dir).collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.execute(M.OP12_SQL).fetchall(), key=str) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


@pytest.mark.parametrize("fan_bits", [1, 10])
def test_odd_rows(spark, fan_bits):
    assert query_rows(odd_documents(spark), fan_bits=fan_bits) == by_brute_force(odd_rows())


@pytest.mark.parametrize("fan_bits", [2, 10])
def test_sparse_ids_hot_source_and_repeats(spark, fan_bits):
    ids = [0, -1, -(2**63), 2**63 - 1, 63, 64, 2**40, None, None, None, *range(300, 700), *range(5_000_000, 5_000_900, 3)]
    ids += [7] * 40
    rows = [(d, f"Text {n % 5}", "en", "hot" if n % 3 else f"s{n % 7}", 6) for n, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query_rows(docs.repartition(5), fan_bits=fan_bits) == by_brute_force(rows)


def test_many_sources(spark):
    rows = [(n, "T", "en", None if n == 5 else f"ü{n}" if n % 2 else f"s{n}", 1) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query_rows(docs) == by_brute_force(rows)


def test_empty_and_single(spark):
    assert query_rows(no_documents(spark)) == []
    one = spark.createDataFrame([(3, "A", None, None, None)], no_documents(spark).schema)
    assert query_rows(one) == by_brute_force([(3, "A", None, None, None)])
