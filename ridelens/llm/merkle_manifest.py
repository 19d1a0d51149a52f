"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels from slot arrays.

Each source keeps the set of its ids as a bitmap of 64-bit words, stored only where a
bit is set and merged with partial aggregation. A directory of popcounts, in levels of
1,024 entries, says how many rows lie before each word. The rank of an id, its leaf's
coordinate, is the directory's count plus the set bits below it in its own word: nothing
is sorted but at most 1,024 directory entries at a time.

A node at coordinate i belongs to slot i mod 16 of run i div 16. Runs are gathered as
arrays keyed by slot and hashed to the nodes of the next level, until each source has one
node. The same is done with the sources' nodes. Runs are stored, and the way back down
hands every node the siblings on its path to the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridelens.llm.tables import crc32_mod, stored, table

#: Nodes that one hash joins.
ARITY = 16
#: A directory entry stands for so many bits of entries below, which are ordered together.
FAN_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_ID = -(2**57) - 1  # the word of missing ids, before every other
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "sources"


def spelled(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(f) for f in fields]), 256)


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf after lower-casing A to Z of the text, for the documents that the check
    tampers with (crc32 of the decimal id divisible by 5); else null."""
    lower = F.translate(docs["text"], _UPPER, _LOWER)
    changed = leaf_hash([docs[f] for f in FIELDS[:-1]] + [lower])
    return F.when(crc32_mod(docs["doc_id"], 5) == 0, changed)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, group, leaf, tampered) per row; ``group`` spells the source, null first."""
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("")).alias("group"),
        leaf_hash([docs[f] for f in FIELDS]).alias("leaf"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
    )


def _word(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(_NO_ID))


def _bit(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int")


def bitmaps(rows: DataFrame) -> DataFrame:
    """(group, word, bits, n): the ids' words; ``n`` is above the popcount if ids repeat."""
    one = F.expr("shiftleft(1L, bit)")
    return (
        rows.select("group", _word(F.col("doc_id")).alias("word"), _bit(F.col("doc_id")).alias("bit"))
        .groupBy("group", "word")
        .agg(F.bit_or(one).alias("bits"), F.count("*").alias("n"))
    )


def _before(by: Sequence[str], order: str) -> Column:
    return F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n")


def with_starts(counts: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """``counts`` (group, word, n and more) with ``start``, the rows of the group before it.

    Counts are summed for every ``2**fan_bits`` words, again and again, until no group has
    more entries than that; then starts are handed down. ``counts`` is a stored table.
    """
    if fan_bits < 1:
        raise ValueError("a directory needs a fan of 2 or more")
    parent = F.shiftright("word", fan_bits)
    levels = [counts]
    while True:
        most = levels[-1].groupBy("group").count().agg(F.max("count")).first()[0] or 0
        # Above 64 bits of words nothing is left to sum up but the sign.
        if most <= 2**fan_bits or len(levels) * fan_bits > 64:
            break
        up = levels[-1].groupBy("group", parent.alias("word")).agg(F.sum("n").alias("n"))
        levels.append(stored(up, "directory"))
    out = levels.pop().withColumn("start", _before(["group"], "word"))
    while levels:
        low = levels.pop().withColumn("parent", parent)
        low = low.withColumn("inside", _before(["group", "parent"], "word"))
        up = out.select("group", F.col("word").alias("parent"), F.col("start").alias("above"))
        out = low.join(up, ["group", "parent"]).withColumn("start", F.col("above") + F.col("inside"))
        out = out.drop("parent", "inside", "above")
    return out


def _repeat_numbers(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(row, number): place of each row among those that share its group and id.

    They are ordered by leaf, then by row; a third of all rows may share an id or even a
    leaf. So leaves are numbered in 65,536 ranges of their hash, and rows of one leaf per
    task that read them.
    """
    key = ["group", "word", "bit"]
    there = rows.join(several.select(*key), key, "left_semi").select(
        *key, "leaf", "row",
        F.substring("leaf", 1, 4).alias("range"),
        F.shiftright("row", 33).alias("part"),
    )
    parts = there.groupBy(*key, "range", "leaf", "part").agg(F.count("*").alias("n"))
    ranges = parts.groupBy(*key, "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select(*key, "range", _before(key, "range").alias("a"))
    of_leaf = parts.groupBy(*key, "range", "leaf").agg(F.sum("n").alias("n"))
    of_leaf = of_leaf.select(*key, "range", "leaf", _before([*key, "range"], "leaf").alias("b"))
    starts = parts.select(*key, "range", "leaf", "part", _before([*key, "range", "leaf"], "part").alias("c"))
    placed = starts.join(of_leaf, [*key, "range", "leaf"]).join(ranges, [*key, "range"])
    inside = F.row_number().over(Window.partitionBy(*key, "leaf", "part").orderBy("row")) - 1
    return there.withColumn("d", inside).join(placed, [*key, "range", "leaf", "part"]).select(
        "row", F.expr("a + b + c + d").alias("number")
    )


def placed(rows: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """``rows`` (doc_id, group, leaf and more) with ``index``, the coordinate in the group,
    and ``total``, the rows of the group.

    Ids ascend, missing ones first; rows that share an id follow their leaf's hash. The
    ids' order comes from bitmap ranks. ``rows`` is a stored table.
    """
    words = stored(bitmaps(rows), "bitmaps")
    directory = with_starts(words, fan_bits)
    totals = words.groupBy("group").agg(F.sum("n").alias("total"))
    ranked = rows.withColumns({"word": _word(F.col("doc_id")), "bit": _bit(F.col("doc_id"))})
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    if words.filter("n > bit_count(bits)").isEmpty():
        out = ranked.join(directory.drop("n"), ["group", "word"]).withColumn("index", F.col("start") + below)
    else:
        # Words with repeated ids: each id's rows are counted, at most 64 ids a word.
        ranked = stored(ranked.withColumn("row", F.monotonically_increasing_id()), "rows")
        ids = ranked.groupBy("group", "word", "bit").agg(F.count("*").alias("n"))
        ids = stored(ids.select("*", _before(["group", "word"], "bit").alias("before")), "ids")
        several = ids.filter("n > 1")
        numbers = stored(_repeat_numbers(ranked, several), "numbers")
        out = (
            ranked.join(numbers, "row", "left")
            .join(ids.drop("n"), ["group", "word", "bit"])
            .join(directory.drop("n"), ["group", "word"])
            .withColumn("index", F.col("start") + F.col("before") + F.coalesce("number", F.lit(0)))
        )
    return out.join(totals, "group").select(*rows.columns, "index", "total")


def _runs(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(group, run, total, nodes): arrays of slot, hash and ``extra``, in slot order."""
    slot = F.struct((F.col("index") % ARITY).cast("int").alias("slot"), "hash", *extra)
    return nodes.groupBy("group", F.shiftright("index", 4).alias("run"), "total").agg(
        F.array_sort(F.collect_list(slot)).alias("nodes")  # at most ARITY
    )


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


class Tree:
    """The stored runs of each level over ``nodes`` (group, index, total, hash, extra).

    Level l has the groups of more than ``ARITY**l`` nodes, the lowest level all. A group
    of up to ``ARITY**(l + 1)`` nodes ends there with its only run; a single node is its
    own root.
    """

    def __init__(self, nodes: DataFrame, extra: Sequence[str] = ()):
        most = nodes.agg(F.max("total")).first()[0] or 0
        self.levels, self.tops = [], []
        while True:
            runs = stored(_runs(nodes, () if self.levels else extra), f"runs-{len(self.levels)}")
            hashes = F.col("nodes.hash")
            parent = F.when(F.col("total") == 1, hashes[0]).otherwise(F.sha2(_joined(hashes), 256))
            made = runs.select("group", F.col("run").alias("index"), "total", parent.alias("hash"))
            self.levels.append(runs)
            size = ARITY ** len(self.levels)
            self.tops.append(made.filter(F.col("total") <= size).select("group", "hash"))
            if most <= size:
                break
            nodes = made.filter(F.col("total") > size)

    def roots(self) -> DataFrame:
        """(group, hash): one node per group."""
        out = self.tops[0]
        for top in self.tops[1:]:
            out = out.unionByName(top)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The lowest nodes, exploded, with ``path``: an array of the siblings' hashes
        before and after the node's place, from its own level up. ``above`` has the path
        that each group's root has beyond this tree, and further columns to hand down."""
        handed = [c for c in above.columns if c not in ("group", "path")]
        down = None
        for level in range(len(self.levels) - 1, -1, -1):
            runs = self.levels[level]
            ending = (F.col("run") == 0) & (F.col("total") <= ARITY ** (level + 1))
            known = runs.filter(ending).select("group", "run").join(above, "group")
            known = known.select("group", "run", "path", *handed)
            here = runs.join(known if down is None else known.unionByName(down), ["group", "run"])
            hashes, at = F.col("nodes.hash"), F.col("at")
            ahead = _joined(F.slice(hashes, 1, at)).alias("before")
            behind = _joined(F.slice(hashes, at + 2, ARITY)).alias("after")
            path = F.concat(F.array(F.struct(ahead, behind)), "path")
            path = F.when(F.col("total") == 1, F.col("path")).otherwise(path)
            each = here.select("*", F.posexplode("nodes").alias("at", "node")).withColumn("path", path)
            index = F.col("run") * ARITY + F.col("node.slot")
            down = each.select("group", index.alias("run"), "path", *handed)
        return each.select("group", "node.*", "path", *handed)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(
        path, start, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256)
    )


def _numbered_sources(subroots: DataFrame) -> DataFrame:
    """``subroots`` with ``index`` in the order of their groups: a distributed sort, whose
    partitions are counted."""
    ordered = subroots.orderBy("group").withColumn("id", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("part", F.shiftright("id", 33)), "sources")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition of the sort.
    parts = parts.select("part", F.col("n"), _before([], "part").alias("start"))
    inside = F.col("id").bitwiseAND(F.lit(2**33 - 1))
    return ordered.join(parts, "part").select(
        F.lit(_TOP).alias("group"), (F.col("start") + inside).alias("index"), "hash",
        F.col("group").alias("source"),
    )


def manifest(docs: DataFrame, *, tampered: Column | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, tampered.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves of a source ascend by
    id; missing ids come first, rows that share an id follow their leaf's hash, and rows
    equal in all fields are leaves of their own. A lone leaf is its source's subroot, a
    lone subroot the root. ``path`` holds the siblings' hashes before and after the node,
    level by level up to the root. ``tampered`` is carried along. Other columns are not
    read. Empty in, empty out. Leaves, bitmaps and runs are written to the shared folder.
    """
    rows = stored(leaves(docs, tampered), "leaves")
    nodes = placed(rows, fan_bits).withColumnRenamed("leaf", "hash")
    tree = Tree(stored(nodes, "nodes"), ["doc_id", "tampered"])
    subroots = _numbered_sources(tree.roots())
    sources = subroots.count()
    top = Tree(subroots.withColumn("total", F.lit(sources).cast("long")), ["source"])
    root = top.roots().select(F.lit(_TOP).alias("group"), F.col("hash").alias("root"))
    root = root.withColumn("path", F.expr("cast(array() as array<struct<before:string,after:string>>)"))
    above = top.paths(root).select(
        F.col("source").alias("group"), "path", F.col("hash").alias("subroot"), "root"
    )
    paths = tree.paths(stored(above, "above"))
    return paths.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", "tampered")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document; every fifth by hash is tampered with
    and must fold to another root, unless its text has no capital letter."""
    docs = table(spark, sf_dir, "documents")
    steps = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    rows = manifest(docs, tampered=tampered_leaf(docs))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(_joined(steps), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 6, source_levels: int = 3) -> str:
    def tree(name: str, depth: int) -> str:
        steps = []
        for i in range(depth):
            steps.append(
                f"{name}_run{i} AS (SELECT grp, idx // {ARITY} AS run, total, list(h ORDER BY idx) AS hs "
                f"FROM {name}{i} GROUP BY grp, idx // {ARITY}, total), "
                f"{name}{i + 1} AS (SELECT grp, run AS idx, total, CASE WHEN total > {ARITY**i} "
                f"THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_run{i})"
            )
        return ", ".join(steps)

    def climb(name: str, depth: int, grp: str, idx: str, total: str, start: str) -> tuple[str, str]:
        steps, last = [], start
        for i in range(depth):
            slot = f"({idx} // {ARITY**i} % {ARITY})"
            ahead = f"array_to_string(r.hs[1:{slot}], '')"
            behind = f"array_to_string(r.hs[{slot} + 2:], '')"
            steps.append(
                f"{name}_up{i} AS (SELECT d.* EXCLUDE (folded, proof), d.proof || {ahead} || {behind} AS proof, "
                f"CASE WHEN {total} > {ARITY**i} THEN sha256({ahead} || d.folded || {behind}) "
                f"ELSE d.folded END AS folded FROM {last} d JOIN {name}_run{i} r "
                f"ON r.grp = {grp} AND r.run = {idx} // {ARITY ** (i + 1)})"
            )
            last = f"{name}_up{i}"
        return ", ".join(steps), last

    def leaf(text: str) -> str:
        values = [*FIELDS[:-1], text]
        parts = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values]
        return f"sha256({' || '.join(parts)})"

    # crc32 of a number's digits: the low bit decides about the polynomial, eight times a byte.
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    )
    up, last = climb("node", levels, "d.grp", "d.idx", "d.total", "docs")
    across, end = climb("top", source_levels, "0", "d.source_idx", "d.sources", "joined")
    return f"""
WITH raw AS (
  SELECT *, coalesce('s' || source, '') AS grp, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered
  FROM documents
), docs AS MATERIALIZED (
  SELECT doc_id, grp, leaf, coalesce(tampered, leaf) AS folded, '' AS proof,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS total
  FROM raw
), node0 AS (SELECT grp, idx, total, leaf AS h FROM docs), {tree("node", levels)}
, top0 AS (
  SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS total, h, grp AS source
  FROM node{levels}
), {tree("top", source_levels)}, {up}
, joined AS (
  SELECT d.*, t.h AS subroot, t.idx AS source_idx, t.total AS sources FROM {last} d JOIN top0 t ON t.source = d.grp
), {across}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = r.h AS verified
FROM {end} CROSS JOIN top{source_levels} r
"""  # noqa: S608


OP12_SQL = _sql()
