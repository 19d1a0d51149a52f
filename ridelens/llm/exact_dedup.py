"""Exact duplicates by skew-safe combining, with DataFrame operations only.

Three stages, each grouping by digest and full content, so unequal texts never meet
even if their digests do:

1. local: each task combines the copies it has read (Spark's partial aggregation);
2. salted: copies of a text meet per salt, the reading task's number modulo ``salts``;
3. global: one row per text and salt is left, and these are combined.

A group of any size thus reaches the last stage with at most ``salts`` rows. The
winner's length and id travel as one decimal, which keeps the aggregation in hash
tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.tables import stored, table

SALTS = 16
#: Characters that do not count: space, tab, line feed, vertical tab, form feed, return.
IGNORED = " \t\n\x0b\x0c\r"
_ID_SPAN = Decimal(2**65)
_ID_TOP = Decimal(2**63)


def normalised(text: Column) -> Column:
    """The text without space characters; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for character in IGNORED:
        out = F.replace(out, F.lit(character))
    return out


def _rank(chars: Column, doc_id: Column) -> Column:
    """Longer first, then the smaller id; a missing id comes last."""
    low = F.coalesce(F.lit(_ID_TOP) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (chars.cast("decimal(10,0)") * F.lit(_ID_SPAN) + low).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    low = (rank % F.lit(_ID_SPAN)).cast("decimal(21,0)")
    return F.when(low != 0, (F.lit(_ID_TOP) - low).cast("bigint"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.char_length(text).alias("_chars"),
        normalised(docs[text_col]).alias("_content"),
    )
    return rows.withColumns(
        {"text_sha256": F.sha2("_content", 256), "_second": F.xxhash64("_content")}
    )


def group_winners(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """(text_sha256, _second, keep_id, group_size), one row per different text."""
    rows = _keyed(docs, id_col, text_col).select(
        "text_sha256",
        "_second",
        "_content",
        (F.spark_partition_id() % salts).alias("_salt"),
        _rank(F.col("_chars"), F.col("doc_id")).alias("_rank"),
    )
    content = ["text_sha256", "_second", "_content"]
    salted = rows.groupBy(*content, "_salt").agg(
        F.max("_rank").alias("_rank"), F.count("*").alias("_rows")
    )
    return (
        salted.groupBy(*content)
        .agg(F.max("_rank").alias("_rank"), F.sum("_rows").alias("group_size"))
        .select("text_sha256", "_second", _id_of(F.col("_rank")).alias("keep_id"), "group_size")
    )


def exact_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """Every document with the one that stays of its group.

    Texts are equal if identical without space characters; null counts as empty, and
    a text of nothing but space equals it. Of equal texts the one with the most code
    points stays, then the smallest id; a missing id loses every tie. Returns doc_id,
    keep_id, group_size, kept and text_sha256 for each row; rows that repeat an id and
    a text count in the group and share ``kept``. Other columns are not read. Empty
    in, empty out.

    Only groups of two or more are joined back; their side has one row per group.
    """
    winners = group_winners(docs, id_col=id_col, text_col=text_col, salts=salts)
    members = _keyed(docs, id_col, text_col).select("doc_id", "text_sha256", "_second")
    copies = winners.filter("group_size > 1").withColumn("_grouped", F.lit(True))
    keep = F.when(F.col("_grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return members.join(copies, ["text_sha256", "_second"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _digested(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the digest of the normalised text, and the name of that column."""
    name = "_sha256"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    return docs.withColumn(name, F.sha2(normalised(docs[text_col]), 256)), name


def _same(docs: DataFrame, digest: str, other: DataFrame, id_col: str) -> Column:
    return docs[id_col].cast("bigint").eqNullSafe(other["_doc"]) & (docs[digest] == other["_digest"])


def without_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that stay, with all their columns. Documents are told apart by id
    and normalised text, null-safe; rows that repeat both stay or go together."""
    rows, digest = _digested(docs, text_col)
    lost = exact_duplicates(docs, id_col=id_col, text_col=text_col).filter(~F.col("kept"))
    lost = lost.select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_digest"))
    return rows.join(lost, _same(rows, digest, lost, id_col), "left_anti").select(*docs.columns)


def one_of_each_text(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each text, with all its columns: ``without_duplicates``, and of rows that
    repeat an id and a text only the one with the longest spelling.

    Ids that lose all their rows go by id alone, so that side of the join stays small.
    Digests are joined only for ids that repeat, combined with partial aggregation.
    Ids, digests and what stays are written to the shared folder first.
    """
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col)
    verdicts = stored(
        found.select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_digest"), "kept"), "verdicts"
    )
    ids = verdicts.groupBy("_doc").agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    gone = stored(ids.filter(~F.col("_kept")).select("_doc"), "gone")
    several = stored(ids.filter(F.col("_kept") & (F.col("_rows") > 1)).select("_doc"), "several")

    def of(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return rows.join(other, rows[id_col].cast("bigint").eqNullSafe(other["_doc"]), how)

    if several.isEmpty():
        return of(docs, gone, "left_anti")
    single = of(of(docs, gone, "left_anti"), several, "left_anti")
    rows, digest = _digested(docs, text_col)
    lost = verdicts.filter(~F.col("kept"))
    again = of(rows, several, "left_semi").join(lost, _same(rows, digest, lost, id_col), "left_anti")
    text = F.coalesce(again[text_col].cast("string"), F.lit(""))
    whole = F.struct(*[again[c] for c in docs.columns])
    # The spelling and the other columns decide between rows of equal length.
    order = F.struct(F.char_length(text), text, F.to_json(whole))
    combined = again.groupBy(again[id_col].cast("bigint").alias("_doc"), again[digest]).agg(
        F.max_by(whole, order).alias("_row")
    )
    return single.unionByName(combined.select("_row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), w AS (
  SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM w
"""
