"""Mix sources to target weights by iterative proportional fitting, DataFrame only.

Documents fall into cells of source, language and topic. Token counts per cell are
raked to the wanted totals of each of the three marginals in turn, and a cell's share
of tokens to keep becomes the probability that one of its documents is kept. Raking
works on the cells, which are counted with partial aggregation first: a source with a
third of all rows is a few counted cells. Cells that one task holds are raked there without
a shuffle; of more, the totals of a marginal are grouped sums that are joined back to the
cells, so a language that most cells have is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelens.llm.tables import stored, table

#: Share of all tokens that the mix keeps.
KEEP = 0.5
#: Raking ends with the first round that moves at most this share of all tokens,
TOLERANCE = 1e-4
#: or after so many rounds over the three marginals.
ROUNDS = 100
#: Cells that one task of a round takes.
CELLS_PER_TASK = 50_000
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
_TOKEN = r"[^ \t\n\x0B\f\r]+"  # noqa: S105


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_TOKEN)).cast("bigint")


def topic_of(text: Column) -> Column:
    """What a text is about, as far as its form tells: the first cue that it shows."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.contains(t, F.lit("://")), "links")
        .when(F.length(t) >= 4000, "long prose")
        .when(F.length(t) >= 1000, "prose")
        .otherwise("note")
    )


def sampling_point(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that only the id and the seed decide."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def rake(
    cells: DataFrame,
    *,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    targets: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``_mix_probability``.

    Wanted totals per marginal: shares of ``keep`` times all tokens, in proportion to
    the square root of the tokens that a value has, or to ``targets[dimension]`` where
    given (values it leaves out want nothing). After each round no cell wants more
    than it has; what is cut there goes to the other cells in the next round. Rounds end
    when one moves at most ``tolerance`` of all tokens, or after ``rounds``; each is
    written to the shared folder. A marginal that cannot be met with the tokens there are
    is met as far as it goes, which ``residuals`` shows.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    tokens = F.col("tokens").cast("double")
    state = cells.withColumn("_w", tokens * keep)
    for d in DIMENSIONS:
        wish = (targets or {}).get(d)
        if wish is None:
            want = F.sqrt(F.col("_has").cast("double"))
        else:
            want = F.lit(0.0)
            for value, share in wish.items():
                want = F.when(F.col("_value") == value, F.lit(float(share))).otherwise(want)
        values = cells.groupBy(F.col(d).alias("_value")).agg(F.sum("tokens").alias("_has"))
        values = values.select("_value", want.alias("_wish"))
        wishes = values.agg(F.sum("_wish")).scalar()
        scaled = F.try_divide(F.col("_wish"), wishes) * total * keep
        values = values.select("_value", scaled.alias(f"_want_{d}"))
        state = state.join(values, F.col(d).eqNullSafe(F.col("_value"))).drop("_value")
    state = stored(state, "raked")
    # Tasks by the number of cells: those that one task holds are raked without any shuffle.
    tasks = max(1, math.ceil(state.count() / CELLS_PER_TASK))
    if tasks == 1:
        state = state.withColumn(_FEW, F.lit(True))
    for _ in range(rounds):
        state = stored(_raked_once(state.coalesce(tasks)), "raked")
        moved = state.agg(F.sum(F.abs(F.col("_w") - F.col("_before")))).first()[0]
        if not moved or moved <= tolerance * total:
            break
    share = F.coalesce(F.try_divide(F.col("_w"), tokens), F.lit(keep))
    return state.select(*cells.columns, F.round(share, 6).alias("_mix_probability"))


# A column that only cells of one task have.
_FEW = "_few"


def _raked_once(state: DataFrame) -> DataFrame:
    """One round: the weights ``_w`` scaled to each marginal in turn, then cut to the tokens."""
    state = state.withColumn("_before", F.col("_w"))
    for d in DIMENSIONS:
        if _FEW in state.columns:
            now = F.sum("_w").over(Window.partitionBy(d))
            scaled = F.try_divide(F.col("_w") * F.col(f"_want_{d}"), now)
            state = state.withColumn("_w", F.coalesce(scaled, F.lit(0.0)))
            continue
        sums = state.groupBy(F.col(d).alias("_value")).agg(F.sum("_w").alias("_now"))
        scaled = F.try_divide(F.col("_w") * F.col(f"_want_{d}"), F.col("_now"))
        state = (
            state.join(sums, F.col(d).eqNullSafe(F.col("_value")))
            .withColumn("_w", F.coalesce(scaled, F.lit(0.0)))
            .drop("_value", "_now")
        )
    return state.withColumn("_w", F.least("_w", F.col("tokens").cast("double")))


_OUT = ("source", "lang", "topic", "tokens", "probability", "kept")


def _with_cells(docs: DataFrame, topic: Column | None) -> tuple[DataFrame, str]:
    """``docs`` with the cell of each row, and the prefix of the new columns' names, which
    no column of ``docs`` begins with."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix

    def value(name: str) -> Column:
        return F.coalesce(docs[name].cast("string"), F.lit(""))

    about = topic_of(docs["text"]) if topic is None else topic
    rows = docs.select(
        *[docs[c] for c in docs.columns],
        value("source").alias(prefix + "source"),
        value("lang").alias(prefix + "lang"),
        F.coalesce(about, F.lit("")).alias(prefix + "topic"),
        token_count(docs["text"]).alias(prefix + "tokens"),
    )
    return rows, prefix


def _mixed(
    docs: DataFrame,
    *,
    topic: Column | None = None,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    seed: str = SEED,
    targets: Mapping[str, Mapping[str, float]] | None = None,
) -> tuple[DataFrame, str]:
    rows, prefix = _with_cells(docs, topic)
    cells = rows.groupBy(*[F.col(prefix + d).alias(d) for d in DIMENSIONS]).agg(
        F.sum(prefix + "tokens").alias("tokens")
    )
    cells = stored(cells, "cells")
    chances = rake(cells, keep=keep, rounds=rounds, tolerance=tolerance, targets=targets).select(
        *[F.col(d).alias(prefix + d) for d in DIMENSIONS],
        F.col("_mix_probability").alias(prefix + "probability"),
    )
    joined = rows.join(chances, [prefix + d for d in DIMENSIONS])
    point = sampling_point(docs["doc_id"], seed)
    return joined.withColumn(prefix + "kept", point < F.col(prefix + "probability")), prefix


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with _mix_source, _mix_lang, _mix_topic, _mix_tokens, _mix_probability and
    _mix_kept. Options: topic, keep, rounds, tolerance, seed, targets.

    Reads doc_id, text, source and lang; ``topic`` is any column expression, by default
    ``topic_of`` the text. A null source or language counts as the empty one, a null
    text as empty. A cell without tokens keeps its documents with probability ``keep``.
    Rows that repeat an id share their fate; a null id is sampled like an id of no
    characters. Columns that have one of the six names are replaced, all others stay.
    Empty in, empty out. The cell table is written to the shared folder, so its size is
    known when Spark chooses the join back.
    """
    joined, prefix = _mixed(docs, **options)
    names = [f"_mix_{n}" for n in _OUT]
    others = [c for c in docs.columns if c.lower() not in names]
    return joined.select(*others, *[F.col(prefix + n).alias(f"_mix_{n}") for n in _OUT])


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns as they were."""
    joined, prefix = _mixed(docs, **options)
    return joined.filter(prefix + "kept").select(*docs.columns)


def residuals(mixed: DataFrame, *, keep: float = KEEP) -> DataFrame:
    """(dimension, value, wanted, expected, residual) of what ``mix`` returned, without
    ``targets``: the tokens that each marginal value wants, those that the probabilities
    keep on average, and their difference as a share of what is wanted.

    Raking ends within its tolerance, so a residual well above it shows a marginal that
    wants more than there is.
    """
    cells = stored(
        mixed.groupBy("_mix_source", "_mix_lang", "_mix_topic").agg(
            F.sum("_mix_tokens").cast("double").alias("tokens"),
            F.sum(F.col("_mix_tokens") * F.col("_mix_probability")).alias("expected"),
        ),
        "mixed-cells",
    )
    total, out = cells.agg(F.sum("tokens")).scalar(), None
    for d in DIMENSIONS:
        per_value = cells.groupBy(F.col(f"_mix_{d}").alias("value")).agg(
            F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected")
        )
        wishes = per_value.agg(F.sum(F.sqrt("tokens"))).scalar()
        wanted = F.try_divide(F.sqrt("tokens"), wishes) * total * keep
        gap = F.try_divide(F.abs(F.col("expected") - wanted), wanted)
        part = per_value.select(
            F.lit(d).alias("dimension"), "value", wanted.alias("wanted"), "expected", gap.alias("residual")
        )
        out = part if out is None else out.unionByName(part)
    return out


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select(
        "doc_id",
        F.col("_mix_source").alias("source"),
        F.col("_mix_lang").alias("lang"),
        F.col("_mix_topic").alias("topic"),
        F.col("_mix_tokens").alias("tokens"),
        F.col("_mix_probability").alias("probability"),
        F.col("_mix_kept").alias("kept"),
    )


def _sql() -> str:
    once = f"SELECT * FROM rounds WHERE round < {ROUNDS} AND moved > {TOLERANCE} * total"
    for d in DIMENSIONS:
        once = (
            f"SELECT * REPLACE (coalesce(w * want_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0)"
            f" AS w) FROM ({once})"
        )
    once = f"SELECT * REPLACE (least(tokens, w) AS w) FROM ({once})"
    wants = ", ".join(
        f"sqrt(sum(tokens) OVER (PARTITION BY {d})::DOUBLE) AS has_{d}" for d in DIMENSIONS
    )
    totals = ", ".join(
        f"(SELECT sum(h) FROM (SELECT {d}, any_value(has_{d}) AS h FROM wish GROUP BY {d})) AS all_{d}"
        for d in DIMENSIONS
    )
    scaled = ", ".join(
        f"has_{d} / all_{d} * (SELECT sum(tokens)::DOUBLE FROM cells) * {KEEP} AS want_{d}"
        for d in DIMENSIONS
    )
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
         WHEN contains(coalesce(text, ''), '@') THEN 'contact'
         WHEN contains(coalesce(text, ''), '://') THEN 'links'
         WHEN length(coalesce(text, '')) >= 4000 THEN 'long prose'
         WHEN length(coalesce(text, '')) >= 1000 THEN 'prose' ELSE 'note' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens
  FROM documents
), cells AS (
  SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL
), wish AS (SELECT *, {wants} FROM cells
), sums AS (SELECT *, {totals} FROM wish
), start AS (SELECT source, lang, topic, tokens::DOUBLE AS tokens, {scaled},
    tokens::DOUBLE * {KEEP} AS w FROM sums
), rounds AS (
  SELECT *, w AS before, 0 AS round, 'infinity'::DOUBLE AS moved,
    (SELECT sum(tokens)::DOUBLE FROM cells) AS total FROM start
  UNION ALL
  SELECT * REPLACE (w AS before, round + 1 AS round, sum(abs(w - before)) OVER () AS moved)
  FROM ({once})
), chance AS (
  SELECT source, lang, topic, round(coalesce(w / nullif(tokens, 0), {KEEP}), 6) AS probability
  FROM rounds QUALIFY round = max(round) OVER ()
)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, c.probability,
  ('0x' || substr(md5('{SEED}/' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT
    / 4294967296.0::DOUBLE < c.probability AS kept
FROM docs d JOIN chance c USING (source, lang, topic)
"""  # noqa: S608


OP4_SQL = _sql()
