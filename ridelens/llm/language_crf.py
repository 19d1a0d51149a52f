"""Language of words and documents by a linear-chain conditional random field.

Each word is a step of the chain and its label a language. A word's features are its
affixes, its character n-grams with word ends, and whether it is in the lexicon of a
language; the transitions between languages are learned with the feature weights. The
marginals of forward-backward label every word, also in text that switches language,
and their sum over the words decides the document.

Long texts do not mean long loops: the chain is cut into blocks, the transfer matrices
of all blocks are multiplied side by side, and the blocks are then linked exactly.
"""

from __future__ import annotations

import io
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ridelens.llm.tables import held_out, stored, table

#: Most documents per language that training reads, drawn by a hash of their id.
DOCS_PER_LANGUAGE = 500
#: Sequences built from them, and words in each.
SEQUENCES, SEQUENCE_WORDS = 12_000, 32
#: Chance that the training text changes its language after a word.
SWITCH = 0.05
#: Words of a language's lexicon.
LEXICON = 1500
#: Most languages one model tells apart.
MOST_LANGUAGES = 500
BITS = 15
EPOCHS, BATCH, STEP, PENALTY = 3, 256, 0.3, 1e-5
UNKNOWN = "und"
SEED = "language-1"
#: Words are runs of letters; a longer run is cut into words of this many letters.
LONGEST = 32
BLOCK = 32
WORDS_AT_ONCE = 300_000
_MOST_CACHED = 500_000


def _number_signs() -> str:
    """Signs such as superscripts and fractions: alphanumeric, neither letters nor digits,
    as ranges of a character class."""
    signs = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not (c.isalpha() or c.isdecimal())]
    ranges, start = [], 0
    for i in range(1, len(signs) + 1):
        if i == len(signs) or ord(signs[i]) != ord(signs[i - 1]) + 1:
            ranges.append(f"{signs[start]}-{signs[i - 1]}")
            start = i
    return "".join(ranges)


_WORD = re.compile(rf"[^\W\d_{_number_signs()}]{{1,{LONGEST}}}")
_START, _END = 2, 3


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _bucket(kind: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(columns[0].shape, kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


def features_of_length(words: list[str], length: int) -> np.ndarray:
    """Hashed features, a row per word of this length: bigrams and trigrams with both
    word ends, prefixes and suffixes of one to three letters."""
    codes = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)
    c = np.empty((len(words), length + 2), np.uint64)
    c[:, 0], c[:, 1:-1], c[:, -1] = _START, codes, _END
    parts = [_bucket(1, c[:, :-1], c[:, 1:]), _bucket(2, c[:, :-2], c[:, 1:-1], c[:, 2:])]
    for n in range(1, min(3, length) + 1):
        parts.append(_bucket(2 + n, *(c[:, i : i + 1] for i in range(1, n + 1))))
        parts.append(_bucket(5 + n, *(c[:, -1 - i : -i] for i in range(1, n + 1))))
    return np.concatenate(parts, axis=1).astype(np.int64)


class Model:
    """Languages, feature weights (buckets, then one row per lexicon), transitions."""

    def __init__(
        self, languages: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, list[int]]
    ):
        self.languages, self.weights, self.moves, self.lexicon = languages, weights, moves, lexicon

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        text = json.dumps({"languages": self.languages, "lexicon": self.lexicon})
        np.savez(out, weights=self.weights, moves=self.moves, text=np.array(text))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        text = json.loads(str(held["text"]))
        return cls(text["languages"], held["weights"], held["moves"], text["lexicon"])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word, a column per language."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            index = features_of_length([words[i] for i in at], length)
            out[at] = self.weights[index].sum(axis=1)
        first = len(self.weights) - len(self.languages)
        for i, word in enumerate(words):
            for language in self.lexicon.get(word, ()):
                out[i] += self.weights[first + language]
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(log_emissions: np.ndarray, lengths: list[int], moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of several texts that lie one after the other.

    Forward-backward, exact for any length: transfer matrices of blocks of ``BLOCK``
    words first, then the vectors at the block ends, then the words inside the blocks.
    """
    labels = moves.shape[0]
    step = np.exp(moves - moves.max()).astype(np.float64)
    sizes = [n for n in lengths if n]
    if not sizes:
        return np.zeros((0, labels))
    per_text = [-(-n // BLOCK) for n in sizes]
    blocks = sum(per_text)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    start = np.repeat(first * BLOCK - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    slot = np.arange(len(start)) + start
    power = np.ones((blocks * BLOCK, labels))
    power[slot] = np.exp(log_emissions - log_emissions.max(axis=1, keepdims=True))
    power = power.reshape(blocks, BLOCK, labels)
    real = np.zeros(blocks * BLOCK, bool)
    real[slot] = True
    real = real.reshape(blocks, BLOCK)

    across = np.tile(np.eye(labels), (blocks, 1, 1))
    for t in range(BLOCK):
        moved = (across.reshape(-1, labels) @ step).reshape(across.shape) * power[:, t, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        across = np.where(real[:, t, None, None], moved, across)
    enter = np.full((blocks, labels), 1 / labels)
    leave = np.full((blocks, labels), 1.0)
    counts = np.array(per_text)
    for k in range(1, int(counts.max())):
        at = first[counts > k] + k
        enter[at] = _normal(np.einsum("bi,bij->bj", enter[at - 1], across[at - 1]))
    for k in range(int(counts.max()) - 1, 0, -1):
        at = first[counts > k] + k
        leave[at - 1] = _normal(np.einsum("bij,bj->bi", across[at], leave[at]))
    forward = np.empty_like(power)
    for t in range(BLOCK):
        moved = _normal((enter @ step) * power[:, t])
        enter = np.where(real[:, t, None], moved, enter)
        forward[:, t] = enter
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= leave
        moved = _normal((power[:, t] * leave) @ step.T)
        leave = np.where(real[:, t, None], moved, leave)
    return _normal(forward.reshape(-1, labels)[slot])


def _training_text(
    streams: list[list[str]], rng: np.random.Generator
) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of words that change their language now and then, with their labels."""
    labels = len(streams)
    now = rng.integers(labels, size=SEQUENCES)
    tags = np.empty((SEQUENCES, SEQUENCE_WORDS), np.int64)
    for t in range(SEQUENCE_WORDS):
        tags[:, t] = now
        change = rng.random(SEQUENCES) < SWITCH
        now = np.where(change, rng.integers(labels, size=SEQUENCES), now)
    read = [0] * labels
    rows = []
    for tagged in tags.tolist():
        row = []
        for tag in tagged:
            row.append(streams[tag][read[tag] % len(streams[tag])])
            read[tag] += 1
        rows.append(row)
    return rows, tags


def _in_turn(documents: list[list[str]]) -> list[str]:
    """The words of all documents, a window of each in turn, so that none crowds out others."""
    longest = max(map(len, documents))
    return [
        word
        for start in range(0, longest, SEQUENCE_WORDS)
        for document in documents
        for word in document[start : start + SEQUENCE_WORDS]
    ]


def fit(texts: list[str | None], languages: list[str]) -> Model:
    """A model from texts and the language of each; texts without letters do not count.

    All words count for the lexicon. The weights are trained on ``SEQUENCES`` times
    ``SEQUENCE_WORDS`` words, the languages alike, read from windows of all texts in turn:
    every text gives its first window before any gives a second one.
    """
    by_language: dict[str, list[list[str]]] = {}
    for text, language in zip(texts, languages, strict=True):
        found = words_of(text)
        if found:
            by_language.setdefault(language, []).append(found)
    streams = {name: _in_turn(documents) for name, documents in by_language.items()}
    names = sorted(streams)
    labels = max(1, len(names))
    lexicon: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        ranked = sorted(Counter(streams[name]).items(), key=lambda x: (-x[1], x[0]))
        for word, _ in ranked[:LEXICON]:
            lexicon.setdefault(word, []).append(i)
    model = Model(
        names or [UNKNOWN],
        np.zeros(((1 << BITS) + labels, labels)),
        np.zeros((labels, labels)),
        lexicon,
    )
    if len(names) < 2:
        return model
    rng = np.random.default_rng(7)
    rows, tags = _training_text([streams[n] for n in names], rng)
    vocabulary = sorted({w for row in rows for w in row})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([[number[w] for w in row] for row in rows])
    held: list[list[int]] = [[] for _ in vocabulary]
    lengths = np.array([len(w) for w in vocabulary])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        for i, f in zip(at.tolist(), features_of_length([vocabulary[j] for j in at], length).tolist(), strict=True):
            held[i] = f + [(1 << BITS) + k for k in lexicon.get(vocabulary[i], ())]
    sizes = np.array([len(f) for f in held])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([np.array(f) for f in held])
    w, moves = model.weights, model.moves
    w_sum, m_sum = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at : at + BATCH]
            batch, gold = ids[chosen], tags[chosen]
            used, back = np.unique(batch, return_inverse=True)
            n = sizes[used]
            offsets = np.concatenate([[0], np.cumsum(n)[:-1]])
            feats = flat[np.repeat(starts[used] - offsets, n) + np.arange(n.sum())]
            emission = np.add.reduceat(w[feats], offsets)[back.reshape(batch.shape)]
            residual, pair = _residuals(emission, gold, moves)
            per_word = np.zeros((len(used), labels))
            np.add.at(per_word, back.reshape(-1), residual.reshape(-1, labels))
            spread = np.repeat(per_word, n, axis=0)
            rows_used, where = np.unique(feats, return_inverse=True)
            grad = np.stack(
                [np.bincount(where, spread[:, k], len(rows_used)) for k in range(labels)], axis=1
            ) / len(chosen) + PENALTY * w[rows_used]
            w_sum[rows_used] += grad * grad
            w[rows_used] -= STEP * grad / np.sqrt(w_sum[rows_used])
            grad = pair / len(chosen)
            m_sum += grad * grad
            moves -= STEP * grad / np.sqrt(m_sum)
    model.weights = w.astype(np.float32)
    return model


def _residuals(
    emission: np.ndarray, gold: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Expected less observed label counts of each word, and of all moves."""
    rows, steps, labels = emission.shape
    step = np.exp(moves - moves.max())
    power = np.exp(emission - emission.max(axis=2, keepdims=True))
    forward = np.empty_like(power)
    before = np.full((rows, labels), 1 / labels)
    entered = []
    for t in range(steps):
        entered.append(before)
        before = _normal((before @ step) * power[:, t])
        forward[:, t] = before
    after = np.ones((rows, labels))
    pair = np.zeros_like(moves)
    residual = np.empty_like(power)
    one = np.eye(labels)
    for t in range(steps - 1, -1, -1):
        residual[:, t] = _normal(forward[:, t] * after) - one[gold[:, t]]
        right = power[:, t] * after
        joint = entered[t][:, :, None] * step[None] * right[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        if t:
            pair -= np.bincount(gold[:, t - 1] * labels + gold[:, t], minlength=labels**2).reshape(
                labels, labels
            )
        else:  # the start is any language alike
            pair -= np.bincount(gold[:, 0], minlength=labels)[None] / labels
        after = _normal(right @ step.T)
    return residual, pair


class Labeller:
    """Word emissions of a model with a bounded cache, and chains over batches of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > _MOST_CACHED:
            self.known = {}
            self.rows = self.rows[:0]
        fresh = list({w for words in texts for w in words if w not in self.known})
        self.known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
        self.rows = np.concatenate([self.rows, self.model.emissions(fresh)])
        total = sum(map(len, texts))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, total)
        return marginals(self.rows[index], [len(words) for words in texts], self.model.moves)

    def documents(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """(language, its share of the letters' probability) of each text."""
        chances, at, out = self.probabilities(texts), 0, []
        for words in texts:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            size = np.fromiter(map(len, words), np.float64, len(words))
            share = size @ chances[at : at + len(words)] / size.sum()
            best = int(share.argmax())
            out.append((self.model.languages[best], float(min(1.0, share[best]))))
            at += len(words)
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of equally labelled words of one text."""
        found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer((text or "").lower())]
        if not found:
            return []
        best = self.probabilities([[w for _, _, w in found]]).argmax(axis=1).tolist()
        out: list[tuple[int, int, str]] = []
        for (start, end, _), label in zip(found, best, strict=True):
            language = self.model.languages[label]
            if out and out[-1][2] == language:
                out[-1] = (out[-1][0], end, language)
            else:
                out.append((start, end, language))
        return out


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Model:
    """A model from documents that are not held out and have a language.

    Reads at most ``docs_per_language`` documents of each language, those with the
    smallest hashes of their id, in one task, and trains weights on 384,000 words of
    windows from all of them in turn: neither grows with the corpus. More than
    ``MOST_LANGUAGES`` languages are refused. Without any labelled document the model
    knows only the unknown language.
    """
    keyed = docs.select(
        docs[id_col].alias("_id"), docs[lang_col].cast("string").alias("_lang"), docs[text_col].cast("string").alias("_text")
    ).filter(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    order = F.xxhash64(F.lit(SEED), F.col("_id"))
    # Only ids below a bound of the hash are ranked, about four times as many as are drawn,
    # so the rows that meet per language do not grow with the tasks. The counts are stored:
    # their size is known when they are joined.
    counts = stored(keyed.groupBy("_lang").agg(F.count("*").alias("_rows")), "languages")
    most = counts.count()
    if most > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: {most}")
    share = order.cast("double") / 2.0**64 + 0.5
    near = keyed.select("_id", "_lang").join(counts, "_lang").filter(
        share * F.col("_rows") < 4.0 * docs_per_language + 100
    )
    # Spark keeps the first rows of each language in every task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(order, "_id"))
    drawn = (
        near.select("_id", "_lang")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= docs_per_language)
        .select(F.col("_id").alias("_drawn"), F.col("_lang").alias("_drawn_lang"))
    )
    # At most `docs_per_language` ids of each of `MOST_LANGUAGES` languages.
    sample = keyed.join(
        F.broadcast(drawn), (F.col("_id") == F.col("_drawn")) & (F.col("_lang") == F.col("_drawn_lang"))
    )

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "_id"])
        model = fit(part["_text"].tolist(), part["_lang"].tolist())
        return pd.DataFrame({"model": [model.to_bytes()]})

    made = (
        sample.select("_id", "_lang", "_text", order.alias("_order"), F.lit(1).alias("_one"))
        .groupBy("_one")
        .applyInPandas(learn, "model binary")
        .collect()
    )
    return Model.from_bytes(made[0].model) if made else fit([], [])


def predict(
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_spans: bool = False,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, from its whole text alone.

    A text that is null or has no letters is ``und`` with score 0. Ties go to the first
    language by name. ``with_spans`` adds the runs of words of one language with their
    places in the lower-cased text. The id may be null (held out) or repeated; other
    columns are not read. Empty in, empty out.
    """
    fields = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    if with_spans:
        of = T.StructType.fromDDL("start long, end long, lang string")
        fields.add("spans", T.ArrayType(of))
    data = model.to_bytes()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model.from_bytes(data))
        for batch in batches:
            texts, results, spans = batch.column("text"), [], []
            part, size = [], 0
            for value in texts:
                text = value.as_py()
                part.append(words_of(text))
                size += len(part[-1])
                if with_spans:
                    runs = labeller.spans(text)
                    spans.append([{"start": a, "end": b, "lang": c} for a, b, c in runs])
                if size >= WORDS_AT_ONCE:
                    results += labeller.documents(part)
                    part, size = [], 0
            results += labeller.documents(part)
            columns = [
                batch.column("id"),
                batch.column("held_out"),
                pa.array([r[0] for r in results], pa.string()),
                pa.array([r[1] for r in results], pa.float64()),
            ]
            columns += [pa.array(spans, pa.list_(span))] if with_spans else []
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    slim = docs.select(
        docs[id_col].alias("id"),
        held_out(docs[id_col]).alias("held_out"),
        docs[text_col].cast("string").alias("text"),
    )
    return slim.mapInArrow(label, fields)


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
