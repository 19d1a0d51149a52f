import itertools
import math

import numpy as np
import pytest
from helpers import no_documents, odd_documents, odd_rows

from ridelens.llm.language_crf import UNKNOWN, Labeller, Model, _residuals, fit, marginals, predict, train, words_of
from ridelens.llm.tables import table

EN = "the and with from this that which there other house water after night"
DE = "der und mit von dieser das welche dort andere wasser nach nacht straße"


def by_enumeration(emission, moves):
    n, labels = emission.shape
    chances = np.zeros((n, labels))
    for path in itertools.product(range(labels), repeat=n):
        score = math.exp(sum(emission[t, s] for t, s in enumerate(path)))
        score *= sum(math.exp(moves[s, path[0]]) for s in range(labels)) / labels
        score *= math.exp(sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for t, s in enumerate(path):
            chances[t, s] += score
    return chances / chances.sum(axis=1, keepdims=True)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(3, 3))
    parts = [rng.normal(size=(n, 3)) for n in (5, 1, 7)]
    got = marginals(np.concatenate(parts), [5, 0, 1, 7], moves)
    assert np.allclose(got, np.concatenate([by_enumeration(p, moves) for p in parts]))


def test_blocks_change_nothing():
    rng = np.random.default_rng(1)
    emission, moves = rng.normal(size=(333, 4)) * 3, rng.normal(size=(4, 4))
    alpha, forward = np.full(4, 0.25), []
    for e in emission:
        alpha = (alpha @ np.exp(moves)) * np.exp(e)
        alpha /= alpha.sum()
        forward.append(alpha)
    beta, want = np.ones(4), [None] * 333
    for t in range(332, -1, -1):
        want[t] = forward[t] * beta / (forward[t] * beta).sum()
        beta = np.exp(moves) @ (np.exp(emission[t]) * beta)
        beta /= beta.sum()
    assert np.allclose(marginals(emission, [333], moves), want)


def test_gradient_of_moves_and_emissions():
    rng = np.random.default_rng(2)
    emission, moves, gold = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(3, size=(2, 4))

    def loss(emission, moves):
        total = 0.0
        for e, g in zip(emission, gold, strict=True):
            alpha = np.full(3, 1 / 3)
            for x in e:
                alpha = (alpha @ np.exp(moves)) * np.exp(x)
            total += math.log(alpha.sum()) - sum(e[t, s] for t, s in enumerate(g))
            total -= sum(moves[a, b] for a, b in itertools.pairwise(g)) + moves[:, g[0]].mean()
        return total

    residual, pair = _residuals(emission, gold, moves)
    for grad, x in ((residual, emission), (pair, moves)):
        for at in itertools.islice(np.ndindex(x.shape), 9):
            x[at] += 1e-6
            up = loss(emission, moves)
            x[at] -= 2e-6
            down = loss(emission, moves)
            x[at] += 1e-6
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


@pytest.fixture(scope="module")
def small_model():
    return fit([EN, DE] * 20, ["en", "de"] * 20)


def test_switched_text_is_labelled_by_word(small_model):
    text = "the house with water und dieser straße nach nacht from that night"
    spans = Labeller(Model.from_bytes(small_model.to_bytes())).spans(text)
    assert [s[2] for s in spans] == ["en", "de", "en"]
    assert text[spans[1][0] : spans[1][1]] == "und dieser straße nach nacht"


def test_odd_rows(spark, small_model):
    rows = predict(odd_documents(spark), small_model, with_spans=True).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", UNKNOWN)
        assert (r.lang_pred == UNKNOWN) == (r.doc_id in (4, 5, 6, 11)) == (r.spans == [])
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 12)} == {"en"}


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs, train(docs)).join(docs, "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_empty(spark, small_model):
    assert predict(no_documents(spark), small_model).collect() == []
    assert train(no_documents(spark)).languages == [UNKNOWN]


@pytest.mark.parametrize("text", ["²", "½ ①", "12 34", "___", "Ⅷ ٣ 五"[:4]])
def test_number_signs_are_no_letters(text):
    assert words_of(text) == []


def test_words_end_at_number_signs():
    assert words_of("Ärger² x½y m③") == ["ärger", "x", "y", "m"]


def test_training_words_come_from_all_documents_in_turn():
    from ridelens.llm.language_crf import SEQUENCE_WORDS, _in_turn

    long, short = ["l"] * 1000, ["s"] * 5
    words = _in_turn([long, short, short])
    assert len(words) == 1010
    assert words[: SEQUENCE_WORDS + 10].count("s") == 10
