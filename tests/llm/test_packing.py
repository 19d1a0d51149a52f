import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer

from ridelens.llm.packing import closest_fill, pack, pack_documents, plan_windows, sequences, token_pieces
from ridelens.llm.tables import stored
from ridelens.llm.word_tokens import WordEncoder


def reachable(counts, capacity):
    fills = {0}
    for length, n in counts.items():
        for _ in range(n):
            fills |= {f + length for f in fills if f + length <= capacity}
    return max(fills)


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_closest_there_is(seed):
    rng = random.Random(seed)
    capacity = rng.randint(1, 60)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
    chosen = closest_fill(counts, capacity)
    assert all(c <= counts[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == reachable(counts, capacity)


def test_plan_uses_each_piece_once_and_stays_small():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    plan = plan_windows(counts, 2048)
    used: dict[int, int] = {}
    for chosen, times in plan:
        assert sum(n * c for n, c in chosen.items()) <= 2048
        for n, c in chosen.items():
            used[n] = used.get(n, 0) + c * times
    assert used == counts
    assert len(plan) < 20_000


def check(rows, window):
    by_sequence: dict[int, list] = {}
    for r in rows:
        assert 1 <= r.length <= window
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip_on_odd_rows(spark, window):
    rows = pack_documents(odd_documents(spark), window).collect()
    check(rows, window)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for cut in range(0, len(ids), window):
            piece = ids[cut : cut + window]
            crc = zlib.crc32(np.array(piece, "<u4").tobytes())
            want.append((doc_id, cut, len(piece), crc, len(ids)))
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sequences_hold_the_ids_and_pad(spark):
    pieces = stored(token_pieces(odd_documents(spark), window=64, with_ids=True), "t")
    for r in sequences(pack(pieces, 64), 64).collect():
        assert len(r.ids) == (r.used if r.used & (r.used - 1) == 0 else 64)


@pytest.mark.parametrize("seed", range(5))
def test_word_cache_gives_the_librarys_ids(seed):
    rng = random.Random(seed)
    alphabet = "abcXYZ éßÄİſǅ'_.,!?&123²½ \t\n\x1c  日本́<|>s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["it's we'll ''s <|endoftext|> x", "'S 'LL can't", "ΑΣ ς"]
    own = WordEncoder("word_bpe_49k.json", cached_words=50)
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        for text, raw in zip(part, own.encode_all(part), strict=True):
            want = own.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == want, text


def test_empty(spark):
    assert pack_documents(no_documents(spark)).collect() == []
