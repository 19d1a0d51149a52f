"""Token ids of texts from a public word-level byte-pair vocabulary.

The library encodes each distinct word once per worker; repeated words come from a
bounded cache. A text outside the plain Latin range, or with the spelling of a
special token, goes through the library whole, so ids are always the library's own.
"""

from __future__ import annotations

import os
import re

import numpy as np

# The vocabulary's own split into words, for the plain Latin range only.
_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+"
    r"|[\d²³¹¼-¾]|(?:[^\s\w]|_)+"
)
_NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-ɏ]|<\|")
_JOINED = 2000
#: What a remembered string takes besides its characters: two objects and a place in a table.
_ENTRY_BYTES = 200


class WordEncoder:
    """``encode_all(texts)`` gives little-endian unsigned 32-bit ids as bytes.

    Both caches together are emptied after a call that took them past ``cached_bytes`` or
    ``cached_words`` entries, counted while they fill; what one call adds is bounded by the
    text it gets.
    """

    def __init__(
        self, vocabulary: str, cached_bytes: int = 96 << 20, cached_words: int = 1_000_000
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(words.values()) + 1, bool)
        for word, number in words.items():
            self.closes[number] = word.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.cached_bytes = cached_bytes
        self.cached_words = cached_words
        self.held = 0

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode unseen words many at a time; a closing id marks where each ends."""
        self.held += sum(map(len, words)) + (_ENTRY_BYTES + 4) * len(words)
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            ids = np.array(
                self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4"
            )
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                self.words.update((w, self._whole(w)) for w in part)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.words[word] = raw[start:end]
                start = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; call it with a few MB of text at a time."""
        plain = [None if _NOT_PLAIN.search(t) else t.lower().split() for t in texts]
        known = self.chunks
        fresh = {c for chunks in plain if chunks for c in chunks if c not in known}
        split = {c: _WORD.findall(c) for c in fresh}
        self._learn(list({w for ws in split.values() for w in ws if w not in self.words}))
        of = self.words.__getitem__
        known.update((c, b"".join(map(of, ws))) for c, ws in split.items())
        self.held += sum(map(len, fresh)) + (_ENTRY_BYTES + 4) * len(fresh)
        get = known.__getitem__
        out = [
            self._whole(t) if chunks is None else b"".join(map(get, chunks))
            for t, chunks in zip(texts, plain, strict=True)
        ]
        if self.held > self.cached_bytes or len(known) + len(self.words) > self.cached_words:
            self.chunks, self.words, self.held = {}, {}, 0
        return out


#: What the caches of one encoder may hold by default.
CACHED_BYTES = 96 << 20
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(vocabulary: str, cached_bytes: int = CACHED_BYTES) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    key = (vocabulary, cached_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(vocabulary, cached_bytes, 2_000_000)
    return _ENCODERS[key]
