"""Encoding whole texts with a public tokenizer file, fast enough for large corpora.

A byte-level BPE encodes each pre-token on its own, so the ids of a text are the ids of its
pre-tokens in order. Texts made only of characters whose classes are beyond doubt are cut by
the tokenizer's own pattern here and each distinct pre-token is encoded once by the library
and kept in a bounded table; every other text goes to the library whole. Both ways give the
same ids (held against each other in the tests).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: The characters whose letter, digit, space or symbol class all Unicode versions agree on.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*").fullmatch
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The tokenizer's published pre-token pattern, with its classes spelt out for those characters.
_PRETOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{_LETTER}]+|[0-9]+|[^\s{_LETTER}0-9]+)|\s+(?!\S)|\s+").findall

#: Pre-tokens kept by a worker, about 250 MB.
KNOWN_LIMIT = 1_200_000
STEP = 200_000


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. One per worker process: see :func:`encoder`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.by_word = isinstance(pre, ByteLevel) and not pre.add_prefix_space and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.words = Tokenizer.from_file(path)  # for strings that are single pre-tokens already
        if self.by_word:
            self.words.pre_tokenizer, self.words.post_processor = ByteLevel(add_prefix_space=False, use_regex=False), None
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token: one call of the library for all."""
        e = self.words.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(words)), side="right")).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; works through about ``STEP`` characters at a time."""
        out: list[bytes] = []
        step: list[str] = []
        held = 0
        for t in texts:
            step.append(t or "")
            held += len(step[-1])
            if held >= STEP:
                out += self._step(step)
                step, held = [], 0
        return out + self._step(step)

    def _step(self, texts: list[str]) -> list[bytes]:
        cut = [_PRETOKENS(t) if self.by_word and _PLAIN(t) and not self.special(t) else None for t in texts]
        flat = list(chain.from_iterable(c for c in cut if c))
        found = list(map(self.known.get, flat))
        missed = [i for i, ids in enumerate(found) if ids is None]
        if missed:
            new = list({flat[i] for i in missed})
            ids_of = dict(zip(new, self._words(new), strict=True))
            for i in missed:
                found[i] = ids_of[flat[i]]
            if len(self.known) < KNOWN_LIMIT:  # the first words seen are the frequent ones
                self.known.update(ids_of)
        out, at = [], 0
        for t, c in zip(texts, cut, strict=True):
            if c is None:
                out.append(self._whole([t])[0])
            else:
                out.append(b"".join(found[at : at + len(c)]))
                at += len(c)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Free what this worker's encoders hold: workers are used again by stages that encode nothing."""
    _encoders.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
