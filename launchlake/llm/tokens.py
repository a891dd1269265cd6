"""Token ids of whole texts with a fixed, public tokenizer file.

The tokenizer's merges never cross white space, so ids are looked up word by word and
each distinct word is encoded once per worker and table of words. Lower-casing A-Z first
changes no id, because the tokenizer lower-cases itself. Texts that contain the opening
of a special token are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers

from launchlake.llm.common import LOWER

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
KNOWN_WORDS = 700_000  # words whose ids a worker holds in each of two generations
KEPT_WORDS = 50_000  # larger tables are given back when a task ends: workers live on into steps that need the memory
WORDS_TOGETHER = 50
MARKS = b".,"
HARMLESS = {"NFC", "NFKC", "Lowercase", "Replace", "Split", "ByteLevel"}
_readers: dict[str, Encoder] = {}


def _steps(part: dict | None) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer."""
    return [] if part is None else part.get("normalizers") or part.get("pretokenizers") or [part]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # Ids that end a unit, for tokenizers that mark word ends.
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Lower-case ASCII letters pass these steps unchanged, so such words can go to the merges at once.
        settings = json.loads(self._tokenizer.to_str())
        steps = {k["type"] for part in ("normalizer", "pre_tokenizer") for k in _steps(settings[part])}
        self._letters = Tokenizer(self._tokenizer.model) if steps <= HARMLESS else self._tokenizer
        if steps <= HARMLESS:
            self._letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of words; those of letters only are one unit each, so they are encoded together and told apart by word ends."""
        ascii_, other, odd = [], [], []
        for w in words:
            (ascii_ if w.isalpha() else other if not w.isascii() and w.decode().lower().isalpha() else odd).append(w)
        yield from zip(odd, self._encode([w.decode() for w in odd]))
        yield from self._encode_together(self._letters, ascii_)
        yield from self._encode_together(self._tokenizer, other)

    def _encode_together(self, tokenizer: object, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        groups = [words[at:at + WORDS_TOGETHER] for at in range(0, len(words), WORDS_TOGETHER)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [0, *((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()]
            if len(cuts) == len(group) + 1:
                raw = ids.tobytes()
                yield from zip(group, [raw[a:b] for a, b in pairwise(cuts)])
            else:
                yield from zip(group, self._encode([w.decode() for w in group]))

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words not known yet; a final comma or stop behind a letter is a token of its own."""
        if len(self._known) > KNOWN_WORDS:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = [w for w in words if w not in older]
        known.update((w, older[w]) for w in words if w in older)
        stems = [w[:-1] if w[-1] in MARKS and w[-2:-1].isalpha() else w for w in new]
        distinct = dict.fromkeys(stems)
        known.update((s, older[s]) for s in distinct if s in older)
        known.update(self._encode_words([s for s in distinct if s not in known]))
        marks = {m: self._encode([chr(m)])[0] for m in MARKS}
        known.update((w, known[s] + marks[w[-1]]) for w, s in zip(new, stems) if len(w) != len(s))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text (null: none), without an end id."""
        special = {i for i, t in enumerate(texts) if t and "<|" in t}
        words = [[] if i in special or not t else t.encode().translate(LOWER).split() for i, t in enumerate(texts)]
        known = self._known
        found = [list(map(known.get, own)) for own in words]
        short = [i for i, ids in enumerate(found) if None in ids]
        if short:
            self._learn(list(dict.fromkeys(w for i in short for w, ids in zip(words[i], found[i]) if ids is None)))
            learned = self._known
            for i in short:
                found[i] = [learned[w] if ids is None else ids for w, ids in zip(words[i], found[i])]
        return [self._encode([texts[i]])[0] if i in special else b"".join(ids) for i, ids in enumerate(found)]

    def release(self) -> None:
        """Give back a large table of known words."""
        if len(self._known) + len(self._older) > KEPT_WORDS:
            self._known, self._older = {}, {}


def encoder(path: str = DEFAULT_TOKENIZER) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _readers:
        _readers[path] = Encoder(path)
    return _readers[path]


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > chars:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if texts:
        yield start, len(texts)


def crc(ids: bytes) -> int:
    """Unsigned crc32 of little-endian unsigned 32-bit ids."""
    return zlib.crc32(ids)


END = np.array([END_ID], "<u4").tobytes()
