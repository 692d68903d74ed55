"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Both vocabularies cut a text into words by a pattern before they merge pairs, and
merges never cross words. So a text's ids are its words' ids end to end, and a
worker keeps the ids of the words it has met. Texts with other characters than
ASCII and the Latin-1 letters go to the library whole, as the pattern's classes
are then Unicode's.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

from .common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7e{_LETTERS}]*")


def _plain(text: str) -> bool:
    """Only characters of which Python's classes and the vocabularies' agree."""
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _PLAIN.fullmatch(text) is not None


#: The word patterns of the two vocabularies, over those characters.
_PATTERNS = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+"),
}


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Word -> its number; a new word is encoded and its ids are appended."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.names = model.tokenize, _byte_names()
        self.space = self.names[32]
        self.ids = array("I")
        self.starts = array("q", [0])

    def __missing__(self, word: str) -> int:
        if word.isascii() and word.isalnum():
            name = word
        elif word.isascii() and word[0] == " " and word[1:].isalnum():
            name = self.space + word[1:]
        else:
            name = word.encode().decode("latin-1").translate(self.names)
        self.ids.extend([t.id for t in self.tokenize(name)])
        self.starts.append(len(self.ids))
        self[word] = at = len(self.starts) - 2
        return at


class Encoder:
    """encode(texts) -> (ids end to end, ids of each text), as encode_batch(texts, add_special_tokens=False)."""

    #: Words kept by a worker before it starts anew: this bounds memory, not results.
    KEEP = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.fold = self.whole.normalizer is not None
        self.pattern = _PATTERNS["word" if self.fold else "byte"]
        self.memo = _Memo(self.whole.model)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.KEEP:
            self.memo = _Memo(self.whole.model)
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not _plain(text):
                odd.append(i)
                continue
            had = len(words)
            words += self.pattern.findall(text.lower() if self.fold else text)
            counts[i] = len(words) - had
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        bounds = np.frombuffer(self.memo.starts, np.int64)  # a view: it must be gone before the memo grows
        lengths = bounds[at + 1] - bounds[at]
        ids = np.frombuffer(self.memo.ids, np.uint32)[ragged(bounds[at], lengths)]
        del bounds
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, e in zip(odd, self.whole.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids.astype(np.uint32, copy=False), sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@cache
def vocabulary(path: str) -> int:
    """Number of ids; bounds every table by id."""
    return max(encoder(path).whole.get_vocab(with_added_tokens=True).values()) + 1
