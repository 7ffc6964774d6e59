"""Words of many texts at once as numpy arrays: the text kernels of the classifiers."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

#: First and last code points of scripts; letters outside all of them count as script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x323AF))),
)
_classes: list[np.ndarray] = []


def classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 neither letter nor mark, else the script's number plus 1; and whether it is a mark."""
    if not _classes:
        kind, mark = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
        names = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        kind[[c for c, x in enumerate(names) if x in "LM"]] = 1
        mark[[c for c, x in enumerate(names) if x == "M"]] = True
        for i, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                part = kind[a : b + 1]
                part[part > 0] = i + 2
        _classes.extend((kind, mark))
    return _classes[0], _classes[1]


@dataclass
class Words:
    """Maximal runs of letters and marks with a letter at least, of all texts, in order."""

    chars: np.ndarray  # code points of all texts, a zero after each text
    doc: np.ndarray  # each word's text
    begin: np.ndarray  # where it begins in chars
    end: np.ndarray
    script: np.ndarray  # of its first letter
    texts: int

    @property
    def letters(self) -> np.ndarray:
        return self.end - self.begin

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """For each letter of each word: where it is in chars, and its word."""
        n = self.letters
        ends = np.cumsum(n)
        word = np.repeat(np.arange(len(n)), n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin - (ends - n), n), word


def words_of(texts: list[str]) -> Words:
    lower = [x.lower() for x in texts]
    chars = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kinds, marks = classes()
    kind = kinds[chars]
    is_letter = kind > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    mark = marks[chars]
    if mark.any():
        so_far = np.concatenate([[0], np.cumsum(is_letter & ~mark)])
        some = so_far[end] > so_far[begin]
        begin, end = begin[some], end[some]
    text_ends = np.cumsum([len(x) + 1 for x in lower])
    return Words(chars, np.searchsorted(text_ends, begin, side="right"), begin, end, kind[begin].astype(np.int64), len(texts))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased letters."""
    if not len(w.begin):
        return np.empty(0, np.uint64)
    at, word = w.spread()
    starts = np.cumsum(w.letters) - w.letters
    place = np.arange(len(at)) - starts[word]
    return np.add.reduceat(mixed(w.chars[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)) + np.uint64(1 << 60)), starts)


def gram_hashes(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of the words, blanks around each word included: (hash, word), one a letter."""
    if not len(w.begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, word = w.spread()
    c = w.chars
    before = np.where(at == w.begin[word], 32, c[np.maximum(at - 1, 0)])
    after = np.where(at + 1 == w.end[word], 32, c[np.minimum(at + 1, len(c) - 1)])
    code = (before.astype(np.uint64) << np.uint64(42)) | (c[at].astype(np.uint64) << np.uint64(21)) | after.astype(np.uint64)
    return (mixed(code) >> np.uint64(64 - bits)).astype(np.int64), word


def prefix_hashes(w: Words, lengths: range) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings of the given lengths: (hash, word)."""
    if not len(w.begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at, word = w.spread()
    n = w.letters
    starts = np.cumsum(n) - n
    place = np.arange(len(at)) - starts[word]
    run = np.add.accumulate(mixed(w.chars[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)) + np.uint64(1 << 60)))
    before = np.where(starts > 0, run[np.maximum(starts - 1, 0)], np.uint64(0))
    found, words = [mixed(run[starts + n - 1] - before)], [np.arange(len(n))]
    for k in lengths:
        long = np.flatnonzero(n > k)
        found.append(mixed(run[starts[long] + k - 1] - before[long] + np.uint64(k << 50)))
        words.append(long)
    return np.concatenate(found), np.concatenate(words)
