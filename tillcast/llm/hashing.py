"""Hashes of words and word pairs in Python tasks, a batch of words at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# Bytes that a task's memory of words may take, about, and what a word costs beside its own bytes.
REMEMBERED, ENTRY = 12_000_000, 200


class Remembered(dict):
    """Word -> what is known of it, as long as the words fit the memory; then it starts again."""

    size = 0

    def make_room(self, word: bytes) -> None:
        self.size += ENTRY + len(word)
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0


class WordHashes(Remembered):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        self.make_room(word)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int = 2) -> np.ndarray:
    """One hash per run of ``width`` words; fewer words give a single hash of the whole sequence."""
    if len(words) < width:
        whole = int(_A)
        for word in words.tolist():
            whole = (whole * int(_B) + word) % 2**64
        return mixed(np.array([whole], np.uint64))
    count = len(words) - width + 1
    out = words[:count]
    for i in range(1, width):
        out = mixed(out * _A) + words[i : i + count]
    return mixed(out)


def blank_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
