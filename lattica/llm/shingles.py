"""Sets of hashed word shingles, computed on whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lattica.llm.common import ASCII_LOWER

WORDS = 5  # per shingle
_SLICE = 1 << 20  # bytes hashed at a time

_SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Keeps tables of powers between batches."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = self.inverses = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            self.steps = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(words)], np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def word_hashes(self, text: bytes) -> np.ndarray:
        """Hash of each word of a lower-cased text, slice by slice."""
        parts, at = [], 0
        while at < len(text):
            end = min(at + _SLICE, len(text))
            while end < len(text) and not _SEPARATOR[text[end]]:  # no word is cut
                end += 1
            parts.append(self._hash(np.frombuffer(text, np.uint8, end - at, at)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        n = len(letters)
        self._grow(n)
        gap = np.concatenate([[True], _SEPARATOR[letters], [True]])
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[letters] * self.powers[:n], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text; a text of fewer words has one, without words none."""
        for text in texts:
            h = self.word_hashes((text or b"").translate(ASCII_LOWER))
            n, w = len(h), self.words
            if n >= w:
                s = np.zeros(n - w + 1, np.uint64)
                for k in range(w):
                    s += h[k : n - w + 1 + k] * self.steps[k]
                yield np.unique(mix(s))
            elif n:
                yield mix((h * self.steps[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
