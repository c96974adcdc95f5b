"""Word and shingle hashes of whole texts, as whole-array numpy steps inside a task.

A word's hash is a polynomial over its mixed bytes modulo 2**64, taken from running sums, so a text
costs a few passes over its bytes and no Python work per word. Equal words always hash equal; unequal
ones may rarely collide, so whatever is found by hash is verified on the words themselves.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes of text hashed at once; bounds the memory of a very long text.
PIECE = 1 << 21

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed_bytes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class Words:
    """One notion of a word: A-Z count as a-z, and ``breaks`` are the bytes that part words."""

    def __init__(self, breaks: bytes):
        upper = np.frombuffer(bytes(range(65, 91)), np.uint8)
        self._mix = _mixed_bytes()
        self._mix[upper] = self._mix[upper + 32]
        self._part_of_word = np.ones(256, bool)
        self._part_of_word[np.frombuffer(breaks, np.uint8)] = False
        self._pattern = re.compile(b"[^" + re.escape(breaks) + b"]+")
        self._powers = self._inverses = np.ones(1, np.uint64)

    def split(self, text: bytes) -> list[bytes]:
        """The words themselves."""
        return self._pattern.findall(text.lower())

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _piece(self, raw: np.ndarray) -> np.ndarray:
        inside = self._part_of_word[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        if not len(edge):
            return np.empty(0, np.uint64)
        first, end = edge[::2], edge[1::2]
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self._mix[raw] * self._powers[: len(raw)], out=sums[1:])
        return scramble((sums[end] - sums[first]) * self._inverses[first] + (end - first).astype(np.uint64))

    def hashes(self, text: bytes) -> np.ndarray:
        """One 64-bit hash per word, in order."""
        raw = np.frombuffer(text, np.uint8)
        if len(raw) <= PIECE:
            return self._piece(raw)
        found, at = [], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw):  # cut only where no word is cut
                gaps = np.flatnonzero(~self._part_of_word[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(end + PIECE, len(raw))
            found.append(self._piece(raw[at:end]))
            at = end
        return np.concatenate(found)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter; none without words."""
    width = min(k, len(words))
    if not width:
        return words
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total = total * _STEP + words[i : i + count]
    return scramble(total)


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The same shingles as the words themselves, for exact checks."""
    if len(words) <= k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))
