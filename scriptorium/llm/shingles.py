"""Sets of word shingles as 64-bit hashes, computed with numpy over whole texts."""

from __future__ import annotations

import numpy as np

WIDTH, SIMILARITY = 5, 0.8
#: Words hashed at a time, so that a very long text needs bounded memory.
BLOCK_WORDS = 1 << 16

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """text -> sorted distinct hashes of its runs of `width` words (lower case).

    A text of 1 to width-1 words has one shingle, of all its words; null, empty or
    blank text has none. The hash of a run is a polynomial over random byte values
    mod 2**64, mixed; it comes from prefix sums, so a word is read once.
    """

    def __init__(self, width: int = WIDTH):
        self.width, self.up, self.down = width, _powers(_R, 1024), _powers(_R_INVERSE, 1024)

    def _hashes(self, words: list[str], width: int) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_R, 2 * len(data)), _powers(_R_INVERSE, 2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=sums[1:])
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1]
        ends = np.concatenate((gaps, [len(data)]))[width - 1 :]
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        width = min(self.width, len(words))
        if len(words) <= BLOCK_WORDS:
            return np.unique(self._hashes(words, width))
        parts = [np.unique(self._hashes(words[i : i + BLOCK_WORDS + width - 1], width)) for i in range(0, len(words) - width + 1, BLOCK_WORDS)]
        return np.unique(np.concatenate(parts))
