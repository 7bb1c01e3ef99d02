"""Word shingles as sets of 64-bit hashes, shared by the near-duplicate operators."""

from __future__ import annotations

from .common import Cache

_MASK = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15


class Shingler:
    """Hashes of the ``k``-word shingles of a text given in UTF-8.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer than ``k``
    words has its whole sequence as one shingle, a text without words none. Two shingles are taken to
    be equal if their 64-bit hashes are (a chance of about 3e-20 for a pair).
    """

    def __init__(self, k: int = 5):
        import numpy as np
        import xxhash

        self.np, self.k = np, k
        self.words = Cache(xxhash.xxh3_64_intdigest, 200_000)
        self.powers = [np.uint64(pow(_MUL, j, 1 << 64)) for j in range(k, 0, -1)]

    def _mix(self, h):
        np = self.np
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def sequence(self, text: bytes):
        """Hashes of all shingles in their order, repeats included."""
        np = self.np
        words = text.lower().split()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(w):
            return w
        if len(w) < self.k:
            h = 0
            for x in w.tolist():
                h = (h * _MUL + x) & _MASK
            return self._mix(np.array([h ^ len(w)], np.uint64))
        n = len(w) - self.k + 1
        h = np.zeros(n, np.uint64)
        for j, p in enumerate(self.powers):
            h += w[j : j + n] * p
        return self._mix(h)

    def set(self, text: bytes):
        """The distinct hashes, in order."""
        return self.np.unique(self.sequence(text))
