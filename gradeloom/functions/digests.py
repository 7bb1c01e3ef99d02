"""MD5 of many short texts at once, for draws that a hash decides: numpy does a step for all texts of a length."""

from __future__ import annotations

import hashlib
import math

#: texts that go through the steps together: enough to outweigh the calls, few enough for a core's cache
AT_ONCE = 1 << 15
#: a longer message has more than one block of MD5 and is left to hashlib
ONE_BLOCK = 55

_ADD = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(words: list, size: tuple[int, int]) -> list:
    """The four words of the digests of one-block messages; of the 16 ``words`` some are arrays, the others equal in all messages."""
    import numpy as np

    a, b, c, d = (np.full(size, x, "u4") for x in _START)
    f, t = np.empty(size, "u4"), np.empty(size, "u4")
    for k in range(64):
        part = k // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        times, more = _WORD[part]
        word = words[(times * k + more) % 16]
        if not isinstance(word, int):
            a += word
            word = 0
        a += f
        a += np.uint32(_ADD[k] + word & 0xFFFFFFFF)
        turn = _TURN[part][k % 4]
        np.left_shift(a, np.uint32(turn), out=t)
        np.right_shift(a, np.uint32(32 - turn), out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    for x, start in zip((a, b, c, d), _START, strict=True):
        x += np.uint32(start)
    return [a, b, c, d]


class Digests:
    """MD5 digests of prefix + text + suffix for fixed ``texts`` and any frames of (prefix, suffix), all bytes."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        self.texts, self.groups = texts, []
        sizes = np.fromiter(map(len, texts), "i8", len(texts))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for k in range(0, len(rows), AT_ONCE):
                own = rows[k : k + AT_ONCE]
                matrix = np.frombuffer(b"".join(texts[i] for i in own), "u1").reshape(len(own), size)
                self.groups.append((own, matrix, {}))

    def _shifted(self, matrix, held: dict, shift: int):
        """The texts as little-endian words, ``shift`` bytes into the first one."""
        import numpy as np

        if shift not in held:
            n, size = matrix.shape
            wide = np.zeros((n, -(-(size + shift) // 4) * 4), "u1")
            wide[:, shift : shift + size] = matrix
            held[shift] = np.ascontiguousarray(wide.view("<u4").T)
        return held[shift]

    def words(self, frames: list[tuple[bytes, bytes]], n: int = 4):
        """The first ``n`` 32-bit numbers of each digest, as its hexadecimal form reads: an array (n, frames, texts)."""
        import numpy as np

        out = np.empty((n, len(frames), len(self.texts)), "u4")
        alike: dict = {}
        for k, (prefix, suffix) in enumerate(frames):
            alike.setdefault((len(prefix), len(suffix)), []).append(k)
        for rows, matrix, held in self.groups:
            size = matrix.shape[1]
            for (before, after), which in alike.items():
                length = before + size + after
                if length > ONE_BLOCK:
                    for k in which:
                        out[:, k, rows] = np.array([np.frombuffer(hashlib.md5(frames[k][0] + self.texts[i] + frames[k][1]).digest(), ">u4")[:n] for i in rows]).T
                    continue
                end = b"\x80" + bytes(ONE_BLOCK - length) + (8 * length).to_bytes(8, "little")
                fixed = np.frombuffer(b"".join(frames[k][0] + bytes(size) + frames[k][1] + end for k in which), "<u4").reshape(-1, 16)
                own, at = self._shifted(matrix, held, before % 4), before // 4
                step = max(1, AT_ONCE // len(rows))
                for j in range(0, len(which), step):
                    part, few = which[j : j + step], fixed[j : j + step]
                    words = [few[:, [w]] | own[w - at] if size and at <= w < at + len(own) else int(few[0, w]) if (few[:, w] == few[0, w]).all() else few[:, [w]] for w in range(16)]
                    found = _rounds(words, (len(part), len(rows)))
                    for k in range(n):
                        out[k][np.ix_(part, rows)] = found[k].byteswap(inplace=True)
        return out
