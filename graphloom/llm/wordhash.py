"""Words of many texts at once, in numpy: bounds in one byte buffer, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters a to z, all beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: `[^\x20\x09-\x0D]+`.
NO_SPACE = np.ones(256, dtype=bool)
NO_SPACE[9:14] = NO_SPACE[32] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Words:
    """data: lower-cased bytes; start, end: byte bounds of each word; first: index of each text's first word, with the total last."""

    def __init__(self, texts: list[bytes | None], is_word: np.ndarray = IS_WORD):
        texts = [x or b"" for x in texts]
        self.data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        bounds = np.cumsum([0, *map(len, texts)])
        inside = is_word[self.data]
        n = len(inside)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = bounds[(bounds > 0) & (bounds < n)]  # a text's end is a word's end
        starts[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, *prefixes: int):
        """Each word's hash; with prefixes, also that of each word's first bytes, so many: a list of arrays then."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=sums[1:])
        back, begun, out = _power(INVERSE, n + 1)[self.start], sums[self.start], []
        for most in (None, *prefixes):
            end = self.end if most is None else np.minimum(self.end, self.start + most)
            mark = np.uint64(0 if most is None else most << 48)
            out.append(scramble(((sums[end] - begun) * back) ^ (end - self.start).astype(np.uint64) ^ mark))
        return out if prefixes else out[0]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, joined by spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


#: Texts above this are cut into pieces.
PIECE_BYTES = 2 << 20


def pieces(data: bytes, overlap: int = 0, is_word: np.ndarray = IS_WORD):
    """(number of its first word in the text, its words, how many of them are whole) for pieces of a long text; neighbours share `overlap` words."""
    at, base, size = 0, 0, PIECE_BYTES
    while True:
        words = Words([data[at : at + size]], is_word)
        n = len(words.start)
        if at + size >= len(data):
            yield base, words, n
            return
        if n and words.end[-1] == len(words.data):  # may go on in the next piece
            n -= 1
        if n <= overlap + 1:
            size *= 2
            continue
        yield base, words, n
        at, base, size = at + int(words.start[n - overlap]) if overlap or n < len(words.start) else at + size, base + n - overlap, PIECE_BYTES


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, over text ends too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * BASE + hashes[k : k + n]
    return scramble(out)
