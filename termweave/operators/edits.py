"""Edit distances of many pairs of texts at once, as array arithmetic inside a task."""

from __future__ import annotations

import numpy as np

#: A pattern's rows of the distance matrix are the bits of one word.
WORD = 64
#: Longer texts are compared one by one, so that few of them do not lengthen the steps of all.
LONG = 256
ROWS_PER_BLOCK = 8192
#: Bounds the table of letters in patterns.
MAX_CELLS = 1 << 22


def distance(a: str, b: str) -> int:
    """Edit distance of two texts of any length, the column of the matrix as the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    every, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    more, less = every, 0
    for letter in b:
        equal = places.get(letter, 0)
        down = equal | less
        across = ((equal & more) + more ^ more) | equal
        up, off = less | ~(across | more) & every, more & across
        score += bool(up & top) - bool(off & top)
        up, off = up << 1 | 1, off << 1
        more, less = (off | ~(down | up)) & every, up & down & every
    return score


class Texts:
    """Texts as one array of letters, to be compared pair by pair."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        held = np.zeros(int(points.max(initial=0)) + 1, bool)
        held[points] = True
        self.letters = (np.cumsum(held) - 1)[points]
        self.alphabet = int(held.sum()) or 1
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def distances(self, row: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Edit distance of each text `row` to the text `other` beside it."""
        found = np.zeros(len(row), np.int64)
        long = (self.size[row] > LONG) | (self.size[other] > WORD) | (self.size[other] == 0)
        for i in np.flatnonzero(long).tolist():
            found[i] = distance(self.texts[other[i]], self.texts[row[i]])
        short = np.flatnonzero(~long)
        for start in range(0, len(short), ROWS_PER_BLOCK):
            self._block(short[start : start + ROWS_PER_BLOCK], row, other, found)
        return found

    def _block(self, at: np.ndarray, row: np.ndarray, other: np.ndarray, found: np.ndarray) -> None:
        patterns, slot = np.unique(other[at], return_inverse=True)
        if len(patterns) * self.alphabet > MAX_CELLS and len(at) > 1:
            half = len(at) // 2
            self._block(at[:half], row, other, found)
            self._block(at[half:], row, other, found)
            return
        places = np.zeros((len(patterns), self.alphabet), np.uint64)
        sizes = self.size[patterns]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = self.letters[np.repeat(self.first[patterns], sizes) + step]
        np.bitwise_or.at(places, (np.repeat(np.arange(len(patterns)), sizes), letters), np.uint64(1) << step.astype(np.uint64))
        order = np.argsort(-self.size[row[at]], kind="stable")  # those that end leave at the end
        at, slot = at[order], slot[order]
        first, size, score = self.first[row[at]], self.size[row[at]], sizes[slot]
        top, one = np.uint64(1) << (score - 1).astype(np.uint64), np.uint64(1)
        more, less = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        going = np.searchsorted(-size, -np.arange(int(size.max(initial=0))))
        for j, k in enumerate(going.tolist()):
            equal = places[slot[:k], self.letters[first[:k] + j]]
            plus, minus = more[:k], less[:k]
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up, off = minus | ~(across | plus), plus & across
            score[:k] += (up & top[:k]) != 0
            score[:k] -= (off & top[:k]) != 0
            up, off = up << one | one, off << one
            more[:k] = off | ~(down | up)
            less[:k] = up & down
        found[at] = score
