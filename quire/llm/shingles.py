"""Word shingles and MinHash signatures of many texts at once, with numpy.

A text's words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Its set holds a 64-bit hash of
each distinct run of five words; of fewer words, one hash of the whole sequence; without words,
nothing. Word hashes are polynomial in the bytes, taken from running sums over a segment, so no
Python loop runs over words.
"""

import numpy as np

WORDS = 5
SEGMENT = 1 << 19

_random = np.random.Generator(np.random.PCG64(20240131))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _powers(base, n):
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def mixed(x):
    """A bijection of 64-bit integers that spreads its bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.up, self.down = _powers(_BASE, SEGMENT), _powers(_INVERSE, SEGMENT)

    def words(self, text: bytes) -> np.ndarray:
        """The hash of each word, in order."""
        if len(text) <= SEGMENT:
            return self._words(np.frombuffer(text, np.uint8))
        found, at = [], 0
        while at < len(text):  # segments end at white space
            end = min(at + SEGMENT, len(text))
            part = np.frombuffer(text, np.uint8, end - at, at)
            if end < len(text):
                gaps = np.flatnonzero(~_IS_WORD[part])
                if len(gaps) == 0:  # one word fills the segment: take it whole
                    rest = np.flatnonzero(~_IS_WORD[np.frombuffer(text, np.uint8, -1, end)])
                    end = end + int(rest[0]) if len(rest) else len(text)
                    found.append(self._long_word(text[at:end]))
                    at = end
                    continue
                end = at + int(gaps[-1]) + 1
                part = part[: end - at]
            found.append(self._words(part))
            at = end
        return np.concatenate(found)

    def _words(self, b):
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = _IS_WORD[b]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[b] * self.up[: len(b)], out=sums[1:])
            return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def _long_word(self, word: bytes):
        """As _words for one word, by Horner's rule over segments."""
        total, power = np.uint64(0), np.uint64(1)
        with np.errstate(over="ignore"):
            for at in range(0, len(word), SEGMENT):
                b = np.frombuffer(word, np.uint8, min(SEGMENT, len(word) - at), at)
                total += np.sum(_BYTE[b] * self.up[: len(b)], dtype=np.uint64) * power
                power *= self.up[len(b)]
        return mixed(np.array([total], np.uint64))

    def set_of(self, text: bytes | None) -> np.ndarray:
        """The sorted hashes of the text's shingles."""
        words = self.words(text) if text else np.empty(0, np.uint64)
        n = len(words)
        if n == 0:
            return words
        with np.errstate(over="ignore"):
            if n < WORDS:
                return mixed(np.array([np.sum(words * _PLACE[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
            total = words[: n - WORDS + 1] * _PLACE[0]
            for k in range(1, WORDS):
                total += words[k : n - WORDS + 1 + k] * _PLACE[k]
        return np.unique(mixed(total))


class Signer:
    """MinHash signatures of n_hashes 32-bit values, for sets end to end in one array."""

    def __init__(self, n_hashes: int, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.a = draw.integers(1, 1 << 63, n_hashes, dtype=np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n_hashes, dtype=np.uint64)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a set; no set may be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 14):
                size += len(sets[end])
                end += 1
            s = np.concatenate(sets[at:end])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
            with np.errstate(over="ignore"):
                for k in range(len(self.a)):
                    h = ((s * self.a[k] + self.b[k]) >> np.uint64(32)).astype(np.uint32)
                    out[at:end, k] = np.minimum.reduceat(h, starts)
            at = end
        return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed integers."""
    with np.errstate(over="ignore"):
        a = np.sum(mixed(s + np.uint64(11)), dtype=np.uint64)
        b = np.sum(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
