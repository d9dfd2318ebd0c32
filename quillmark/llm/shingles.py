"""Word shingles of many texts at once, as 64-bit hashes in NumPy arrays.

Words are the longest runs of ASCII letters, digits and ``_`` of the lower-cased text; a shingle is a
sequence of consecutive words; a text's shingles form a set.  The hash of a word is the sum of one random
number per (byte, place), so that whole batches are hashed with array operations and no loop over words.
"""

from __future__ import annotations

import numpy as np

WORDS = 4
_SEED = 20240917
_rng = np.random.default_rng(_SEED)
_PLACES = 64
_TABLE = _rng.integers(1, 2**63, size=_PLACES * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _IS_WORD[_c] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply); a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted set of text i is ``hashes[offsets[i]:offsets[i + 1]]``.

    At most 4096 texts a call: a hash has 52 bits, the text's number the upper 12.  Null texts and texts
    of fewer than ``words`` words have the empty set.
    """
    n = len(texts)
    if n > 4096:
        raise ValueError("at most 4096 texts a call")
    raw = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_word = _IS_WORD[data]
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    none = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    if len(starts) < words:
        return none
    lens = np.flatnonzero(edge == -1) - starts
    letters = data[is_word]
    first = np.cumsum(lens) - lens
    place = np.arange(len(letters)) - np.repeat(first, lens)
    value = _TABLE[((place & (_PLACES - 1)) << 8) | letters]
    if lens.max() > _PLACES:
        value = value * ((place // _PLACES).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    word = np.add.reduceat(value, first)
    owner = np.searchsorted(ends, starts, side="right")
    last = len(word) - words + 1
    h = word[:last].copy()
    for k in range(1, words):
        h = h * _P + word[k : k + last]
    h = mix(h)[owner[:last] == owner[words - 1 :]]
    if not len(h):
        return none
    own = owner[:last][owner[:last] == owner[words - 1 :]].astype(np.uint64)
    key = np.sort((own << np.uint64(52)) | (h >> np.uint64(12)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    counts = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=n)
    return key & np.uint64((1 << 52) - 1), np.concatenate(([0], np.cumsum(counts)))


def batches(texts: list[str | None], chars: int = 2_000_000, most: int = 2048):
    """(from, to) of runs of texts of bounded total length, so that temporary arrays stay small."""
    begin = size = 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if i > begin and (size + k > chars or i - begin >= most):
            yield begin, i
            begin, size = i, 0
        size += k
    if begin < len(texts):
        yield begin, len(texts)


class MinMax:
    """Min-max signatures: of each permutation both the smallest and the largest value are kept, so that
    a signature of ``2 * permutations`` codes costs ``permutations`` hash evaluations a shingle."""

    def __init__(self, permutations: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, size=permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 2**63, size=permutations, dtype=np.uint64)

    def codes(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """16-bit codes, one row per text with at least one shingle, columns min, max, min, max, ..."""
        begin = offsets[:-1][offsets[1:] > offsets[:-1]]
        out = np.empty((len(begin), 2 * len(self.a)), np.uint16)
        if not len(begin):
            return out
        for k, (a, c) in enumerate(zip(self.a, self.c)):
            v = (hashes ^ c) * a
            for j, ufunc in enumerate((np.minimum, np.maximum)):
                out[:, 2 * k + j] = (mix(ufunc.reduceat(v, begin)) >> np.uint64(48)).astype(np.uint16)
        return out


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name the set of each text with at least one shingle."""
    begin = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.add.reduceat(mix(hashes), begin)
    two = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin)
    return one.view(np.int64), two.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
