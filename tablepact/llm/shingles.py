"""Sets of word shingles and their MinHash bands, in numpy, a batch of texts at a time."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

WIDTH = 5
#: Words whose hash a task remembers before it starts anew.
REMEMBERED = 300_000

_RANDOM = np.random.default_rng(20_240_607)
_FACTORS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """The 64-bit hash of a word, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], known: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted within each, and where each text's begin.

    A text of fewer than ``width`` words, but one at least, is one shingle.
    """
    split = [text.split() for text in texts]  # bytes are split at exactly the six ASCII blanks
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashes = np.fromiter((known[word] for words in split for word in words), np.uint64, counts.sum())
    ends = np.cumsum(counts)
    begins = ends - counts
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k:k + len(total)] * _FACTORS[k]
    doc = np.repeat(np.arange(len(split)), counts)
    whole = doc[:len(total)] == doc[width - 1:]
    values, owner = mixed(total[whole]), doc[:len(total)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = [(hashes[begins[i]:ends[i]] * _FACTORS[:counts[i]]).sum() + np.uint64(counts[i]) for i in short]
        values = np.concatenate([values, mixed(np.array(own, np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(split) + 1))


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows a band for which ``most`` permutations find a pair of
    the threshold's similarity with at least the given probability."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("more permutations are needed for this recall")


def band_hashes(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set that is not empty."""
    full = starts[:-1][np.diff(starts) > 0]
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    random = np.random.default_rng(7).integers(0, 2**32, (bands * rows, 2), dtype=np.uint32) | np.uint32(1)
    found = np.empty((len(full), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for row in range(rows):
            f, g = random[band * rows + row]
            least = np.minimum.reduceat(low * f + high * g, full) if len(full) else np.empty(0, np.uint32)
            key = mixed(key * _FACTORS[row] + least)
        found[:, band] = key
    return found.view(np.int64)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: float, chunk: int = 4096) -> np.ndarray:
    """Which pairs of sets have at least the threshold's Jaccard similarity.

    ``side`` parts the sets; where it has two values only pairs across count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = np.zeros((n, n), np.float32)
    if n == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        _, column, count = np.unique(every, return_inverse=True, return_counts=True)
        common = count[column] > 1
        rank = np.cumsum(count > 1) - 1
        column, owner = rank[column[common]], owner[common]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + chunk + 1, chunk))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            part = np.zeros((n, chunk), np.float32)
            part[owner[a:b], column[a:b] - k * chunk] = 1
            shared += part @ part.T
    found = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(found, False)
    if side.any() and not side.all():
        found &= side[:, None] != side[None, :]
    return found


def least_reached(found: np.ndarray) -> np.ndarray:
    """For each row the least index in its component of the links."""
    label = np.arange(len(found))
    while True:
        new = np.minimum(label, np.where(found, label[None, :], len(found)).min(1, initial=len(found)))
        new = new[new]
        if (new == label).all():
            return label
        label = new
