"""Shingle sets of texts, their MinHash bands and their odd sketches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import xxhash

SHINGLE_WORDS = 5
WORDS_AT_ONCE = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    """64-bit hashes of words; hashing one takes less time than looking it up among hundreds of thousands."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count)


def shingles(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words; A-Z are lower-cased, words end at ASCII white space.

    Fewer words are one shingle of their own kind; no word gives none.
    """
    words = (text if isinstance(text, bytes) else (text or "").encode()).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, len(words))
    width = min(len(words), SHINGLE_WORDS)
    count = len(words) - width + 1
    folded = np.full(count, np.uint64(width))
    for n in range(width):
        folded = folded * _STEP + hashes[n : n + count]
    return np.unique(mixed(folded))


def shingles_of_all(texts: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of many texts, given as words: hashes, strung together in order, and their number for each text.

    Texts are taken together until they have ``WORDS_AT_ONCE`` words, so that short ones cost no step each.
    """
    group: list[list[bytes]] = []
    waiting = 0
    for words in texts:
        group.append(words)
        waiting += len(words)
        if waiting >= WORDS_AT_ONCE:
            yield _sets_together(group)
            group, waiting = [], 0
    if group:
        yield _sets_together(group)


def _sets_together(group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, group), np.int64, len(group))
    counts = np.where(lengths < SHINGLE_WORDS, np.minimum(lengths, 1), lengths - SHINGLE_WORDS + 1)
    total = int(lengths.sum())
    hashes = word_hashes(chain.from_iterable(group), total)
    values = np.empty(int(counts.sum()), np.uint64)
    starts = np.cumsum(counts) - counts
    if total >= SHINGLE_WORDS:
        # All runs of five words, also those across texts; the latter are left out.
        folded = np.full(total - SHINGLE_WORDS + 1, np.uint64(SHINGLE_WORDS))
        for n in range(SHINGLE_WORDS):
            folded *= _STEP
            folded += hashes[n : n + len(folded)]
        behind = np.repeat(np.cumsum(lengths), lengths)[: len(folded)] - np.arange(len(folded))
        values[np.repeat(lengths >= SHINGLE_WORDS, counts)] = mixed(folded[behind >= SHINGLE_WORDS])
    for k in np.flatnonzero((lengths > 0) & (lengths < SHINGLE_WORDS)).tolist():
        folded = np.full(1, np.uint64(len(group[k])))
        for hashed in word_hashes(group[k], len(group[k])):
            folded = folded * _STEP + hashed
        values[starts[k]] = mixed(folded)[0]
    for start, end in zip(starts.tolist(), (starts + counts).tolist()):
        values[start:end].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[starts[counts > 0]] = True
    return values[fresh], np.bincount(np.repeat(np.arange(len(group)), counts)[fresh], minlength=len(group))


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    places[places == len(b)] = 0
    return int((b[places] == a).sum()) if len(b) else 0


@dataclass(frozen=True)
class Scheme:
    """How many bands of how many MinHash samples, how many sketch bits, and the similarity wanted (per cent)."""

    percent: int
    bands: int
    rows: int
    bits: int

    @cached_property
    def _factors(self) -> np.ndarray:
        return mixed(np.arange(1, self.bands * self.rows + 1, dtype=np.uint64) * _STEP) | np.uint64(1)

    @cached_property
    def _salts(self) -> np.ndarray:
        return mixed(np.arange(1, self.bands * self.rows + 1, dtype=np.uint64) * _STEP + np.uint64(1))

    @cached_property
    def most_odd_bits(self) -> int:
        """Sketches of a pair at the wanted similarity differ in more bits once in a hundred million times.

        The number of samples that differ is binomial; each throws two bits at
        random places, and the bits that are hit an odd number of times remain.
        """
        samples, p = self.bands * self.rows, 1 - self.percent / 100
        odd = np.zeros(self.bits + 1)
        odd[0] = 1.0
        share = np.arange(self.bits + 1) / self.bits
        mixture = np.zeros(self.bits + 1)
        for differing in range(samples + 1):
            mixture += math.comb(samples, differing) * p**differing * (1 - p) ** (samples - differing) * odd
            for _ in range(2):
                up, down = odd * (1 - share), odd * share
                odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
        tails = np.cumsum(mixture[::-1])[::-1]
        return int(np.flatnonzero(tails > 1e-8)[-1])

    def samples_of_all(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The samples of many sets, one row for each; no set is empty."""
        starts = np.cumsum(counts) - counts
        found = np.empty((len(self._factors), len(counts)), np.uint64)
        products = np.empty_like(values)
        for n, factor in enumerate(self._factors):
            np.multiply(values, factor, out=products)
            np.minimum.reduceat(products, starts, out=found[n])
        return found.T

    def samples(self, found: np.ndarray) -> np.ndarray:
        """The samples of one set."""
        return self.samples_of_all(found, np.array([len(found)]))[0]

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """One key per band, for each row of samples; keys of different bands differ as well."""
        grid = samples.reshape(-1, self.bands, self.rows)
        folded = np.broadcast_to(mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * _STEP), grid.shape[:2])
        for n in range(self.rows):
            folded = mixed(folded * _STEP + grid[:, :, n])
        return folded.view(np.int64)

    def sketches(self, samples: np.ndarray) -> list[bytes]:
        """For each row of samples: every sample flips one bit, which gives the parity bitmap of the sample set."""
        places = (mixed(samples + self._salts) % np.uint64(self.bits)).astype(np.int64)
        places += np.arange(len(samples))[:, None] * self.bits
        parity = np.bincount(places.ravel(), minlength=len(samples) * self.bits) & 1
        packed = np.packbits(parity.astype(np.uint8).reshape(len(samples), self.bits), axis=1)
        return [row.tobytes() for row in packed]

    def sketch(self, samples: np.ndarray) -> bytes:
        return self.sketches(samples[None, :])[0]

    def may_be_similar(self, odd_bits: np.ndarray) -> np.ndarray:
        return odd_bits <= self.most_odd_bits

    def sizes_agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = shared_count(a, b)
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


def sketch_words(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
