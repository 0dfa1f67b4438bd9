"""Word shingles as 64-bit hashes, their MinHash samples, and odd sketches of those (numpy, inside tasks)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UP, _LOW)


def words_of(text: str | None) -> list[str]:
    """Words between [ \\t-\\r], A-Z lower-cased."""
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(_ASCII_LOWER))


class WordHashes(dict):
    """64-bit hashes of words; keeps a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
    return mixed(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words make one shingle of all, no words none."""
    return np.unique(windows(h, min(k, len(h)))) if len(h) else h


class MinHash:
    """MinHash samples in bands of rows, and the odd sketch of all samples."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands * rows, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of the shingles under each function, in blocks so that memory stays bounded."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 2048):
            least = np.minimum(least, (self.a[:, None] * (shingles[None, i : i + 2048] ^ self.salt[:, None])).min(axis=1))
        return mixed(least)

    def samples_of(self, shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The samples of several sets, which lie end to end in shingles and start at first: a row for each."""
        out = np.empty((len(first), len(self.a)), np.uint64)
        for k, (a, salt) in enumerate(zip(self.a, self.salt)):
            out[:, k] = np.minimum.reduceat(a * (shingles ^ salt), first)
        return mixed(out)

    def band_keys_of(self, samples: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each row of samples."""
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (len(samples), self.bands))
        for row in range(self.rows):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, row :: self.rows])
        return keys.view(np.int64)

    def odd_sketches(self, samples: np.ndarray) -> np.ndarray:
        """The odd sketch of each row of samples."""
        n = len(samples)
        at = (mixed(samples ^ self.salt) % np.uint64(self.bits)).astype(np.int64) + np.arange(n)[:, None] * self.bits
        odd = (np.bincount(at.ravel(), minlength=n * self.bits) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64).reshape(n, -1)

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in samples.reshape(self.bands, self.rows).T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
        return out.view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmap of the samples as words of 64 bits (Mitzenmacher, Pagh, Pham 2014)."""
        at = mixed(samples ^ self.salt) % np.uint64(self.bits)
        odd = (np.bincount(at.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


def most_unlike(bits: int, samples: int, similarity: float) -> int:
    """The number of unequal sketch bits that pairs of this similarity have in the mean."""
    return round(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))
