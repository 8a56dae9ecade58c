"""Shingle sets and MinHash signatures of text batches with numpy."""

from __future__ import annotations

import numpy as np

from sparkmalt.llm.words import STEP, U, grams, inside, mix, split

_rng = np.random.Generator(np.random.PCG64(1729))
MASKS = _rng.integers(1, 2**63, 256, dtype=np.uint64)
FACTORS = _rng.integers(1, 2**62, 256, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct k-word shingles of each text after lowering A-Z, sorted; text i has first[i]..first[i + 1].

    A text of 1 to k - 1 words has its whole word sequence as one shingle, one without words has none.
    """
    w = split([t.lower() for t in texts])
    hashes, counts = w.hashes(), w.counts
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(inside(w.first, k, len(hashes)))
    values, owner = grams(hashes, k)[at], doc[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.zeros(len(short), dtype=np.uint64)
            for j, i in enumerate(short):
                for h in hashes[w.first[i] : w.first[i + 1]]:
                    whole[j] = whole[j] * STEP + h
            whole = mix(whole + counts[short].astype(np.uint64) * U(0xA0761D6478BD642F))
        values, owner = np.concatenate((values, whole)), np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """MinHash signatures, a row of n coordinates per text; empty sets have zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, n), dtype=np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            for c in range(n):
                x = (values ^ MASKS[c]) * FACTORS[c]
                out[full, c] = np.minimum.reduceat(x ^ (x >> U(29)), first[full])
    return out


def fingerprints(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of the sets, as rows of two words; they don't depend on order."""
    with np.errstate(over="ignore"):
        sums = np.zeros((len(values) + 1, 2), dtype=np.uint64)
        np.cumsum(mix(values), out=sums[1:, 0])
        np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), out=sums[1:, 1])
        return sums[first[1:]] - sums[first[:-1]]
