"""Words of Arrow texts and hashes of the windows they make, for tasks that hold a part of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Odd numbers to multiply by, one for each half of a hash.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of texts (large strings, no nulls), end to end, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    kept = pc.not_equal(flat, "")
    of_text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return flat.filter(kept), np.bincount(of_text[kept.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes a word, each distinct word hashed once: an array of two rows."""
    coded = words.dictionary_encode()
    raw = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.large_binary()).to_pylist()))
    halves = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(halves[coded.indices.to_numpy()].T)


def window_hashes(hashes: np.ndarray, length: int, half: int) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` words, in one of two independent halves."""
    lane, n = hashes[half], hashes.shape[1] - length + 1
    out = lane[: max(n, 0)].copy()
    for i in range(1, length if n > 0 else 0):
        out *= np.uint64(_FACTORS[half])
        out += lane[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` values the place of its smallest, the first of equal ones."""
    n = len(values) - width + 1
    place = np.arange(max(n, 0))
    best = values[: max(n, 0)].copy()
    for i in range(1, width):
        here = values[i : i + len(best)]
        less = here < best
        best[less] = here[less]
        place[less] = np.flatnonzero(less) + i
    return place
