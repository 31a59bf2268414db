"""Byte n-grams of texts as integers, and a table of them that looks up whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# ASCII other than letters becomes white space; all bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
# Bytes of text looked up together.
GROUP = 1 << 18


def letters_of(text: str) -> bytes:
    """Lower-cased text with runs of ASCII non-letters as single spaces."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


class GramTable:
    """Distinct integers below 2**63 -> their row numbers, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slots] == -1
            spot, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[spot], self.rows[spot] = keys[left[placed]], left[placed]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, slots = left[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 for those not in the table."""
        slots = self._slot(codes)
        held, rows = self.keys[slots], self.rows[slots]
        open_ = np.flatnonzero((held != codes) & (held != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            rows[open_] = np.where(held == codes[open_], self.rows[slots[open_]], -1)
            open_ = open_[(held != codes[open_]) & (held != -1)]
        return rows


def codes_of(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes up to each byte as one integer; the first ``length - 1`` have too few."""
    codes = data.astype(np.int64)
    for back in range(1, length):
        codes[back:] |= data[:-back].astype(np.int64) << (8 * back)
    return codes


def groups(texts: Iterable[bytes], context: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in arrays of about ``GROUP`` bytes: (bytes, text numbers, starts, ends).

    ``context`` spaces stand before every text; one longer than a group comes in pieces that
    repeat the bytes before them. Starts and ends leave both out.
    """
    parts: list[bytes] = []
    spans: list[tuple[int, int, int]] = []
    held = 0

    def flush():
        number, start, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        return np.frombuffer(b"".join(parts), np.uint8), number, start, end

    for i, text in enumerate(texts):
        padded = b" " * context + text
        for at in range(0, len(text), GROUP):
            piece = padded[at : at + context + GROUP]
            if held and held + len(piece) > GROUP:
                yield flush()
                parts, spans, held = [], [], 0
            parts.append(piece)
            spans.append((i, held + context, held + len(piece)))
            held += len(piece)
    if spans:
        yield flush()


def sums(values: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
    """Add the values (one row per byte) of every span to the row of its text."""
    borders = np.stack([start, end], axis=1).reshape(-1)
    ended = np.concatenate([values, np.zeros_like(values[:1])])  # a span may end at the last byte
    np.add.at(out, number, np.add.reduceat(ended, borders, axis=0, dtype=np.float64)[::2])
