"""Simple-8b: integers packed into 64-bit words, a selector saying how many and how wide.

The four high bits of a word are its selector, the rest holds as many values as fit at that
width, the first in the lowest bits. A value of more than 60 bits is an escape: its word has
selector 0 and an index into a list of whole values. Values come in blocks, no word crosses the
end of one, and the word offset of every block is stored, so blocks can be read alone and all
words of one selector are unpacked at once.

Layout of ``pack``, little-endian: counts of values, of blocks, of words, of escapes and the
block size (uint32 each), block offsets in words (uint32, one more than blocks), padding to 8
bytes, words (uint64), escaped values (uint64).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 4096
# Fixed values: (width in bits, values per word), from selector 1 on; selector 0 is the escape.
WIDTHS = (
    (0, 120), (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8),
    (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1),
)
_HEADER = struct.Struct("<5I")
_COUNTS = np.array([1] + [n for _, n in WIDTHS], np.int64)


def _choose(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position, the selector that takes the most values from there, and where it ends."""
    blocks = -(-len(values) // block)
    room = max(n for _, n in WIDTHS)
    bits = np.zeros((blocks, block + room), np.uint8)  # zeros behind each block: its last word may be part full
    flat = np.zeros(blocks * block, np.uint8)
    flat[: len(values)] = np.frexp(values.astype(np.float64))[1]
    bits[:, :block] = flat.reshape(blocks, block)
    widest, reach = {1: bits}, 1
    for n in sorted({n for _, n in WIDTHS} - {1}):  # the most bits among the next n values
        while reach * 2 < n:
            widest[reach * 2] = np.maximum(widest[reach][:, :-reach], widest[reach][:, reach:])
            reach *= 2
        half = widest[reach]
        widest[n] = np.maximum(half[:, : half.shape[1] - (n - reach)], half[:, n - reach :])
    selector = np.zeros((blocks, block), np.uint8)
    for s in range(len(WIDTHS), 0, -1):
        width, n = WIDTHS[s - 1]
        selector[widest[n][:, :block] <= width] = s
    selector = selector.reshape(-1)[: len(values)]
    at = np.arange(len(values), dtype=np.int64)
    return selector, np.minimum(np.minimum(at + _COUNTS[selector], (at // block + 1) * block), len(values))


def pack(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Any unsigned integers below 2**64 as bytes."""
    values = np.ascontiguousarray(values, np.uint64)
    total = len(values)
    blocks = -(-total // block)
    starts: list[int] = []
    selector = np.zeros(0, np.uint8)
    if total:
        selector, after = _choose(values, block)
        jump, at = after.tolist(), 0
        while at < total:
            starts.append(at)
            at = jump[at]
    start = np.array(starts, np.int64)
    kind = selector[start] if total else selector
    words = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(int(_COUNTS.max()), np.uint64)])
    for s, (width, n) in enumerate(WIDTHS, 1):
        if width and len(here := np.flatnonzero(kind == s)):
            spots = start[here, None] + np.arange(n)
            ends = np.minimum((start[here] // block + 1) * block, total)
            parts = np.where(spots < ends[:, None], padded[spots], np.uint64(0))
            words[here] |= np.bitwise_or.reduce(parts << (np.arange(n, dtype=np.uint64) * np.uint64(width)), axis=1)
    escapes = np.flatnonzero(kind == 0)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64)
    offsets = np.append(np.searchsorted(start, np.arange(blocks, dtype=np.int64) * block), len(words)).astype("<u4")
    head = _HEADER.pack(total, blocks, len(words), len(escapes), block) + offsets.tobytes()
    head += bytes(-len(head) % 8)
    return head + words.astype("<u8").tobytes() + values[start[escapes]].astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of ``pack``, as uint64."""
    total, blocks, n_words, n_escapes, block = _HEADER.unpack_from(data)
    at = _HEADER.size
    offsets = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    at += -at % 8
    words = np.frombuffer(data, "<u8", n_words, at)
    escaped = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_words)
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[kind]
    before = np.cumsum(counts) - counts
    first = np.repeat(np.arange(blocks, dtype=np.int64) * block - before[offsets[:-1]], np.diff(offsets))
    start = before + first
    out = np.zeros(total, np.uint64)
    for s, (width, n) in enumerate(WIDTHS, 1):
        if width and len(here := np.flatnonzero(kind == s)):
            spots = start[here, None] + np.arange(n)
            ends = np.minimum((start[here] // block + 1) * block, total)
            parts = (words[here, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            inside = spots < ends[:, None]
            out[spots[inside]] = parts[inside]
    if n_escapes:
        out[start[kind == 0]] = escaped[words[kind == 0].astype(np.int64)]
    return out
