"""Periodic runs of words by common prefixes over a difference cover, on harmonic grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.text import short_batches, type_of
from cadenza.llm.windows import split_words

# A difference cover. Any two places have a shift below CYCLE that brings both to
# places that are 0, 1 or 3 modulo 7.
CYCLE, COVER = 7, (0, 1, 3)
SHIFT = np.array([[next(d for d in range(CYCLE) if (i + d) % CYCLE in COVER and (j + d) % CYCLE in COVER) for j in range(CYCLE)] for i in range(CYCLE)])
# Words of short texts handled together, and grid points at a time.
GROUP_WORDS, GRID_POINTS = 1 << 19, 1 << 20
MIN_WORDS, MIN_PERIODS = 24, 3


class CommonPrefixes:
    """Lengths of the longest common prefixes of any two suffixes of ``numbers``.

    Only suffixes at cover places are sorted: first by their 7 numbers, then by doubling those
    still equal. The common prefixes of neighbours in that order go into a sparse table of
    minima. Any other two suffixes are compared number by number for at most 6 steps, until both
    are at cover places. About 70 + 4 log2(n) bytes a number.
    """

    def __init__(self, numbers: np.ndarray):
        """``numbers`` are dense from 0."""
        self.n = n = len(numbers)
        top = int(numbers.max(initial=-1)) + 1
        # behind the end stand numbers that occur once, so no common prefix passes it
        self.numbers = numbers = np.concatenate([numbers, np.arange(top, top + 3 * CYCLE)]).astype(np.int64)
        total = n + CYCLE
        self.at = at = np.flatnonzero(np.isin(np.arange(total) % CYCLE, COVER))
        self.slot = np.full(total, -1, np.int32)
        self.slot[at] = np.arange(len(at), dtype=np.int32)
        order, levels = self._sorted(top + 3 * CYCLE)
        self.order = order
        self.place = np.empty(len(at), np.int32)
        self.place[order] = np.arange(len(at), dtype=np.int32)
        self.common = self._of_neighbours(order, levels)
        self.minima = None

    def _sorted(self, values: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cover places in order of their suffixes, and their ranks by the first 7, 14, 28, ... numbers."""
        at, m = self.at, len(self.at)
        bits = max(1, (values - 1).bit_length())
        keys = []
        for x in range(0, CYCLE, 63 // bits):
            key = np.zeros(m, np.int64)
            for y in range(x, min(CYCLE, x + 63 // bits)):
                key = key << bits | self.numbers[at + y]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        head = np.ones(m, bool)
        head[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        rank = np.empty(m, np.int64)
        rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
        levels, length = [rank.astype(np.int32)], CYCLE
        while len(rest := np.flatnonzero(~(head & np.append(head[1:], True)))):
            some = order[rest]
            key = rank[some] * m + rank[self.slot[at[some] + length]]
            by_key = np.argsort(key, kind="stable")
            some, key = some[by_key], key[by_key]
            new = np.append(True, key[1:] != key[:-1])
            order[rest], head[rest] = some, new
            rank[some] = rest[np.flatnonzero(new)[np.cumsum(new) - 1]]
            levels.append(rank.astype(np.int32))
            length *= 2
        return order, levels

    def _of_neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        a, b = self.at[order[:-1]], self.at[order[1:]]
        got = np.zeros(len(a), np.int64)
        like = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
        la, lb, lg = a[like], b[like], got[like]
        for k in range(len(levels) - 1, -1, -1):
            lg += (levels[k][self.slot[la + lg]] == levels[k][self.slot[lb + lg]]) * (CYCLE << k)
        got[like] = lg
        live = np.arange(len(a))
        for _ in range(CYCLE - 1):
            live = live[self.numbers[a[live] + got[live]] == self.numbers[b[live] + got[live]]]
            got[live] += 1
        return np.concatenate([[0], got]).astype(np.int32)

    def _table(self) -> np.ndarray:
        m = len(self.common)
        table = np.zeros((max(1, m.bit_length()), m), np.int32)
        table[0] = self.common
        for k in range(1, len(table)):
            half, width = 1 << (k - 1), m - (1 << k) + 1
            if width > 0:
                np.minimum(table[k - 1, :width], table[k - 1, half : half + width], out=table[k, :width])
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each two different places the length of what both suffixes begin with."""
        if self.minima is None:
            self.minima = self._table()
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(self.numbers[i] == self.numbers[j])
        i, j = i[live], j[live]
        shift = SHIFT[i % CYCLE, j % CYCLE]
        got, go = np.minimum(shift, 1), np.ones(len(live), bool)
        for x in range(1, CYCLE - 1):
            go &= (x >= shift) | (self.numbers[i + x] == self.numbers[j + x])
            got += go & (x < shift)
        out[live] = got
        i, j, live, got = i[go] + shift[go], j[go] + shift[go], live[go], got[go]
        a, b = self.place[self.slot[i]], self.place[self.slot[j]]
        first, last = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out[live] = got + np.minimum(self.minima[k, first], self.minima[k, last - (1 << k) + 1])
        return out


def _grid_runs(lce: CommonPrefixes, start: int, n: int, min_words: int, min_periods: int) -> np.ndarray:
    """(start, length, period) of the runs of the text at places start..start+n, by start, then period.

    Of a run with period q, places q apart are alike over at least (min_periods - 1) * q words, so
    a multiple of q lies among its first q places. For each q only the multiples of q are asked:
    n log n in all. Where one has a long enough common prefix with the place q on, the run's first
    place is found by bisection. Stretches found under multiples of their period go.
    """
    found = []
    q0, top = 1, n // min_periods
    while q0 <= top:
        upto = np.cumsum((n - 1) // np.arange(q0, min(top, q0 + GRID_POINTS) + 1))
        periods = np.arange(q0, q0 + max(1, int(np.searchsorted(upto, GRID_POINTS))))
        periods = periods[periods <= top]
        q0 = int(periods[-1]) + 1
        points = (n - 1) // periods
        q = np.repeat(periods, points)
        nth = np.arange(len(q)) - np.repeat(np.cumsum(points) - points, points)
        at = start + nth * q
        got = lce(at, at + q)
        need = np.maximum(min_words - 2 * q + 1, (min_periods - 2) * q + 1)
        earlier = np.concatenate([[0], got[:-1]])
        first = np.flatnonzero((got >= need) & ((nth == 0) | (earlier < q)))
        q, at, got = q[first], at[first], got[first]
        low, high = np.maximum(start, at - q + 1), at.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            reaches = lce(middle, middle + q[open_]) >= at[open_] - middle
            high[open_[reaches]] = middle[reaches]
            low[open_[~reaches]] = middle[~reaches] + 1
        length = at + got + q - low
        long = length >= np.maximum(min_words, min_periods * q)
        found.append(np.stack([low - start, length, q], axis=1)[long])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """The runs of each text; ``words`` are the texts' words as numbers, end to end, ``sizes`` long.

    Words are numbered anew per text, so that no common prefix leaves a text and texts do not meet
    in the order of suffixes. A run makes two places alike for some words; less a shift, so do two
    cover places, and then two neighbours in their order. Texts without such neighbours have no run.
    """
    none = np.zeros((0, 3), np.int64)
    out, starts = [none] * len(sizes), np.cumsum(sizes) - sizes
    if not len(words):
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    numbers = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)[1]
    lce = CommonPrefixes(numbers)
    alike = min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1))
    some = lce.at[lce.order[lce.common >= max(1, alike - (CYCLE - 1))]]
    for t in np.unique(text[some]):
        out[t] = _grid_runs(lce, int(starts[t]), int(sizes[t]), min_words, min_periods)
    return out


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words joined, without those that a run holds behind its first period."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    return " ".join([w for w, drop in zip(words, gone.tolist(), strict=True) if not drop])


def periodic_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The periodic runs of every text: (id, n_words, runs, collapsed).

    Words lie between ASCII white space. A run is a stretch whose words are equal to those
    ``period`` before, as far as that goes in both directions, with its smallest period; it has
    at least ``min_words`` words and ``min_periods`` periods (at least 3). ``runs`` holds them as
    (start, length, period), words counted from 0, by start, then period. ``collapsed`` is the
    text without the words that any run holds behind its first period.

    A map over the documents without a shuffle. Short texts share one order of suffixes, a very
    long text has its own; its memory grows with its words. Null texts have no words. Repeated
    rows and null ids are each handled by themselves, an empty table gives an empty one, and
    other columns are not read.
    """
    if min_periods < 3:
        raise ValueError("runs have at least three periods")
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            held, at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), 0
            while at < len(texts):
                # a word and a blank are two bytes at least
                group = texts.slice(at, max(1, int(np.searchsorted(held, held[at] + 2 * GROUP_WORDS)) - at))
                ids = batch.column(0).slice(at, len(group))
                at += len(group)
                words, sizes = split_words(group)
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                found, start = runs_of_texts(codes, sizes, min_words, min_periods), 0
                kept_texts = []
                for size, runs in zip(sizes.tolist(), found, strict=True):
                    kept_texts.append(collapsed(words.slice(start, size).to_pylist(), runs))
                    start += size
                ends = np.cumsum([0, *map(len, found)])
                columns = np.concatenate(found)
                items = pa.StructArray.from_arrays([pa.array(c) for c in columns.T.copy()], fields=list(run))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), lists, pa.array(kept_texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    schema = f"id {type_of(rows, 'id')}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(find, schema).withColumnRenamed("id", id_column)


def strongest(runs: Column) -> Column:
    """The run with most periods (exactly compared), of such the first, of such the shortest period; null without runs."""
    kind = "struct<start: long, length: long, period: long>"

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(kind), better)


def with_periodic_tails(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text): one document of ten, drawn by the checksum of its id, is made to repeat itself from some word on.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, a document with h mod 10 = 0
    goes on from word a = g mod n with the words from a on, over and over, p = 1 + (n - a) div
    (3 + g mod 8) of them; other texts, those of null ids and those without words stay.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text_column), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col(id_column).cast("string"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda k: F.element_at(w, a + k % p + 1))
        return F.when(n > 0, F.concat_ws(" ", F.concat(F.slice(w, 1, a), tail))).otherwise("")

    # as the item of an array, the words are split once and not for each of them
    edited = F.element_at(F.transform(F.array(words), repeating), 1)
    return docs.select(id_column, F.when(h % 10 == 0, edited).otherwise(F.col(text_column)).alias(text_column))
