"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import ceil, gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.ordering import number_within

# Slots that are scheduled together, at least; a mix has no more than MAX_PERIODS of them.
PERIOD = 65_536
MAX_PERIODS = 4_096
# Weights that no smaller whole numbers give are shares of this many.
RESOLUTION = 2**30
BLOCK_DOCS = 16
# Weights grow with this power of a source's size where none are given.
POWER = 0.7
_SLOTS = "key string, block long, slot long, release long, deadline long"


def whole_weights(weights: Mapping[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """The weights as whole numbers of the same ratios, as the decimals they are written as.

    Where these would add up to over ``resolution``, they are shares of it instead, each at least
    1 and within 1 of its exact value but for what the raised ones take.
    """
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    common = gcd(*out.values())
    out = {s: w // common for s, w in out.items()}
    if (total := sum(out.values())) <= resolution:
        return out
    return {s: max(1, w * resolution // total) for s, w in out.items()}


class Windows:
    """Pfair windows of the blocks of all sources, from whole weights and numbers of blocks.

    After a share v of the mix a source is due min(blocks, weight * v) blocks; all sources
    together make the slot t(v). A source that has had all its blocks leaves, and the others
    share its slots by their weights. Block k of a source may run from slot floor(t(k / weight))
    and must by slot ceil(t((k + 1) / weight)). As what is due adds up to the slot at every slot,
    no stretch of slots has more blocks that must lie in it than slots, so one block per slot,
    earliest deadline first, keeps every deadline, and each source stays less than one block from
    its due.
    """

    def __init__(self, weights: list[int], blocks: list[int]) -> None:
        self.weights, self.blocks = weights, blocks
        leaving = sorted(range(len(weights)), key=lambda i: Fraction(blocks[i], weights[i]))
        self.left = [Fraction(blocks[i], weights[i]) for i in leaving]
        self.last = np.array([blocks[i] for i in leaving], np.int64)
        self.per = np.array([weights[i] for i in leaving], np.int64)
        # before the j-th source leaves, t(v) = gone[j] + v * rate[j]
        self.gone, self.rate = [0], [sum(weights)]
        for i in leaving:
            self.gone.append(self.gone[-1] + blocks[i])
            self.rate.append(self.rate[-1] - weights[i])
        self.ends = [g + v * r for g, v, r in zip(self.gone, self.left, self.rate)]

    @property
    def slots(self) -> int:
        return sum(self.blocks)

    def times(self, source: int, k: np.ndarray, up: bool) -> np.ndarray:
        """t(k / weight) of the source's blocks, rounded down or up."""
        w = self.weights[source]
        # of each leaving, the first of this source's blocks that is not before it
        behind = -(-(self.last * w) // self.per)
        j = np.minimum(np.searchsorted(behind, k, "right"), len(self.left) - 1)
        gone, product = np.array(self.gone, np.int64)[j], k * np.array(self.rate, np.int64)[j]
        return gone + (-(-product // w) if up else product // w)

    def due(self, slot: int) -> list[int]:
        """Whole blocks due to each source by the slot, which is before the end."""
        j = bisect_right(self.ends, slot)
        if j == len(self.left):
            return list(self.blocks)
        return [min(n, w * (slot - self.gone[j]) // self.rate[j]) for n, w in zip(self.blocks, self.weights)]

    def after(self, start: int, given: list[int], end: int) -> list[int]:
        """Blocks that each source has had by slot ``end``, with those ``given`` by slot ``start``.

        Blocks whose deadline is not behind ``end`` have run. Of each source one more may have:
        as in a run by earliest deadline these are taken in order of deadlines, as long as from
        each slot on there are enough slots for all taken that are released there or later.
        """
        due = self.due(end)
        if end == self.slots:
            return due
        out = [max(n, g) for n, g in zip(due, given)]
        room = np.arange(end - start, 0, -1, dtype=np.int64)
        released = np.zeros(end - start, np.int64)
        more = []
        for i, (g, n) in enumerate(zip(given, out)):
            released += np.bincount(np.maximum(self.times(i, np.arange(g, n), False) - start, 0), minlength=end - start)
            if n == due[i] < self.blocks[i]:
                at = int(self.times(i, np.array([n]), False)[0])
                if at < end:
                    more.append((int(self.times(i, np.array([n + 1]), True)[0]), i, max(at - start, 0)))
        room -= released[::-1].cumsum()[::-1]
        # only the least room between two releases matters
        at = sorted({0} | {r for _, _, r in more})
        least = np.array([room[a + 1 : b + 1].min() for a, b in zip([-1, *at], at)])
        group = {r: j for j, r in enumerate(at)}
        missing = end - sum(out)
        for _, i, r in sorted(more):
            if missing and least[: group[r] + 1].min() >= 1:
                least[: group[r] + 1] -= 1
                out[i] += 1
                missing -= 1
        return out

    def schedule(self, start: int, given: list[int], end: int, then: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, block, slot, release, deadline) of the slots from ``start`` to ``end``, between
        the numbers of blocks ``given`` before and ``then`` after; ties of deadlines by source."""
        ready: list[tuple[int, int, int, int]] = []
        blocks = [self._blocks(i, given[i], then[i]) for i in range(len(given))]
        waiting = [(x[0], i, x) for i, b in enumerate(blocks) if (x := next(b, None))]
        heapq.heapify(waiting)
        for slot in range(start, end):
            while waiting and waiting[0][0] <= slot:
                _, i, (release, deadline, k) = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, i, k, release))
            deadline, i, k, release = heapq.heappop(ready)
            yield i, k, slot, release, deadline
            if x := next(blocks[i], None):
                heapq.heappush(waiting, (x[0], i, x))

    def _blocks(self, source: int, first: int, end: int, step: int = 4096) -> Iterator[tuple[int, int, int]]:
        for at in range(first, end, step):
            k = np.arange(at, min(end, at + step))
            yield from zip(self.times(source, k, False).tolist(), self.times(source, k + 1, True).tolist(), k.tolist())


def periods(windows: Windows, period: int = PERIOD) -> Iterator[tuple[int, list[int], int, list[int]]]:
    """(start, blocks given before, end, blocks given after) of stretches that are scheduled by themselves."""
    period = max(period, -(-windows.slots // MAX_PERIODS))
    given = [0] * len(windows.blocks)
    for start in range(0, windows.slots, period):
        end = min(windows.slots, start + period)
        then = windows.after(start, given, end)
        yield start, given, end, then
        given = then


def _key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _draw(id_column: str) -> Column:
    """The order of documents within their source: by a hash of their ids."""
    return F.xxhash64(F.lit("mix"), F.col(id_column))


def plan_mix(docs: DataFrame, weights: Mapping[str, float] | None, block_docs: int, source_column: str) -> tuple[list[str], Windows]:
    """The sources that have documents and a weight, and the windows of their blocks.

    Sources are counted in the tasks first; one row per source comes to the driver, as one weight
    per source does.
    """
    found = docs.groupBy(_key(F.col(source_column)).alias("s")).count().collect()
    sizes = {r["s"]: r["count"] for r in found}
    wanted = {s: n**POWER for s, n in sizes.items()} if weights is None else {s: w for s, w in weights.items() if s in sizes and w > 0}
    names = sorted(wanted)
    blocks = [-(-sizes[s] // block_docs) for s in names]
    # block * weight stays within 63 bits
    whole = whole_weights(wanted, min(RESOLUTION, 2**61 // (max(blocks) + 1))) if names else {}
    return names, Windows([whole[s] for s in names], blocks)


def slot_table(spark: SparkSession, names: list[str], windows: Windows, period: int = PERIOD) -> DataFrame:
    """(key, block, slot, release, deadline) of every block, each period scheduled in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slots = windows.schedule(row["start"], row["given"], row["end"], row["then"])
                while part := list(islice(slots, 10_000)):
                    source, *numbers = zip(*part)
                    columns = [pa.array([names[i] for i in source], pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "block", "slot", "release", "deadline"])

    # at most MAX_PERIODS rows of two numbers per source
    rows = list(periods(windows, period))
    if not rows:
        return spark.createDataFrame([], _SLOTS)
    stretches = spark.createDataFrame(rows, "start long, given array<long>, end long, then array<long>")
    return stretches.repartitionByRange(min(len(rows), 8 * spark.sparkContext.defaultParallelism), "start").mapInArrow(run, _SLOTS)


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """Every document's place in the mix: (id, source, block, slot, release, deadline, drawn).

    A source's documents, in an order drawn by hash of their ids, make blocks of ``block_docs``;
    each slot of the mix has one block, by earliest deadline in ``Windows``, so after any number
    of slots each source is less than one block from its due. ``weights`` maps sources to target
    weights; without it they follow the ``POWER`` of the sources' sizes, which lowers large
    ones. ``drawn`` is true for blocks released before the first source has used up its
    documents: until then, and no longer, all weights are met. A source that is used up leaves,
    and the others go on with their weights renormalised, until all documents are placed.
    Sources without a weight have null slots and are not drawn.

    A source of any size is numbered over many tasks. A null source is the source "" (and
    counts together with one so named); null ids are one id. Rows repeating an id and source are
    each placed, next to each other. An empty table gives an empty one. Other columns are not
    read.
    """
    names, windows = plan_mix(docs, weights, block_docs, source_column)
    # until the first source leaves
    end = ceil(min(windows.ends)) if names else 0
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), _key(F.col(source_column)).alias("key"), _draw(id_column).alias("draw"))
    placed = number_within(rows, "key", ["draw", "id"], "mix")
    placed = placed.withColumn("block", F.floor(F.col("index_") / block_docs).cast("long"))
    slots = slot_table(docs.sparkSession, names, windows)
    # blocks grow with the corpus, so their join does not depend on their size
    placed = placed.join(slots.hint("merge"), ["key", "block"], "left")
    return placed.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "block",
        "slot",
        "release",
        "deadline",
        F.coalesce(F.col("release") < end, F.lit(False)).alias("drawn"),
    )


def drawn_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, all their columns.

    The drawn documents of a source are those up to its last drawn one in hash order, so one
    limit per source selects them where they lie, without a shuffle of the texts. Documents tied
    with the last one are drawn too.
    """
    found = mix(docs, weights, block_docs, id_column, source_column)
    limits = found.where("drawn").groupBy(_key(F.col(source_column)).alias("s")).agg(F.max(_draw(id_column)).alias("last"))
    drawn = F.lit(False)
    for row in limits.collect():  # one row per source
        drawn = drawn | ((_key(F.col(source_column)) == row["s"]) & (_draw(id_column) <= row["last"]))
    return docs.where(drawn)


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """All rows of ``docs`` whose source has a weight, all their columns, in order of their slots in ``mix``.

    Without given weights these are all rows. A source that is used up leaves the mix, and the
    others go on without it. Rows repeating an id and source stand where the first of them does.
    Columns of any name stay.
    """
    slots = mix(docs, weights, block_docs, id_column, source_column).where(F.col("slot").isNotNull())
    # as structs, ids can be null and equal
    key = F.struct(F.col(id_column).alias("id"), _key(F.col(source_column)).alias("s"))
    slots = slots.groupBy(key.alias("key_")).agg(F.min("slot").alias("slot_"))
    # the row as one column, so that its names cannot clash
    keyed = docs.select(F.struct("*").alias("row"), key.alias("mixed_"))
    # the slots grow with the corpus, so their join does not depend on their size
    placed = keyed.join(slots.hint("merge"), F.col("mixed_") == F.col("key_"))
    return placed.orderBy("slot_", "mixed_").select("row.*")
