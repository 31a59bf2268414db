"""Near-duplicates by SimHash: fingerprints linked through a grid of segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.graph import components
from cadenza.llm.text import short_batches, type_of
from cadenza.plans.materialize import by_shuffle, cut

SEED = 42
# Shingles turned into single bits at a time, which bounds the memory a very long text needs.
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of a UTF-8 text, as a signed number.

    A-Z count as a-z. A bit is 1 if set in over half the shingles' XXH64 values, repeats
    included. Fewer than ``width`` words are one shingle; no words give 0.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - width + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit into a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, fp) per row; a null text has no words. A map over Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [fingerprint(x.as_py() or b"", width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.int64())], ["id", "text_hash", "fp"])

    short_batches(docs.sparkSession)
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, f"id {type_of(rows, 'id')}, text_hash long, fp long")


# The even bits of a word.
EVEN = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """Bits set in each of the 32 two-bit segments, packed into two bits each.

    The Manhattan distance of two such vectors is never above the Hamming distance.
    """
    even = F.lit(EVEN)
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def grid_cells(fp: Column) -> Column:
    """The grid points within Manhattan distance 1 of a fingerprint's segment counts (49 on average).

    Counts of 0 and 1 differ in the low bit of their segment, counts of 1 and 2 in both.
    """
    counts = segment_counts(fp)
    segments = F.sequence(F.lit(0), F.lit(62), F.lit(2))

    def field(s: Column) -> Column:
        return F.call_function("shiftrightunsigned", counts, s).bitwiseAND(F.lit(3))

    def flipped(s: Column, bits: int) -> Column:
        return counts.bitwiseXOR(F.call_function("shiftleft", F.lit(bits).cast("long"), s))

    zero_one = F.transform(F.filter(segments, lambda s: field(s) < 2), lambda s: flipped(s, 1))
    one_two = F.transform(F.filter(segments, lambda s: field(s) > 0), lambda s: flipped(s, 3))
    return F.concat(F.array(counts), zero_one, one_two)


def links(groups: DataFrame) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fp`` that keep every group of fingerprints
    linked that differ in 2 bits or fewer.

    1. Grid range-join. Two vectors within Manhattan distance 2 have a grid point within 1 of
       both, so each fingerprint goes to the grid points within 1 of its own. Only those that
       meet another one there go on. The work is 49 rows a fingerprint, not a square.
    2. Exact check, inside each shared grid point. Fingerprints are within 2 bits if and only if
       some word is within 1 bit of both, and that word's counts are a grid point that both went
       to. Those around one word are within 2 bits of each other, so all are linked to the
       smallest one, and no pairs are made however many they are.

    All joins go by a shuffle: Spark takes an exploded table to be as small as what it is made of.
    """
    cells = groups.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    met = cells.join(by_shuffle(shared.select("cell")), "cell")
    words = F.array_append(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), s))),
        F.col("fp"),
    )
    around = met.select("fp", F.explode(F.filter(words, lambda w: segment_counts(w) == F.col("cell"))).alias("word"))
    around = cut(around, "around")
    first = around.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w")
    return around.join(by_shuffle(first), "word").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """``fingerprints`` plus root, the same for linked fingerprints, and component_id, its smallest id.

    Equal fingerprints are folded first, so copies cost one row each and no links.
    """
    groups = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = cut(components(links(groups)).withColumnRenamed("node", "fp"), "roots")
    # the roots themselves are not among the nodes
    linked = roots.union(roots.select("root", "root").distinct())
    ids = linked.join(by_shuffle(groups), "fp").groupBy("root").agg(F.min("least").alias("linked_least"))
    linked = linked.join(by_shuffle(ids), "root").select("fp", "root", "linked_least")
    known = groups.join(by_shuffle(linked), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("linked_least")).alias("component_id")
    )
    return rows.join(by_shuffle(known), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: fingerprints at 2 or fewer differing bits are linked,
    and component_id is the smallest id that can be reached, the row's own included.

    Null and wordless texts have fingerprint zero and are linked like any other. A null id is
    never the smallest; a component of such rows only has a null one. Rows repeating an id stay
    as they are. An empty table gives an empty one; other columns are not read.
    """
    found = _grouped(cut(fingerprints(docs, width, id_column, text_column), "fingerprints"))
    return found.select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns: the one with the smallest id.

    Among rows of that id the smallest text hash decides, and of rows alike in both any one stays.
    Rows without an id stay only where their component has no other. Columns of any name stay.
    """
    found = _grouped(cut(fingerprints(docs, width, id_column, text_column), "fingerprints"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("m"))
    first = cut(first.select(F.col("m.id").alias("kept_id_"), F.col("m.text_hash").alias("kept_hash_")), "kept")
    # the row as one column, so that its names cannot clash
    hashed = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("kept_id_")) & (F.col("text_hash") == F.col("kept_hash_"))
    return hashed.join(by_shuffle(first), same, "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")
