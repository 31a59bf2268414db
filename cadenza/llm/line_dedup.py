"""Line dedup: of lines within one edit of each other, only the earliest is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.plans.materialize import cut

# Shorter lines are only compared for equality. One edit makes other words of a very short line, so a
# caller may ask for more; by default lines of any length are compared.
MIN_CHARS = 1
# A line is cut into so many parts to find where it may differ from another one.
SEGMENTS = 16


def normal(line: Column | str) -> Column:
    """The form in which lines are compared: trimmed and lower-cased."""
    return F.lower(F.trim(line))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text_hash, lines): the text split at line feeds; a null text has no lines."""
    text = F.col(text_column).cast("string")
    lines = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), lines.alias("lines"))


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of which lines within one edit share one.

    Such lines have s and s or s + 1 characters. The edit leaves the first s div 2 characters
    alone, or the last s - s div 2. A line may be the shorter or the longer one.
    """
    keys = []
    for s in (n, n - 1):
        half = F.floor(s / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), s, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), s, F.substring(line, n - s + half + 1, s - half)))
    return F.array(*keys)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points as well-spread 64-bit numbers."""
    x = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


BASE = 0x9DDFEA08EB382D69


def prefix_hashes(line: str) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... characters: sums of code * BASE ** place, modulo 2 ** 64."""
    codes = _mixed(np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64))
    powers = np.cumprod(np.full(len(codes), BASE, np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])


def without(upto: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the line of ``upto`` without the ``size`` characters from each of ``start`` on: what
    follows moves down by as many places."""
    back = np.uint64(pow(BASE, -size, 1 << 64))
    return upto[start] + (upto[-1] - upto[start + size]) * back


def _segments(n: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a line's segments, cut for the shorter of two lines: the line itself, or,
    with ``longer`` 1, one without one of its ``n`` characters."""
    borders = (n - longer) * np.arange(SEGMENTS + 1, dtype=np.int64) // SEGMENTS
    return borders[:-1], borders[1:] + longer


def segment_keys(lines: DataFrame) -> DataFrame:
    """(line_id, key, longer, segment) for ``lines`` (line_id, line): hashes of the line without each
    of its segments.

    Lines within one edit have equal keys for the segment that the edit is in, cut for the
    shorter one's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for line in batch.column(1):
                upto = prefix_hashes(line.as_py())
                n = len(upto) - 1
                for longer in (0, 1):
                    start, end = _segments(n, longer)
                    key = np.empty(SEGMENTS, np.uint64)
                    for size in set((end - start).tolist()):
                        some = end - start == size
                        key[some] = without(upto, start[some], size)
                    salt = np.arange(SEGMENTS, dtype=np.uint64) + np.uint64((n - longer) * SEGMENTS)
                    keys.append(_mixed(key ^ _mixed(salt)))
            rows = len(batch)
            columns = [
                np.repeat(batch.column(0).to_numpy(), 2 * SEGMENTS), np.concatenate(keys).view(np.int64),
                np.tile(np.repeat(np.array([0, 1], np.int32), SEGMENTS), rows), np.tile(np.arange(SEGMENTS, dtype=np.int32), 2 * rows),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["line_id", "key", "longer", "segment"])

    return lines.select("line_id", "line").mapInArrow(run, "line_id long, key long, longer int, segment int")


def deletion_variants(lines: DataFrame) -> DataFrame:
    """(line_id, variant, at) for ``lines`` (line_id, line, segments): the line's own hash with place -1,
    and those of the line without each character of the given segments (array of (longer, segment))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants, places = [], [], []
            for line_id, line, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                upto = prefix_hashes(line.as_py())
                n = len(upto) - 1
                spans = []
                for x in wanted.as_py():
                    start, end = _segments(n, x["longer"])
                    spans.append(np.arange(start[x["segment"]], end[x["segment"]]))
                at = np.unique(np.concatenate(spans))
                variants.append(np.append(upto[-1:], without(upto, at, 1)))
                places.append(np.append(np.int32(-1), at.astype(np.int32)))
                ids.append(np.full(len(at) + 1, line_id.as_py(), np.int64))
            columns = [np.concatenate(ids), np.concatenate(variants).view(np.int64), np.concatenate(places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["line_id", "variant", "at"])

    return lines.select("line_id", "line", "segments").mapInArrow(run, "line_id long, variant long, at int")


def within_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or substituted character, or none, makes ``a`` to ``b``, in linear time."""
    low, high = 0, min(len(a), len(b))
    if a[:high] != b[:high]:  # the first character that differs
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    else:
        low = high
    return a[low + 1 :] == b[low + 1 :] or a[low:] == b[low + 1 :] or a[low + 1 :] == b[low:]


def _checked(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([within_one(x, y) for x, y in zip(left, right, strict=True)], dtype=bool)

    return check(a, b)


def near_lines(first: DataFrame, texts: DataFrame) -> DataFrame:
    """(line_id, earlier) for lines with an earlier one within one edit, the earliest found.

    ``first`` has (line_id, place) with a place that sorts by time; ``texts`` (line_id, line).
    Lines that become equal without their character at the same place differ there only; a line
    equal to another without a character lacks that one. So every group of equal keys needs its
    earliest member only, and no pairs are made. The edit distance is checked on the texts.

    Only characters of such segments are left out without which the line equals another one
    without its own; that is so for the segment with the edit.
    """
    segments = cut(segment_keys(texts), "segments")
    shared = segments.groupBy("key").agg(F.min("line_id").alias("a"), F.max("line_id").alias("b")).where("a <> b")
    open_ = segments.join(shared.select("key"), "key").groupBy("line_id").agg(F.collect_set(F.struct("longer", "segment")).alias("segments"))
    keys = cut(deletion_variants(texts.join(open_, "line_id")).join(first, "line_id"), "variants")
    one = F.struct("place", "line_id")
    changed = keys.where("at >= 0").groupBy("variant", "at").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b")
    by_change = keys.join(changed.select("variant", "at", "a"), ["variant", "at"]).where(F.col("place") > F.col("a.place"))
    lacking = keys.groupBy("variant").agg(F.min(F.when(F.col("at") < 0, one)).alias("short"), F.min(F.when(F.col("at") >= 0, one)).alias("long"))
    other = F.when(F.col("at") < 0, F.col("long")).otherwise(F.col("short"))
    by_lack = keys.join(lacking.where("short is not null and long is not null"), "variant").withColumn("a", other)
    by_lack = by_lack.where(F.col("place") > F.col("a.place"))
    earlier = by_change.select("line_id", "a").union(by_lack.select("line_id", "a")).groupBy("line_id").agg(F.min("a").alias("a"))
    pairs = earlier.select("line_id", F.col("a.line_id").alias("earlier"))
    checked = pairs.join(texts, "line_id").join(texts.withColumnsRenamed({"line_id": "earlier", "line": "earlier_line"}), "earlier")
    return checked.where(_checked(F.col("line"), F.col("earlier_line"))).select("line_id", "earlier")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (doc_id, text_hash, n_lines, n_copies, n_near, removed).

    A line goes if an earlier one, in order of document id and line number, equals it after
    trimming and lower-casing (``n_copies``), or, for lines of ``min_chars`` or more, is within
    one insertion, deletion or substitution of a character (``n_near``), whether or not that one
    goes itself. ``removed`` is the numbers of the lines that go, from 0. Blank lines stay.

    1. Lines are folded to distinct ones by hash with their first place.
    2. Distinct lines that share no half with another can have no near one and are done.
    3. ``near_lines`` on the texts of the rest, which narrows the place down further.

    A null text has no lines, an empty one has one blank line. Documents of equal id are ordered
    by hash of their texts, null ids come first; rows that repeat an id and text are one document
    and get equal rows. An empty table gives an empty one. Other columns are not read.
    """
    split = _lines(docs, id_column, text_column)
    line = normal("raw")
    lines = split.select("doc_id", "text_hash", F.posexplode("lines").alias("number", "raw")).select("doc_id", "text_hash", "number", line.alias("line"))
    lines = lines.where("line <> ''").withColumn("n", F.length("line"))
    place = F.struct("doc_id", "text_hash", "number")
    halves = F.when(F.col("n") >= min_chars - 1, _half_keys(F.col("line"), F.col("n")))
    hashed = lines.select(F.xxhash64("line").alias("line_id"), F.xxhash64(F.lit(1), "line").alias("check"), "n", place.alias("place"), halves.alias("halves"))
    first = hashed.groupBy("line_id", "check", "n").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))
    first = cut(first, "first-lines")

    halves = first.where(F.col("n") >= min_chars).select("line_id", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line_id").alias("a"), F.max("line_id").alias("b")).where("a <> b")
    open_ids = halves.join(shared.select("half"), "half").select("line_id").distinct()
    open_lines = cut(first.where(F.col("n") >= min_chars).join(open_ids, "line_id", "left_semi").select("line_id", "place"), "open-lines")
    of_doc = open_lines.groupBy(F.col("place.doc_id").alias("open_id"), F.col("place.text_hash").alias("open_hash")).agg(
        F.collect_list(F.struct("line_id", F.col("place.number").alias("number"))).alias("wanted")
    )
    same = F.col("doc_id").eqNullSafe(F.col("open_id")) & F.col("text_hash").eqNullSafe(F.col("open_hash"))
    # the open lines grow with the corpus, so they are never broadcast, not even while they are few
    texts = split.join(of_doc.hint("merge"), same).select("lines", F.inline("wanted"))
    texts = cut(texts.select("line_id", normal(F.element_at("lines", F.col("number") + 1)).alias("line")).dropDuplicates(["line_id"]), "open-texts")
    near = near_lines(open_lines, texts).select("line_id", F.lit(True).alias("near"))

    kept = first.join(near, "line_id", "left").groupBy(F.col("place.doc_id").alias("kept_id"), F.col("place.text_hash").alias("kept_hash"))
    kept = kept.agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("place.number"))).alias("kept"), F.count("near").alias("n_near")
    )
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("text_hash").eqNullSafe(F.col("kept_hash"))
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(normal(x) != "", i)), lambda i: i.isNotNull())
    sized = split.select("doc_id", "text_hash", F.size("lines").cast("long").alias("n_lines"), numbers.alias("full"))
    removed = F.array_except("full", F.coalesce("kept", F.array().cast("array<int>")))
    near = F.coalesce("n_near", F.lit(0).cast("long"))
    return sized.join(kept, same, "left").select(
        "doc_id", "text_hash", "n_lines", (F.size(removed) - near).alias("n_copies"), near.alias("n_near"), removed.alias("removed")
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines left out that ``repeated_lines`` removes; all rows and columns stay."""
    found = repeated_lines(docs, min_chars, id_column, text_column).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("found_id_"), F.col("text_hash").alias("found_hash_"), F.col("removed").alias("removed_"))
    text = F.col(text_column).cast("string")
    same = F.col(id_column).eqNullSafe(F.col("found_id_")) & F.xxhash64(text).eqNullSafe(F.col("found_hash_"))
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains("removed_", i), x))
    return docs.join(found, same).select(*[F.array_join(F.filter(numbered, lambda x: x.isNotNull()), "\n").alias(c) if c == text_column else F.col(c) for c in docs.columns])
