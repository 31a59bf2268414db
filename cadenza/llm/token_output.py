"""Token-id files: texts encoded with a public tokenizer, written as Simple-8b words, and read back."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import simple8b
from cadenza.llm.text import short_batches, type_of

# Ids of about this many make one record of a file.
RECORD_IDS = 1 << 20
# Text bytes encoded together, and bytes of parts and their ids remembered within a task.
TEXT_BYTES, MEMO_BYTES = 1 << 23, 96 << 20
# What a remembered part takes besides its characters and ids: its entry, key and end.
ENTRY_BYTES = 180
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-@\[-`{-~"
_HEADER = struct.Struct("<4sII")
MAGIC = b"TID1"


class Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Memo:
    """Remembers the ids of strings, in about ``MEMO_BYTES`` and what one group of texts adds.

    ``learn`` takes strings it was not asked for before, and gives all their ids and how many
    each has.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.held = 0

    def __call__(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings end to end, and how many each has."""
        if self.held > MEMO_BYTES:
            self.forget()
        which = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        if new := self.index.new:
            ids, sizes = self.learn(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + ids.nbytes
            self.index.new = []
        return _pick(self.ids, self.ends, which, np.ones(len(parts), np.int64))


def _pick(ids: np.ndarray, ends: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the strings numbered ``which`` end to end, and how many each run of ``counts`` strings has."""
    first = ends[which]
    sizes = ends[which + 1] - first
    upto = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids[np.repeat(first - upto[:-1], sizes) + np.arange(int(upto[-1]))]
    return flat, np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


def border_letters(tokenizer) -> str:
    """The Latin letters beside which pieces may be cut.

    A letter that the tokenizer's normaliser turns into anything but letters (a dotted capital I
    ends in a combining dot) may join the sign behind it, so no cut is made beside it.
    """
    changed = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    letters = [chr(c) for c in range(0x250) if re.match(f"[{_LETTERS}]", chr(c))]
    return "".join(c for c in letters if changed(c).isalpha())


class PieceEncoder:
    """Encodes texts piece by piece: each distinct piece of a group once, each distinct part once
    as long as it is remembered.

    A piece is a run without ASCII white space; its parts end where one of ``border_letters``
    meets an ASCII sign or digit other than an apostrophe. It fits tokenizers that drop white
    space and never join across either; pieces and parts then have the same ids alone as within
    their text. Pieces that hold one of the tokenizer's special texts stay whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        letters = border_letters(tokenizer)
        self.borders = [f"([{letters}])([{_SIGNS}])", f"([{_SIGNS}])([{letters}])"]
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.of_parts = Memo(self._encode)

    def _parts(self, pieces: pa.Array) -> pa.Array:
        """The parts of each piece, as lists."""
        cut = pieces
        for border in self.borders:
            cut = pc.replace_substring_regex(cut, border, r"\1 \2")
        for special in self.specials:
            cut = pc.if_else(pc.match_substring(pieces, special), pieces, cut)
        return pc.split_pattern(cut, " ")

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters are one word each: many are encoded as one text and parted at the ids
        that end a word. If these are not as many, and for other parts, each is encoded alone."""
        letters = [i for i, p in enumerate(parts) if p.isalpha()]
        alone = [i for i, p in enumerate(parts) if not p.isalpha()]
        together: list[int] = []
        ids, sizes = [], []
        for at in range(0, len(letters), 500):
            some = letters[at : at + 500]
            (got,) = self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in some])], add_special_tokens=False)
            own = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[own]) + 1
            if len(ends) == len(some) and ends[-1] == len(own):
                together += some
                ids.append(own)
                sizes.append(np.diff(ends, prepend=0))
            else:
                alone += some
        found = [x.ids for x in self.tokenizer.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        # back into the order of the parts
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        back = np.argsort(np.array(together + alone, np.int64))
        first, size = (np.cumsum(size) - size)[back], size[back]
        upto = np.cumsum(size)
        return flat[np.repeat(first - upto + size, size) + np.arange(len(flat))], size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (large strings, no nulls), and how many each text has."""
        pieces, in_text = _coded(pc.ascii_split_whitespace(texts))
        parts, in_piece = _coded(self._parts(pieces.dictionary))
        ids, sizes = self.of_parts(parts.dictionary.to_pylist())
        ids, sizes = _pick(ids, np.concatenate([[0], np.cumsum(sizes)]), parts.indices.to_numpy(), in_piece)
        return _pick(ids, np.concatenate([[0], np.cumsum(sizes)]), pieces.indices.to_numpy(), in_text)


def _coded(lists: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The items of lists end to end, distinct ones numbered, and how many each list has."""
    return lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pack_record(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """Ids and how many of them each document has, as bytes.

    Ids are replaced by their rank among the record's ids by frequency, so that common ones need
    few bits; the ranked ids stand in front.
    """
    counts = np.bincount(ids, minlength=1)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    parts = [simple8b.pack(lengths), simple8b.pack(rank[ids])]
    head = _HEADER.pack(MAGIC, len(ranked), len(parts[0])) + ranked.astype("<u4").tobytes()
    return head + b"".join(parts)


def unpack_record(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    magic, n_ranked, n_lengths = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a record of token ids")
    ranked = np.frombuffer(data, "<u4", n_ranked, _HEADER.size)
    at = _HEADER.size + 4 * n_ranked
    lengths = simple8b.unpack(data[at : at + n_lengths]).astype(np.int64)
    return ranked[simple8b.unpack(data[at + n_lengths :]).astype(np.int64)], lengths


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in groups of about ``TEXT_BYTES``: batches put together or cut, never a text."""
    keys: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for batch in batches:
        column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        upto, at = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())]), 0
        while at < len(column):
            until = max(at + 1, int(np.searchsorted(upto, upto[at] + TEXT_BYTES - held)))
            until = min(until, len(column))
            keys.append(batch.column(0).slice(at, until - at))
            texts.append(column.slice(at, until - at))
            held += int(upto[until] - upto[at])
            at = until
            if held >= TEXT_BYTES:
                yield pa.concat_arrays(keys), pa.concat_arrays(texts)
                keys, texts, held = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    files: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: list[Column] | None = None,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of their id,
    or by the expressions of ``order`` before it.

    File k holds the k-th range of ids (``files`` ranges, the session's shuffle partitions by
    default) as records (shard, record, doc_ids, n_ids, payload) in a Parquet container, which
    lets Spark commit, retry and find files on any store; ``payload`` is ``pack_record``'s bytes.
    Rows of equal id are ordered by hash, then text, and the hash takes part in the ranges, so an
    id with very many rows is split. Null ids come first; null and empty texts have the end id
    only. A record ends after the document that fills it, so memory is bounded by
    ``RECORD_IDS`` and the longest text. ``tokenizer`` must be a path that every executor has.
    """
    spark = docs.sparkSession
    short_batches(spark)
    before = [c.alias(f"before_{i}") for i, c in enumerate(order or [])]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *before)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*rows.columns[2:-1], "id", "tie"]
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("id", "text")
    kind = type_of(rows, "id")
    schema = f"shard int, record int, doc_ids array<{kind}>, n_ids long, payload binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, record = PieceEncoder(_tokenizer(tokenizer)), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, names, size, record
            keys = pa.concat_arrays(names)
            keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            payload = pack_record(np.concatenate(ids), np.concatenate(lengths))
            columns = [pa.array([shard], pa.int32()), pa.array([record], pa.int32()), keys, pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
            ids, lengths, names, size, record = [], [], [], 0, record + 1
            return pa.RecordBatch.from_arrays(columns, ["shard", "record", "doc_ids", "n_ids", "payload"])

        for keys, group in _groups(batches):
            flat, sizes = encoder(group)
            flat = np.insert(flat, np.cumsum(sizes), end_id).astype(np.uint32)
            sizes = sizes + 1
            # cut behind the documents that fill a record
            upto, done = np.cumsum(sizes), 0
            while done < len(group):
                base = upto[done - 1] if done else 0
                until = min(len(group), int(np.searchsorted(upto, base + max(1, RECORD_IDS - size))) + 1)
                ids.append(flat[base : upto[until - 1]])
                lengths.append(sizes[done:until])
                names.append(keys.slice(done, until - done))
                size += int(upto[until - 1] - base)
                done = until
                if size >= RECORD_IDS:
                    yield flush()
        if size:
            yield flush()

    rows.mapInArrow(encode, schema).write.parquet(path)


def stored_order() -> list[Column]:
    """The order in which rows stand in the Parquet files of a table that was written in order.

    Spark numbers the files of a sorted result in its order; the number stands behind "part-".
    """
    return [F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS int)"), F.col("_metadata.row_index")]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it: sums per file are added up over the
    files, of which there are as many as ranges, and within a file over its records.
    """
    files = spark.read.parquet(path)
    sizes = files.select("shard", "record", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    of_shard = Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    records = sizes.select("shard", "record", F.coalesce(F.sum("n_ids").over(of_shard), F.lit(0)).alias("record_start"))
    records = records.join(shards, "shard").select("shard", "record", (F.col("shard_start") + F.col("record_start")).alias("base"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, lengths = unpack_record(batch.column(3)[i].as_py())
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                spans = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)
                sums = [zlib.crc32(data[a:b]) for a, b in spans]
                n = len(lengths)
                columns = [
                    batch.column(2)[i].values, pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int32)),
                    pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "record", "within", "n_tokens", "ids_crc32"])

    docs = files.select("shard", "record", "doc_ids", "payload").mapInArrow(
        decode, f"doc_id {kind}, shard int, record int, within long, n_tokens long, ids_crc32 long"
    )
    docs = docs.join(records, ["shard", "record"])
    return docs.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
