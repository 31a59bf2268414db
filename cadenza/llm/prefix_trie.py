"""Prefix trie of conversations: node tables addressed by minimal perfect hashes of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.ordering import number_within
from cadenza.plans.materialize import cut

# A subtree with over this share of a shard's rows is taken apart, its top goes into the top tree.
SHARE, LEAST_ROWS = 16, 256
# Depths of the top tree handled by one task, and tasks one after another at most.
BAND_DEPTHS, BANDS = 4096, 64
# Conversation ids joined at a time.
CHUNK_IDS = 8192
WORD_ENDS = r"[\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """The turns as (conv, place, ca, cb, words): places from 0 by turn (null first), role and text,
    a digest of role and text in two numbers, and the words of the text.

    Null roles and texts are empty; rows without a conversation belong to none and are left out.
    Repeated rows are turns of their own. A conversation of any length is numbered over many tasks.
    """
    rows = conversations.select(
        F.col(conv_column).cast("long").alias("conv"),
        "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).where("conv IS NOT NULL")
    words = F.size(F.array_remove(F.split("text", WORD_ENDS), "")).cast("long")
    return number_within(rows, "conv", ["turn", "role", "text"], "turns").select(
        "conv",
        F.col("index_").cast("long").alias("place"),
        *[F.xxhash64(F.lit(seed), "role", "text").alias(c) for seed, c in ((1, "ca"), (2, "cb"))],
        words.alias("words"),
    )


def with_shared_openings(turns: DataFrame, family: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt so that families of conversations begin alike.

    Conversation c takes the first h turns of conversation c - c % family (all if it has fewer,
    none if there is none), then its own turns after its first h, with h the CRC-32 of its
    decimal id modulo ``longest``. At most ``longest`` - 1 turns of a conversation are copied, to
    ``family`` others.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    convs = cut(
        sizes.select("conv", "size", (F.crc32(F.col("conv").cast("string")) % longest).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")),
        "conversations",
    )
    of_base = convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = cut(
        convs.join(of_base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")),
        "openings",
    )
    heads = turns.where(F.col("place") < longest - 1).withColumnRenamed("conv", "base")
    opening = convs.join(heads, "base").where("place < taken").select("conv", "place", "ca", "cb", "words")
    own = turns.join(convs, "conv").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    return convs.select("conv"), opening.unionByName(own.select(opening.columns))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Per conversation and depth: the digest of its first turns (pa, pb) and of all but the last (qa, qb).

    A digest is the exclusive or of the hashes of its turns with their places, so that stretches
    of a conversation are digested apart and put together: no task sees a whole long one.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.xxhash64(F.lit(seed), "place", "ca", "cb").alias(c) for seed, c in ((3, "ha"), (4, "hb"))]
    rows = turns.select("conv", (F.col("place") + 1).alias("depth"), "words", *own)
    dealt = cut(rows.repartitionByRange(n, "conv", "depth").withColumn("range_", F.spark_partition_id()), "dealt-turns")
    ranges = dealt.groupBy("conv", "range_").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"), F.max("depth").alias("upto"))
    of_conv = Window.partitionBy("conv")
    earlier = of_conv.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "conv", "range_", F.max("upto").over(of_conv).alias("len"), *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("xa", "xb")]
    )
    running = Window.partitionBy("conv", "range_").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({"ra": F.bit_xor("ha").over(running), "rb": F.bit_xor("hb").over(running)})
    joined = within.join(ranges, ["conv", "range_"])
    joined = joined.withColumns({"pa": F.col("ra").bitwiseXOR(F.col("xa")), "pb": F.col("rb").bitwiseXOR(F.col("xb"))})
    return joined.select(
        "conv", "depth", "len", "words", "pa", "pb", F.col("pa").bitwiseXOR(F.col("ha")).alias("qa"), F.col("pb").bitwiseXOR(F.col("hb")).alias("qb")
    )


class Slots:
    """A minimal perfect hash of distinct digests: each has a slot of its own in 0..n-1.

    In each round the digests still open are hashed into twice as many cells; those alone in
    theirs keep it, and slots count the kept cells round by round. The digests are stored by
    slot, so a lookup is verified and digests that are not there are known.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.rounds: list[np.ndarray] = []
        self.offsets = [0]
        open_ = np.arange(len(a))
        while len(open_):
            size = 2 * len(open_) + 1
            cell = self._cell(a[open_], b[open_], len(self.rounds), size)
            alone = np.bincount(cell, minlength=size) == 1
            self.rounds.append(np.where(alone, np.cumsum(alone) - 1, -1))
            self.offsets.append(self.offsets[-1] + int(alone.sum()))
            open_ = open_[~alone[cell]]
            if len(self.rounds) > 200:
                raise ValueError("digests are not distinct")
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        at = self._find(a, b)
        self.a[at], self.b[at] = a, b
        if (self(a, b) < 0).any():
            raise ValueError("two digests in one slot")

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, nth: int, size: int) -> np.ndarray:
        x = a.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (nth + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(a), -1), np.arange(len(a))
        for nth, rank in enumerate(self.rounds):
            got = rank[self._cell(a[open_], b[open_], nth, len(rank))]
            out[open_[got >= 0]] = got[got >= 0] + self.offsets[nth]
            open_ = open_[got < 0]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that are not in the table."""
        at = self._find(a, b)
        known = at >= 0
        known[known] = (self.a[at[known]] == a[known]) & (self.b[at[known]] == b[known])
        return np.where(known, at, -1)


_NODE = ["pa", "pb", "qa", "qb", "depth", "conv", "n_convs", "words", "goes_on", "children", "leaves", "saved"]
_SUMS = "pa long, pb long, qa long, qb long, depth long, conv long, n_convs long, parent_conv long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(nodes: pa.Table) -> pa.Table:
    """Sums over subtrees for the nodes of one shard.

    Counts stand in flat arrays by slot; children, leaves and saved tokens are added to the
    parent's slot, the deepest nodes first. ``children``, ``leaves`` and ``saved`` are what
    subtrees outside the shard bring in. A node whose parent is not here gets no parent_conv.
    """
    col = {c: nodes[c].to_numpy().astype(np.int64) for c in _NODE}
    slots = Slots(col["pa"], col["pb"])
    here = slots(col["pa"], col["pb"])
    by_slot = {c: np.zeros(len(here), np.int64) for c in _NODE}
    for c in _NODE:
        by_slot[c][here] = col[c]
    parent = slots(by_slot["qa"], by_slot["qb"])
    # the root is its own parent's digest
    parent[by_slot["depth"] == 0] = -1
    inner = parent >= 0
    children = by_slot["children"] + np.bincount(parent[inner], minlength=len(parent))
    leaves = by_slot["leaves"] + (children == 0)
    saved = by_slot["saved"] + (by_slot["n_convs"] - 1) * by_slot["words"]
    order = np.argsort(-by_slot["depth"], kind="stable")
    borders = np.flatnonzero(np.diff(by_slot["depth"][order])) + 1
    for level in np.split(order, borders):
        level = level[inner[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    # a node of one conversation has one child or none, also where that lies in another shard
    children = np.where(by_slot["n_convs"] == 1, by_slot["goes_on"], children)
    mother = pa.array(by_slot["conv"][parent], mask=~inner)
    kept = [pa.array(by_slot[c]) for c in ("pa", "pb", "qa", "qb", "depth", "conv", "n_convs")]
    return pa.table([*kept, mother, pa.array(children), pa.array(leaves), pa.array(saved)], names=[x.split()[0] for x in _SUMS.split(", ")])


def _carried(sums: DataFrame) -> DataFrame:
    """What the subtrees without a parent in their shard bring to it."""
    return sums.where("parent_conv IS NULL AND depth > 0").groupBy(F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def _with_carried(nodes: DataFrame, carried: DataFrame) -> DataFrame:
    extra = [F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")]
    return nodes.join(carried, ["pa", "pb"], "left").select(*_NODE[:9], *extra)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(pa, pb, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in chunks over ranges of (node, id); then each node's chunks are hashed in
    order, one after the other as they are read, so a node may have any number of ids.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(i).to_numpy() for i in range(3))
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            upto = np.append(starts[1:], len(a))
            cuts = [(x, min(x + CHUNK_IDS, y)) for s, y in zip(starts.tolist(), upto.tolist(), strict=True) for x in range(s, y, CHUNK_IDS)]
            names = list(map(str, conv.tolist()))
            first = [x for x, _ in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(conv[first]), pa.array([",".join(names[x:y]) for x, y in cuts], pa.string())], ["pa", "pb", "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def row(done: list) -> pa.RecordBatch:
            a, b, text = zip(*done, strict=True) if done else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], ["pa", "pb", "ends_sha256"])

        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == key:
                    running.update(b",")
                else:
                    if key:
                        done.append((*key, running.hexdigest()))
                    key, running = (a, b), hashlib.sha256()
                running.update(ids.encode())
            yield row(done)
        if key:
            yield row([(*key, running.hexdigest())])

    dealt = ends.select("pa", "pb", "conv").repartitionByRange(n, "pa", "pb", "conv").sortWithinPartitions("pa", "pb", "conv")
    joined = dealt.mapInArrow(chunks, "pa long, pb long, conv long, ids string")
    joined = joined.repartition(n, "pa", "pb").sortWithinPartitions("pa", "pb", "conv")
    return joined.mapInArrow(digest, "pa long, pb long, ends_sha256 string")


def _checked(value: str) -> Column:
    """The value all members of a node have; different ones mean that two prefixes share a digest."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).cast("long")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per distinct prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` is (conv, place, ca, cb, words) as from ``ordered_turns``; ``convs`` (conv) names the
    conversations, also those without a turn. A node of depth d stands for a sequence of d turns,
    the root for none; its members begin with it and it is named by the smallest. ``n_leaves``
    counts the nodes without children in its subtree, itself included, ``saved_tokens`` the words
    that need not be repeated there: words of a node's last text, times its members but one.
    ``ends_sha256`` is of the members that end there.

    Prefixes become nodes by a group of digests, summed up in the tasks first. Subtrees lie whole
    in shards, so each shard adds up its nodes alone (``_accumulate``). Nodes with more than a
    fixed part of a shard's rows below them, and the root, make the top tree, which gets the
    sums of the subtrees under it and is added up in bands of depths from below; there are at
    most SHARE times as many such nodes on a depth as shards. The rest of a single long
    conversation is cut into pieces. No conversations give no nodes.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs = (turns.select("conv") if convs is None else convs).distinct()
    rows = cut(_prefixes(turns), "prefixes")
    all_rows = rows.count()
    limit = max(least_rows, ceil(all_rows / (SHARE * n)))

    nodes = rows.groupBy("pa", "pb").agg(
        *[_checked(c).alias(c) for c in ("qa", "qb", "depth", "words")],
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.max((F.col("len") > F.col("depth")).cast("long")).alias("goes_on"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("rows"),
    )
    nodes = cut(nodes, "nodes")
    heavy = F.expr(f"n_convs > 1 AND rows > {limit}")
    top = cut(nodes.where(heavy), "top-nodes")
    # the first node of each conversation below the top tree is the root of its subtree
    below = rows.join(top.select("pa", "pb"), ["pa", "pb"], "left_anti")
    units = below.groupBy("conv").agg(F.min(F.struct("depth", "pa", "pb", "len")).alias("u"))
    roots = nodes.select("pa", "pb", F.col("n_convs").alias("members"))
    units = units.select("conv", F.col("u.pa").alias("pa"), F.col("u.pb").alias("pb"), (F.col("u.len") - F.col("u.depth") + 1).alias("length"))
    units = units.join(roots, ["pa", "pb"]).select(
        "conv", F.col("pa").alias("ua"), F.col("pb").alias("ub"), ((F.col("members") == 1) & (F.col("length") > limit)).alias("alone")
    )
    piece = F.when(F.col("alone"), F.floor(F.col("depth") / limit)).otherwise(0)
    light = nodes.where(~heavy).join(units, "conv")
    light = light.withColumn("shard", F.pmod(F.xxhash64("ua", "ub", piece), F.lit(n)))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    light = light.select("shard", *_NODE[:9], *nothing).repartition(n, "shard")
    sums = cut(light.groupBy("shard").applyInArrow(_accumulate, _SUMS), "light-sums")

    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(
        *[zero.alias(c) for c in ("pa", "pb", "qa", "qb", "depth")], "conv", "n_convs", zero.alias("words"), F.lit(int(all_rows > 0)).cast("long").alias("goes_on")
    )
    top = cut(root.unionByName(top.select(*_NODE[:9])), "top-tree")
    deepest = top.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    band = max(BAND_DEPTHS, ceil((deepest + 1) / BANDS))
    carried, done = _carried(sums), sums
    for nth in range(deepest // band, -1, -1):
        of_band = top.where(F.col("depth").between(nth * band, (nth + 1) * band - 1))
        of_band = _with_carried(of_band, carried).withColumn("band", F.lit(nth))
        of_band = cut(of_band.groupBy("band").applyInArrow(_accumulate, _SUMS), "top-sums")
        done = done.unionByName(of_band)
        carried = _carried(of_band).unionByName(_carried(sums)).groupBy("pa", "pb").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])

    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "pa", "pb")).alias("last"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in ("pa", "pb")])
    mothers = top.select(F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv").alias("above"))
    # a piece of a single conversation hangs on an earlier piece of it
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv", "above", "conv"))
    return (
        done.join(mothers, ["qa", "qb"], "left")
        .join(_ends_digest(ends), ["pa", "pb"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            parent.alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
