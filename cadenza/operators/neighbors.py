"""The k nearest users of every user: cosine descending, then user id ascending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ratings import of_users
from cadenza.operators.similarity import SLACK, nearest_of, partners_live, partners_nearest, popular_items, with_cosine, with_norms
from cadenza.plans.materialize import by_shuffle, cut

# A rating is paired with at most this many others of its item; see ``top_neighbors``.
LISTED_RATERS = 1000
# Rows per side of one task in the comparison of rows, and items multiplied at a time.
BLOCK_ROWS = 2048
BLOCK_ITEMS = 4096
# Levels of the index by the share of a row that lies in an item and the more popular ones.
LEVELS = 16


def _first(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("cos"), "other_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """First k rows (user_id, rank, other_id, cos) per user of directed pairs.

    Pairs with a ``part`` are cut to k per part where they lie, before the parts of a user are
    brought together.
    """
    if "part" in pairs.columns:
        pairs = _first(pairs, ["user_id", "part"], k).drop("part", "rank")
    return _first(pairs, ["user_id"], k).select("user_id", "rank", "other_id", "cos")


def top_neighbors(
    ratings: DataFrame,
    users: DataFrame,
    k: int = 5,
    user_ids: list | DataFrame | None = None,
    listed_raters: int = LISTED_RATERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exactly min(k, users - 1) neighbours per user: (user_id, rank, other_id, cos).

    ``users`` (user_id) is everybody who can be a neighbour. Users who share an item with fewer
    than k others are filled up with the lowest other ids at cosine 0. With ``user_ids`` (a list,
    or a table with user_id) only these users get neighbours, by a one-sided join.

    A user's items count from the rarest up. Over the items that few users rated (up to
    ``listed_raters``), pairs add up directly: work in proportion to the ratings. What the more
    popular ones can add is bounded by the shares of both rows that lie there (Cauchy-Schwarz):

    1. Pairs that share a listed item have their dot product there as a lower bound. Those whose
       upper bound reaches the user's k-th best lower bound get their exact popular part.
    2. Pairs that share popular items only have cosine <= the product of both shares from their
       rarest common item on. They are looked for only where that product can reach the user's
       k-th best cosine so far, in an index of rows by item and level of share, see
       ``_popular_rows_nearest``.

    Both steps are taken whatever the popularity of the items; without popular ones the first has
    nothing to add and the second nothing to look at. ``ratings`` is read several times, so give
    it as a written table.
    """
    if user_ids is not None:
        found = nearest(nearest_of(ratings, user_ids, k), k)
        return fill_up(found, of_users(users, user_ids), users, k)
    return fill_up(_nearest_of_all(ratings, k, listed_raters, block_rows), users, users, k)


def fill_up(found: DataFrame, wanted: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Give every wanted user k neighbours, missing ones being the lowest free ids at cosine 0.

    With c neighbours found, c + 1 ids are taken and k - c needed, so the k + 1 lowest ids
    always suffice: a constant-size list, whatever the number of users.
    """
    lowest = users.orderBy("user_id").limit(k + 1)
    lowest = lowest.agg(F.sort_array(F.collect_list("user_id")).alias("ids")).scalar()
    rows = found.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "other_id", "cos"))).alias("near")
    )
    none = F.array().cast(rows.schema["near"].dataType)
    filled = (
        wanted.select("user_id")
        .join(by_shuffle(rows), "user_id", "left")
        .select("user_id", F.coalesce("near", none).alias("near"), lowest.alias("lowest"))
        .withColumn(
            "free",
            F.array_except(
                "lowest", F.array_append(F.transform("near", lambda x: x["other_id"]), F.col("user_id"))
            ),
        )
        .withColumn("free", F.slice("free", 1, F.lit(k) - F.size("near")))
    )
    extra = F.transform(
        "free",
        lambda v, i: F.struct(
            (F.size("near") + i + 1).cast("int").alias("rank"), v.alias("other_id"), F.lit(0.0).alias("cos")
        ),
    )
    return filled.select("user_id", F.inline(F.concat("near", extra)))


def _kth(top: DataFrame, k: int) -> DataFrame:
    """Per user the k-th best cosine so far, 0 while there are fewer than k: (user_id, floor)."""
    return top.groupBy("user_id").agg(
        F.when(F.count("*") == k, F.min("cos")).otherwise(F.lit(0.0)).alias("floor")
    )


def _nearest_of_all(ratings: DataFrame, k: int, listed_raters: int, block_rows: int) -> DataFrame:
    """(user_id, rank, other_id, cos) of the pairs with a common item that are among a user's first k."""
    hot = cut(popular_items(ratings, listed_raters), "popular-items")
    marked = ratings.join(hot.select("item_id", F.lit(True).alias("is_hot")), "item_id", "left")
    marked = marked.withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    hot_n = F.sum(F.when(F.col("is_hot"), F.col("w") * F.col("w")).otherwise(0)).alias("hot_n")
    rated = cut(with_norms(marked, hot_n), "rated")
    hot_part, listed = rated.where("is_hot"), rated.where(~F.col("is_hot"))

    # users without popular items are done: nothing can be added to their pairs
    done = nearest(partners_nearest(listed, k, F.col("hot_n") == 0), k)
    live = cut(partners_live(listed, k, F.col("hot_n") > 0), "live-pairs")
    added = (
        live.where("add")
        .select("user_id", "other_id")
        .join(by_shuffle(hot_part.select("user_id", "item_id", "w")), "user_id")
        .join(
            by_shuffle(hot_part.select(F.col("user_id").alias("other_id"), "item_id", F.col("w").alias("w_other"))),
            ["other_id", "item_id"],
        )
        .groupBy("user_id", "other_id")
        .agg(F.sum(F.col("w") * F.col("w_other")).alias("hot_dot"))
    )
    exact = live.join(by_shuffle(added), ["user_id", "other_id"], "left").withColumn(
        "dot", F.col("dot") + F.coalesce("hot_dot", F.lit(0))
    )
    first = cut(nearest(with_cosine(exact), k).unionByName(done), "nearest-by-listed")

    hot_users = _hot_rows(hot_part)
    share = F.sqrt(F.col("hot_n").cast("double") / F.col("n")) * (1 + SLACK)
    open_users = (
        hot_users.join(by_shuffle(_kth(first, k)), "user_id", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .where(share >= F.col("floor"))
        .select("user_id", "n", "items", "weights", "floor")
    )
    second = _popular_rows_nearest(open_users, hot_users, hot, k, block_rows)
    both = first.select("user_id", "other_id", "cos").unionAll(second)
    return nearest(both.groupBy("user_id", "other_id").agg(F.max("cos").alias("cos")), k)


def _hot_rows(hot_part: DataFrame) -> DataFrame:
    """One row per user that touched a hot item: n, hot_n and the hot row as two arrays.

    The arrays hold what the user itself has of hot items.
    """
    cells = F.sort_array(F.collect_list(F.struct("item_id", "w")))
    rows = hot_part.groupBy("user_id").agg(F.max("n").alias("n"), F.max("hot_n").alias("hot_n"), cells.alias("cells"))
    rows = rows.select("user_id", "n", "hot_n", F.col("cells.item_id").alias("items"), F.col("cells.w").alias("weights"))
    return cut(rows, "hot-rows")


def _popular_rows_nearest(
    open_users: DataFrame, hot_users: DataFrame, hot: DataFrame, k: int, block_rows: int
) -> DataFrame:
    """(user_id, other_id, cos over popular items) holding all that open users can still need.

    Users with equal popular rows score alike but for their length: against any user, the shortest
    k + 1 of them (ties: lowest id) come before all others, and at least k of these are not the
    user itself. So k + 1 members stand for all copies of a row. Likewise open users with equal
    popular row and length share one list of k + 1 partners.

    What is left is an index: each member stands under each of its items at the level of its share
    from that item on. An asker looks under its items at the levels that can reach its floor. Both
    sides of an item and level are dealt out to blocks of bounded size, and a task multiplies two
    blocks and keeps k + 1 partners per row. Where both sides of an item fit into one block, its
    levels are not told apart: all that ask there meet all that stand there, once.
    """
    same_row = Window.partitionBy("items", "weights").orderBy("n", "user_id")
    members = hot_users.withColumn("r", F.row_number().over(same_row)).where(F.col("r") <= k + 1)
    members = cut(members.select(F.col("user_id").alias("row_id"), "n", "items", "weights"), "members")
    open_users = cut(open_users, "open-users")
    askers = open_users.groupBy("items", "weights", "n").agg(
        F.min("user_id").alias("row_id"), F.min("floor").alias("floor")
    )
    askers = cut(askers, "askers")

    probes = cut(_probes(askers, hot), "probes")
    places = cut(_shares(members, hot).select("row_id", "item_id", _level(F.col("share")).alias("level")), "places")
    small = cut(_small_items(probes, places, block_rows), "small-items")
    levels = F.when(F.col("small"), F.array(F.lit(0))).otherwise(F.sequence("least", F.lit(LEVELS - 1)))
    asking = askers.drop("floor").join(probes.join(small, "item_id").select("row_id", "item_id", F.explode(levels).alias("level")), "row_id")
    level = F.when(F.col("small"), F.lit(0)).otherwise(F.col("level")).alias("level")
    listed = members.join(places.join(small, "item_id").select("row_id", "item_id", level), "row_id")
    left, right = _blocks(asking, listed, block_rows), _blocks(listed, asking, block_rows)
    keys = ["item_id", "level", "mine", "theirs"]
    right = right.select("item_id", "level", F.col("theirs").alias("mine"), F.col("mine").alias("theirs"), "row_id", "n", "items", "weights")
    id_type = members.schema["row_id"].dataType.simpleString()
    best = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_block_nearest(k + 1, BLOCK_ITEMS), f"row_id {id_type}, other_id {id_type}, cos double")
    )
    # a pair is met under each common item, and always has the same cosine
    order = Window.partitionBy("row_id").orderBy(F.desc("cos"), "other_id")
    lists = (
        best.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    )
    asked = open_users.join(askers.drop("floor"), ["items", "weights", "n"]).select("user_id", "row_id")
    return asked.join(lists, "row_id").where("user_id <> other_id").select("user_id", "other_id", "cos")


def _shares(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(row_id, item_id, share): what a row's item and its more popular ones make up of its length."""
    cells = rows.select("row_id", "n", F.inline(F.arrays_zip(F.col("items").alias("item_id"), F.col("weights").alias("w"))))
    to_come = Window.partitionBy("row_id").orderBy("raters", "item_id").rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum(F.col("w") * F.col("w")).over(to_come)
    return cells.join(hot, "item_id").select("row_id", "item_id", F.sqrt(rest.cast("double") / F.col("n")).alias("share"))


def _small_items(probes: DataFrame, places: DataFrame, block_rows: int) -> DataFrame:
    """(item_id, small): whether all that ask and all that stand under an item fit into one block."""
    asked = probes.groupBy("item_id").agg(F.count("*").alias("asking"))
    return places.groupBy("item_id").agg(F.count("*").alias("listed")).join(asked, "item_id").select(
        "item_id", (F.greatest("asking", "listed") <= block_rows).alias("small")
    )


def _level(share: Column) -> Column:
    return F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int")


def _probes(askers: DataFrame, hot: DataFrame) -> DataFrame:
    """(row_id, item_id, least): the items under which a row must look for partners, and the least level there.

    Take a row's items from the least popular on. A pair whose rarest common item this is has
    cosine <= the product of both shares; where the row's own share is below its floor, no partner
    can reach it, and elsewhere only partners whose share is at least floor / own share.
    """
    shares = _shares(askers, hot).join(askers.select("row_id", "floor"), "row_id")
    needed = F.col("floor") / F.col("share") * (1 - SLACK)
    return shares.where(needed <= 1).select("row_id", "item_id", _level(needed).alias("least"))


def _blocks(rows: DataFrame, opposite: DataFrame, block_rows: int) -> DataFrame:
    """Rows of one side (one per item and level), once per block of the opposite side there.

    The counts joined here have one row per item and level.
    """
    keys = ["item_id", "level"]
    count = F.ceil(F.count("*") / block_rows).cast("int")
    counts = rows.groupBy(*keys).agg(count.alias("own_blocks")).join(
        opposite.groupBy(*keys).agg(count.alias("opposite_blocks")), keys
    )
    return (
        rows.join(counts, keys)
        .withColumn("mine", F.pmod(F.xxhash64("row_id"), F.col("own_blocks")).cast("int"))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("opposite_blocks") - 1)))
        .select(*keys, "mine", "theirs", "row_id", "n", "items", "weights")
    )


def _block_nearest(keep: int, block_items: int):
    """Task function: the ``keep`` best partners on the right for every row on the left.

    Items are taken a block at a time, so memory does not depend on how many there are.
    """

    def cells_of(rows: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Row count, and line, item and weight of every entry."""
        line = np.repeat(np.arange(len(rows)), rows["items"].map(len).to_numpy())
        return len(rows), line, np.concatenate(rows["items"].to_list()), np.concatenate(rows["weights"].to_list())

    def dense(entries: tuple, columns: np.ndarray) -> np.ndarray:
        n, line, items, weights = entries
        cells = np.zeros((n, len(columns)))
        spot = np.minimum(np.searchsorted(columns, items), len(columns) - 1)
        known = columns[spot] == items
        cells[line[known], spot[known]] = weights[known]
        return cells

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"row_id": [], "other_id": [], "cos": []})
        right = right.sort_values("row_id")
        ours, theirs = cells_of(left), cells_of(right)
        columns, dots = np.unique(ours[2]), np.zeros((len(left), len(right)))
        for at in range(0, len(columns), block_items):
            some = columns[at : at + block_items]
            dots += dense(ours, some) @ dense(theirs, some).T
        n, n_other = left["n"].to_numpy(float), right["n"].to_numpy(float)
        cos = dots / np.sqrt(n[:, None] * n_other[None, :])
        # a stable sort keeps equal cosines in id order
        best = np.argsort(-cos, axis=1, kind="stable")[:, :keep]
        line = np.repeat(np.arange(len(left)), best.shape[1])
        spot = best.ravel()
        out = pd.DataFrame(
            {
                "row_id": left["row_id"].to_numpy()[line],
                "other_id": right["row_id"].to_numpy()[spot],
                "cos": cos[line, spot],
            }
        )
        return out[out["cos"] > 0]

    return compare
