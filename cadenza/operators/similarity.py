"""Exact user-user cosine over sparse ratings (user_id, item_id, w)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import pairs
from cadenza.operators.ratings import of_users
from cadenza.operators.running import suffix_sums
from cadenza.plans.materialize import by_shuffle, cut, spread

# The raters of an item are listed in rows of about this many; popular items take several.
PART_RATERS = 1000
# A user with more items than this is split over several partitions of partners.
PART_ITEMS = 5000
# Entries of rater lists that come to one partition on average: more partitions are made where they would be more.
PARTITION_ENTRIES = 10_000_000
# Entries that are shuffled at a time where little of the sums goes on: this many per rating, and never fewer than the least.
ROUND_ENTRIES, LEAST_ROUND = 8, 500_000_000
# Slack of the bounds, far above rounding error: it can only let more candidates through.
SLACK = 1e-9


def user_norms(ratings: DataFrame) -> DataFrame:
    """Squared length of every user's row."""
    return ratings.groupBy("user_id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))


def with_norms(ratings: DataFrame, *more: Column) -> DataFrame:
    """Ratings plus per-user columns: the squared length ``n`` of the user's row, ``parts`` to
    split the user's partners into, and any further aggregates given.

    Joined here, on one row per rating, because the pairs made later are many times more.
    """
    parts = F.ceil(F.count("*") / PART_ITEMS).cast("int")
    per_user = ratings.groupBy("user_id").agg(
        F.sum(F.col("w") * F.col("w")).alias("n"), parts.alias("parts"), *more
    )
    return ratings.join(by_shuffle(per_user), "user_id")


def cosine(dot: Column, n: Column, n_other: Column) -> Column:
    """Cosine from exact integer dot product and squared lengths."""
    return dot.cast("double") / F.sqrt(n.cast("double") * n_other.cast("double"))


def popular_items(ratings: DataFrame, raters: int) -> DataFrame:
    """Items with more than ``raters`` ratings: (item_id, raters)."""
    return (
        ratings.groupBy("item_id").agg(F.count("*").alias("raters")).where(F.col("raters") > raters)
    )


def _item_lists(
    rated: DataFrame, own: list[str], carried: list[str], part_raters: int | None, of: Column | None, half: bool, listed: str
) -> tuple[DataFrame, int]:
    """The raters of each item, once as members (user_id, part, place, own columns) and once as packed lists of the
    columns other_id, w_other and those carried; and how many entries the members of all lists meet.

    The raters of a popular item are dealt out by hash to several lists of bounded length. Its members are dealt out
    to as many lanes, and every list goes to each lane, so that one key holds about ``part_raters`` ratings at most.
    """
    others = {"other_id": "user_id", "w_other": listed, **{f"{c}_other": c for c in carried}}
    rated = rated.where(F.col("item_id").isNotNull())
    whole = [c for c in dict.fromkeys(others.values()) if rated.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")]
    of = F.lit(True) if of is None else of
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in whole for f in (F.min, F.max, F.count)]
    per_item = rated.groupBy("item_id").agg(F.count("*").alias("raters"), F.count_if(of).alias("left"), *ranges)
    over_all = [{"min": F.min, "max": F.max, "count": F.sum}[k](f"{k}_{c}").alias(f"{k}_{c}") for c in whole for k in ("min", "max", "count")]
    counts = [F.sum(F.col("left") * F.col("raters")).alias("entries"), F.sum("raters").alias("ratings"), F.max("raters").alias("most")]
    found = per_item.agg(*counts, *over_all).first()
    widths = {c: None for c in others}
    for c, x in others.items():
        if x in whole and found["ratings"] and found[f"count_{x}"] == found["ratings"]:
            widths[c] = pairs.width_of(found[f"min_{x}"], found[f"max_{x}"])

    split = part_raters is not None and (found["most"] or 0) > part_raters
    keys = [F.lit(0).alias("piece"), F.lit(1).alias("pieces")]
    if split:
        pieces = popular_items(rated, part_raters).select("item_id", F.ceil(F.col("raters") / part_raters).cast("int").alias("pieces"))
        rated = rated.join(pieces, "item_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        keys = [F.pmod(F.xxhash64("user_id"), F.col("pieces")).cast("int").alias("piece"), "pieces"]
    own = ["w", *own]
    more = [c for c in dict.fromkeys([*own, *others.values()]) if c != "user_id"]
    flat = rated.select("item_id", *keys, "user_id", F.coalesce("parts", F.lit(1)).cast("int").alias("parts"), of.alias("mine"), *more)
    flat = flat.repartition("item_id", "piece").sortWithinPartitions("item_id", "piece", "user_id")
    kind = {c: f.dataType.simpleString() for c, f in zip(flat.columns, flat.schema, strict=True)}
    members = ", ".join(f"{c}:{kind[c]}" for c in ("user_id", *own))
    members = f"members array<struct<{members.replace(',', ', all_parts:int,', 1)}, part:int, place:int>>"
    lists = ", ".join(f"{c} {f'array<{kind[x]}>' if widths[c] is None else 'binary'}" for c, x in others.items())
    form = f"{members}, raters int, {lists}"
    packed = flat.mapInArrow(pairs.item_lists(own, others, widths, half), f"item_id {kind['item_id']}, piece int, pieces int, {form}")
    if split:
        packed = cut(packed, "item-lists")
        many = packed.where("pieces > 1")
        lanes = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        theirs = many.select("item_id", lanes, "raters", *others)
        met = many.where("size(members) > 0").select("item_id", "piece", "members").join(by_shuffle(theirs), ["item_id", "piece"])
        met = met.select("members", "raters", *others).mapInArrow(pairs.meetings(own, list(others), widths, half), form)
        packed = packed.where("pieces = 1").select(*met.columns).unionAll(met)
    return packed.select("members", "raters", *others), found["entries"] or 0


def _at_users(lists: DataFrame, entries: int, this: Column | None = None) -> DataFrame:
    """What members meet, at their user and part and sorted by these: (user_id, part, own columns, raters, lists)."""
    names = [c for c in lists.columns if c == "other_id" or c.endswith("_other")]
    rows = lists.select("raters", *names, F.inline("members")).drop("all_parts")
    rows = rows if this is None else rows.where(this)

    def rest(c: str) -> Column:
        if lists.schema[c].dataType.typeName() == "array":
            return F.slice(c, F.col("place") + 1, F.col("raters") - F.col("place"))
        start = F.col("place") * (F.octet_length(c) / F.col("raters")).cast("int") + 1
        return F.when(F.col("place") == 0, F.col(c)).otherwise(F.substring(c, start, F.octet_length(c)))

    own = [c for c in rows.columns if c not in ("raters", "user_id", "part", "place", *names)]
    rows = rows.select("user_id", "part", *own, (F.col("raters") - F.col("place")).alias("raters"), *[rest(c).alias(c) for c in names])
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_user = rows.repartition("user_id", "part") if entries <= usual * PARTITION_ENTRIES else spread(rows, entries, PARTITION_ENTRIES, "user_id", "part")
    return by_user.sortWithinPartitions("user_id", "part")


def _placed(
    rated: DataFrame, own: list[str], carried: list[str], part_raters: int | None, of: Column | None = None, half: bool = False,
    listed: str = "w",
) -> DataFrame:
    """Ratings with the raters of their item, at their user and part and sorted by these:
    (user_id, part, w, own columns, raters, and packed lists other_id, w_other, carried columns).

    Each rating is sent to its user with the list of its item's raters still folded and packed, which is a fraction of
    the rows and a quarter of the bytes of single pairs. A user with very many items (column ``parts``) is split into
    parts by partner, so no task gets all partners of such a user. With ``half`` only partners of higher id are listed.
    Raters are listed with the column ``listed`` as their weight (other than ``w``: those of 0 not at all).
    """
    return _at_users(*_item_lists(rated, own, carried, part_raters, of, half, listed))


def _summed(
    rated: DataFrame, own: list[str], carried: list[str], part_raters: int | None, task: pairs.Task, schema: str,
    of: Column | None = None, half: bool = False,
) -> DataFrame:
    """``task`` over ``_placed``, where little of the sums goes on.

    The pairs of many ratings are summed in rounds, some users in each, so that what is shuffled at a time stays in
    proportion to the ratings; the lists are written once.
    """
    lists, entries = _item_lists(rated, own, carried, part_raters, of, half, "w")
    if entries <= LEAST_ROUND:
        return _at_users(lists, entries).mapInArrow(task, schema)
    rounds = -(-entries // max(LEAST_ROUND, ROUND_ENTRIES * rated.count()))
    if rounds == 1:
        return _at_users(lists, entries).mapInArrow(task, schema)
    lists, turn = cut(lists, "item-lists"), F.pmod(F.xxhash64(F.lit(11), "user_id", "part"), F.lit(rounds))
    return reduce(DataFrame.unionAll, [cut(_at_users(lists, -(-entries // rounds), turn == i).mapInArrow(task, schema), "round") for i in range(rounds)])


def _id_type(rated: DataFrame) -> str:
    return rated.schema["user_id"].dataType.simpleString()


def partner_dots(
    rated: DataFrame, part_raters: int | None = PART_RATERS, of: Column | None = None, half: bool = False
) -> DataFrame:
    """Dot product and lengths of every two users that share an item, in both directions, or with
    ``half`` each pair once, from the lower id: (user_id, part, other_id, dot, n, n_other).

    ``rated`` comes from ``with_norms``. The one shuffle, by user, serves the sums per pair: the rows
    of a user lie together there and are summed up user by user. ``part_raters`` None saves the
    search for popular items where there are none; ``of`` narrows the users whose partners are wanted.
    """
    id_type = _id_type(rated)
    task = pairs.per_pair(["n"], [], pairs.all_pairs)
    schema = f"user_id {id_type}, part int, other_id {id_type}, dot long, n long, n_other long"
    return _placed(rated, ["n"], ["n"], part_raters, of, half).mapInArrow(task, schema)


def partners_nearest(rated: DataFrame, k: int, of: Column | None = None, part_raters: int | None = None) -> DataFrame:
    """The first k partners of every user and part: (user_id, part, other_id, cos). Popular items are split
    with ``part_raters`` only."""
    id_type = _id_type(rated)
    task = pairs.per_pair(["n"], [], pairs.nearest_pairs(k))
    return _summed(rated, ["n"], ["n"], part_raters, task, f"user_id {id_type}, part int, other_id {id_type}, cos double", of)


def partners_live(rated: DataFrame, k: int, of: Column | None = None) -> DataFrame:
    """Partners that can still be among a user's first k when items not in ``rated`` are added, whose squared
    length is ``hot_n``: (user_id, other_id, dot, n, n_other, add).

    The k-th best of a user's part bounds the k-th best of the user from below.
    """
    id_type, both = _id_type(rated), ["n", "hot_n"]
    task = pairs.per_pair(both, [], pairs.live_pairs(k, SLACK))
    schema = f"user_id {id_type}, other_id {id_type}, dot long, n long, n_other long, add boolean"
    return _summed(rated, both, both, None, task, schema, of)


def _mirrored(rows: DataFrame) -> DataFrame:
    """Pairs (user_id, other_id, cos) in both directions, without a second pass over them."""
    there = F.struct(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"), "cos")
    return rows.select(F.inline(F.array(F.struct("user_id", "other_id", "cos"), there)))


def with_cosine(dots: DataFrame, *keep: str) -> DataFrame:
    """(user_id, other_id, cos) of pairs carrying dot, n and n_other."""
    return dots.select("user_id", *keep, "other_id", cosine(F.col("dot"), F.col("n"), F.col("n_other")).alias("cos"))


def similarity(ratings: DataFrame, part_raters: int = PART_RATERS) -> DataFrame:
    """The whole similarity matrix off its diagonal, non-zero cells only.

    Its size is that of the answer itself: two users that share any item have a cell. To get
    only the nearest users, ``neighbors.top_neighbors`` does not go through this matrix.
    """
    return _mirrored(with_cosine(partner_dots(cut(with_norms(ratings), "rated"), part_raters, half=True)))


def similarity_of(ratings: DataFrame, user_ids: list | DataFrame) -> DataFrame:
    """Rows of the similarity matrix for the given users (a list, or a table with user_id).

    One-sided: only items of these users are listed, and only their rows meet the lists. A filter
    on the full matrix could not be pushed below the mirroring, hence this separate form.
    """
    rated, asked = _rows_of(ratings, user_ids)
    return with_cosine(partner_dots(rated, of=asked))


def nearest_of(ratings: DataFrame, user_ids: list | DataFrame, k: int) -> DataFrame:
    """The first k cells of each part of these rows: (user_id, part, other_id, cos), cut where the pairs are made."""
    rated, asked = _rows_of(ratings, user_ids)
    return partners_nearest(rated, k, asked, PART_RATERS)


def _rows_of(ratings: DataFrame, user_ids: list | DataFrame) -> tuple[DataFrame, Column]:
    """Ratings of the given users' items, as ``partner_dots`` takes them, and whether a rating is one of theirs."""
    mine = cut(of_users(ratings, user_ids).select("user_id", "item_id"), "asked-rows")
    per_user = user_norms(ratings).join(
        mine.groupBy("user_id").agg(F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts")), "user_id", "left"
    )
    touched = ratings.join(mine.select("item_id").distinct(), "item_id", "left_semi")
    rated = cut(touched.join(per_user, "user_id").select("user_id", "item_id", "w", "n", "parts"), "rated")
    return rated, F.col("parts").isNotNull()


def candidate_pairs(ratings: DataFrame, floor: float, part_raters: int = PART_RATERS) -> DataFrame:
    """Pairs of users that may have cosine >= ``floor``:
    (user_id, other_id, dot, n, n_other, size, size_other, open), user_id < other_id.

    A user's items count from the rarest up. Two users whose common items all lie where a row's
    remaining length is below ``floor`` cannot reach it, so only the items before that (the prefix)
    are listed, and the rarest common item of a pair that reaches it is in both prefixes. ``dot`` is
    the product over these. Common items behind a prefix are bounded by what remains of both rows;
    where that is nothing (``open`` is false), ``dot`` is exact.
    """
    if not 0 < floor <= 1:
        raise ValueError(f"the floor is a cosine above 0, got {floor}")
    raters = ratings.groupBy("item_id").agg(F.count("*").alias("raters"))
    rows = suffix_sums(ratings.join(raters, "item_id"), "user_id", ["raters", "item_id"], F.col("w") * F.col("w"), "suffixes")
    square, listed = F.col("w") * F.col("w"), F.col("rest") >= floor * floor * (1 - SLACK) * F.col("total")
    rows = rows.where(listed).select("user_id", "item_id", "w", F.col("total").alias("n"), "size", (F.col("rest") - square).alias("tail"))
    rows = cut(rows, "prefixes")
    # the tail of the last listed item is what is not listed of a row
    per_user = rows.groupBy("user_id").agg(F.min("tail").alias("unlisted"), F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts"))
    prefix = cut(rows.join(per_user, "user_id"), "prefix-rows")
    own, id_type = ["n", "size", "unlisted"], _id_type(ratings)
    task = pairs.per_pair(own, ["tail"], pairs.reaching_pairs(floor, SLACK))
    schema = f"user_id {id_type}, other_id {id_type}, dot long, n long, n_other long, size long, size_other long, open boolean"
    return _summed(prefix, [*own, "tail"], [*own, "tail"], part_raters, task, schema, half=True)


def similar_users(ratings: DataFrame, floor: float, part_raters: int = PART_RATERS) -> DataFrame:
    """Every two users with cosine >= ``floor`` (above 0), in both directions: (user_id, other_id, cos).

    Pairs come from ``candidate_pairs``. Only those with items that are not listed are multiplied
    out: the shorter row of a pair looks up its items in the other one. ``ratings`` is read several
    times, so give it as a written table.
    """
    candidates = cut(candidate_pairs(ratings, floor, part_raters), "candidate-pairs")
    turned = F.col("size") > F.col("size_other")
    wanted = candidates.where("open").select(
        "user_id", "other_id", "n", "n_other",
        F.when(turned, F.col("other_id")).otherwise(F.col("user_id")).alias("short_id"),
        F.when(turned, F.col("user_id")).otherwise(F.col("other_id")).alias("long_id"),
    )
    short = ratings.select(F.col("user_id").alias("short_id"), "item_id", "w")
    long = ratings.select(F.col("user_id").alias("long_id"), "item_id", F.col("w").alias("w_other"))
    dots = wanted.join(short, "short_id").join(long, ["long_id", "item_id"]).groupBy("user_id", "other_id")
    dots = dots.agg(F.sum(F.col("w") * F.col("w_other")).alias("dot"), F.first("n").alias("n"), F.first("n_other").alias("n_other"))
    done = candidates.where("not open").select(*dots.columns)
    return _mirrored(with_cosine(dots.unionByName(done)).where(F.col("cos") >= floor))


def pair_changes(old: DataFrame, change: DataFrame) -> DataFrame:
    """How added weights ``change`` change the dot products: (user_id, other_id, d), in both directions.

    ``old`` are the ratings before, (user_id, item_id, w) at least of the changed items. A dot
    product changes by new x new, new x old and old x new weights; only items with a change are
    joined, dealt out over several keys where they are popular.
    """
    items = change.select("item_id").distinct()
    both = old.join(items, "item_id", "left_semi").select("user_id", "item_id", F.col("w").alias("before"), F.lit(0).cast("long").alias("added"))
    both = both.unionByName(change.select("user_id", "item_id", F.lit(0).cast("long").alias("before"), F.col("w").alias("added")))
    both = cut(both.groupBy("user_id", "item_id").agg(F.sum("before").alias("before"), F.sum("added").alias("added")), "changed-items")
    after = F.col("before") + F.col("added")
    # d = own added x the other's new weight + own old x the other's added weight: two products, listed
    # as if under two items, so that new x new counts once and a pair's changes add up in one place
    cells = F.array(
        F.struct(F.struct("item_id", F.lit(0).alias("side")).alias("item_id"), F.col("added").alias("w"), after.alias("listed")),
        F.struct(F.struct("item_id", F.lit(1).alias("side")).alias("item_id"), F.col("before").alias("w"), F.col("added").alias("listed")),
    )
    known = both.where("user_id is not null and item_id is not null")
    parts = known.groupBy("user_id").agg(F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts"))
    rated = cut(known.join(parts, "user_id").select("user_id", "parts", F.inline(cells)).where("w <> 0 or listed <> 0"), "changed-cells")
    id_type = _id_type(rated)
    placed = _placed(rated, [], [], PART_RATERS, of=F.col("w") != 0, half=True, listed="listed")
    task = pairs.per_pair([], [], pairs.all_pairs)
    dots = placed.mapInArrow(task, f"user_id {id_type}, part int, other_id {id_type}, dot long").where("dot <> 0")
    there = F.struct(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"), F.col("dot").alias("d"))
    return dots.select(F.inline(F.array(F.struct("user_id", "other_id", F.col("dot").alias("d")), there)))


def norm_changes(old: DataFrame, change: DataFrame) -> DataFrame:
    """How added weights change the squared lengths: (user_id, d)."""
    before = old.select("user_id", "item_id", F.col("w").alias("before"))
    rows = change.join(before, ["user_id", "item_id"], "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    return rows.groupBy("user_id").agg(F.sum(F.col("w") * (2 * F.col("before") + F.col("w"))).alias("d"))
