"""The recommenders: ratings -> neighbours -> ranked items, as jobs over all or given users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.listing import unknown_ids
from cadenza.operators.neighbors import top_neighbors
from cadenza.operators.ratings import LIKE_TENTHS, binary_ratings, combined_ratings, known_only, of_users, play_ratings
from cadenza.operators.recommend import fill_page, neighbor_rows, page_bounds, recommend
from cadenza.plans.materialize import cut

# Neighbours per user, page size, and items of the unpaged lists.
NEIGHBORS = 5
PAGE_SIZE = 10
FIRST_ITEMS = 5


def universe(df: DataFrame) -> DataFrame:
    """(user_id) of a user table."""
    return df.select(F.col("id").alias("user_id"))


def raters(ratings: DataFrame) -> DataFrame:
    """(user_id) of the users that rated anything."""
    return ratings.select("user_id").distinct()


def _require_users(user_ids: list | DataFrame | None, users: DataFrame) -> None:
    if user_ids is None:
        return
    if isinstance(user_ids, DataFrame):
        asked = user_ids.select("user_id")
    else:
        asked = users.sparkSession.createDataFrame([(u,) for u in user_ids], users.select("user_id").schema)
    missing = [r[0] for r in unknown_ids(asked, users).limit(20).collect()]
    if missing:
        raise ValueError(f"unknown user: {', '.join(map(str, sorted(missing)))}")


def _run(ratings, users, items, scale, first, last, user_ids=None) -> DataFrame:
    """Both steps over written tables; ``scale`` turns weights into scores."""
    _require_users(user_ids, users)
    near = cut(top_neighbors(ratings, users, NEIGHBORS, user_ids), "neighbors")
    head = cut(recommend(near, ratings, 1, last, user_ids), "scored")
    wanted = users if user_ids is None else of_users(users, user_ids)
    out = fill_page(head, ratings, wanted, items, first, last)
    return out.select("user_id", "rank", "item_id", (F.col("w") / scale).alias("score"))


def item_ids(df: DataFrame) -> DataFrame:
    """(item_id) of a song or artist table."""
    return df.select(F.col("id").alias("item_id"))


def recommend_songs(
    like: DataFrame, play: DataFrame, user: DataFrame, song: DataFrame,
    page: int = 1, page_size: int = PAGE_SIZE, user_ids: list | DataFrame | None = None,
) -> DataFrame:
    """One page of songs per user from likes and plays: (user_id, rank, item_id, score).

    All songs the user has not touched are candidates: after those that neighbours touched come
    the others with score 0, so every page is full as long as the catalogue lasts. Interactions
    of unknown users or songs take no part.
    """
    ratings = cut(known_only(combined_ratings(like, play), user, song), "ratings")
    return _run(ratings, universe(user), item_ids(song), float(LIKE_TENTHS), *page_bounds(page, page_size), user_ids)


def recommend_artists(
    follow: DataFrame, user: DataFrame, artist: DataFrame,
    page: int = 1, page_size: int = PAGE_SIZE, user_ids: list | DataFrame | None = None,
) -> DataFrame:
    """One page of artists per user from follows: (user_id, rank, item_id, score). Follows of
    unknown users or artists take no part."""
    ratings = cut(known_only(binary_ratings(follow, "artistId"), user, artist), "follows")
    return _run(ratings, universe(user), item_ids(artist), 1.0, *page_bounds(page, page_size), user_ids)


def recommend_from_likes(like: DataFrame, user_ids: list | DataFrame | None = None) -> DataFrame:
    """First songs from likes alone, among the users and songs with any like."""
    ratings = cut(binary_ratings(like, "songId"), "likes")
    return _run(ratings, raters(ratings), rated_items(ratings), 1.0, 1, FIRST_ITEMS, user_ids)


def recommend_from_plays(play: DataFrame, user_ids: list | DataFrame | None = None) -> DataFrame:
    """First songs from play counts alone, among the users and songs with any play."""
    ratings = cut(play_ratings(play), "plays")
    return _run(ratings, raters(ratings), rated_items(ratings), 1.0, 1, FIRST_ITEMS, user_ids)


def rated_items(ratings: DataFrame) -> DataFrame:
    """(item_id) of the items that anybody rated."""
    return ratings.select("item_id").distinct()


def _lists(ratings: DataFrame, near_name: str, item_name: str) -> DataFrame:
    """Per rater the ids of neighbours and of recommended items, best first."""
    users = raters(ratings)
    near = cut(top_neighbors(ratings, users, NEIGHBORS), "neighbors")
    head = cut(recommend(near, ratings, 1, FIRST_ITEMS), "scored")
    items = fill_page(head, ratings, users, rated_items(ratings), 1, FIRST_ITEMS)
    in_order = lambda c: F.transform(
        F.sort_array(F.collect_list(F.struct("rank", c))), lambda x: x[c]
    )
    return near.groupBy("user_id").agg(in_order("other_id").alias(near_name)).join(
        items.groupBy("user_id").agg(in_order("item_id").alias(item_name)), "user_id", "left"
    )


def recommend_report(like: DataFrame, play: DataFrame) -> DataFrame:
    """Four lists per user, from likes and from plays. Users missing on either side get no lists
    but an error text."""
    likes = _lists(cut(binary_ratings(like, "songId"), "likes"), "similar_users", "recommended_songs")
    plays = _lists(cut(play_ratings(play), "plays"), "similar_play_users", "recommendations_play")
    both = likes.join(plays, "user_id", "full")
    ok = F.col("similar_users").isNotNull() & F.col("similar_play_users").isNotNull()
    lists = ["similar_users", "recommended_songs", "similar_play_users", "recommendations_play"]
    return both.select(
        "user_id", *[F.when(ok, F.col(c)).alias(c) for c in lists], F.when(~ok, "unknown user").alias("error")
    )


def neighbor_items(like: DataFrame, k: int = 10) -> DataFrame:
    """Distinct songs liked by any of a user's k nearest users, own songs included."""
    ratings = cut(binary_ratings(like, "songId"), "likes")
    near = cut(top_neighbors(ratings, raters(ratings), k).select("user_id", "other_id"), "neighbors")
    return neighbor_rows(near, ratings).select("user_id", "item_id").distinct()
