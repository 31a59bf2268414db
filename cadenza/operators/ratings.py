"""User-item weights in long sparse form: an absent row is a zero cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A like counts 1 and a play 0.1. Kept as integer tenths so that sums, dot
# products and norms are exact and do not depend on task order.
LIKE_TENTHS = 10
PLAY_TENTHS = 1


def edges(df: DataFrame, item_col: str, user_col: str = "userId") -> DataFrame:
    """An interaction table as (user_id, item_id), one row per interaction."""
    return df.select(F.col(user_col).alias("user_id"), F.col(item_col).alias("item_id"))


def of_users(df: DataFrame, user_ids: list | DataFrame) -> DataFrame:
    """Rows of the given users: a list of ids, or a table of any size with user_id."""
    if isinstance(user_ids, DataFrame):
        return df.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    return df.where(F.col("user_id").isin(user_ids))


def combined_ratings(
    likes: DataFrame, plays: DataFrame, like_tenths: int = LIKE_TENTHS, play_tenths: int = PLAY_TENTHS
) -> DataFrame:
    """Weight of every touched (user, item) in tenths; repeated interactions add up."""
    weighted = edges(likes, "songId").withColumn("w", F.lit(like_tenths)).unionAll(
        edges(plays, "songId").withColumn("w", F.lit(play_tenths))
    )
    return weighted.groupBy("user_id", "item_id").agg(F.sum("w").alias("w"))


def binary_ratings(df: DataFrame, item_col: str) -> DataFrame:
    """Weight 1 for every touched (user, item); repeated interactions collapse."""
    return edges(df, item_col).distinct().withColumn("w", F.lit(1).cast("long"))


def play_counts(plays: DataFrame) -> DataFrame:
    """Number of plays per (user, song).

    Joining the songs first would change nothing: it is an outer join on their key, and no
    song column is read.
    """
    return plays.groupBy(F.col("userId").alias("user_id"), F.col("songId").alias("song_id")).agg(
        F.count("songId").alias("listen_count")
    )


def play_ratings(plays: DataFrame) -> DataFrame:
    """Play counts as weights."""
    return play_counts(plays).select(
        "user_id", F.col("song_id").alias("item_id"), F.col("listen_count").alias("w")
    )


def known_only(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings whose user and item both exist (``users.id``, ``items.id``)."""
    return ratings.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").join(
        items.select(F.col("id").alias("item_id")), "item_id", "left_semi"
    )


def orphans(edge: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Edges that name an unknown user or item, with what is missing."""
    known_user = users.select(F.col("id").alias("user_id"), F.lit(True).alias("has_user"))
    known_item = items.select(F.col("id").alias("item_id"), F.lit(True).alias("has_item"))
    return (
        edge.join(known_user, "user_id", "left")
        .join(known_item, "item_id", "left")
        .where(F.col("has_user").isNull() | F.col("has_item").isNull())
        .select(
            "user_id",
            "item_id",
            F.col("has_user").isNull().alias("unknown_user"),
            F.col("has_item").isNull().alias("unknown_item"),
        )
    )


def defects(edge: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Edges, and those with an unknown user or item, counted in one pass: (edges, unknown_user, unknown_item)."""
    known_user = users.select(F.col("id").alias("user_id"), F.lit(True).alias("has_user"))
    known_item = items.select(F.col("id").alias("item_id"), F.lit(True).alias("has_item"))
    return edge.join(known_user, "user_id", "left").join(known_item, "item_id", "left").agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("has_user").isNull()).alias("unknown_user"),
        F.count_if(F.col("has_item").isNull()).alias("unknown_item"),
    )


def duplicates(edge: DataFrame) -> DataFrame:
    """Pairs that occur more than once, with how often."""
    return edge.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def wide_matrix(ratings: DataFrame, users: DataFrame, items: DataFrame, prefix: str = "") -> DataFrame:
    """One row per user of ``users`` (id), one column per item of ``items`` (id), 0 where there is no rating.

    The items become the table's columns, so their ids are read first, as any schema. For a whole
    catalogue use ``matrix.wide_blocks``, whose columns do not grow with it.
    """
    found = [r[0] for r in items.select("id").distinct().orderBy("id").collect()]
    cells = ratings.groupBy("user_id").pivot("item_id", found).agg(F.sum("w"))
    rows = users.select(F.col("id").alias("user_id")).join(cells, "user_id", "left")
    return rows.select("user_id", *[F.coalesce(F.col(f"`{i}`"), F.lit(0).cast("long")).alias(f"{prefix}{i}") for i in found])
