"""Plain listings, dynamic filter/order/group, lookups by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_listing(user: DataFrame) -> DataFrame:
    return user.select("id", "username", "email")


def song_listing(song: DataFrame) -> DataFrame:
    """All songs, private ones included."""
    return song.select("id", "title")


def comment_listing(comment: DataFrame) -> DataFrame:
    """All comments, hidden ones included."""
    return comment.select("id", "commentParentId", "userId", "songId", "content", "hide")


def _known(df: DataFrame, columns) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")


def select_rows(
    df: DataFrame,
    conditions: dict | None = None,
    order: str | None = None,
    group: str | None = None,
    aggregates: list[Column] | None = None,
) -> DataFrame:
    """ANDed equality conditions, then an optional order or grouping by one column.

    Grouping needs aggregates: a bare group of whole rows has no defined result.
    """
    conditions = conditions or {}
    _known(df, [*conditions, *[c for c in (order, group) if c]])
    df = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), conditions.items(), df)
    if group:
        if not aggregates:
            raise ValueError("grouping needs at least one aggregate")
        df = df.groupBy(group).agg(*aggregates)
    return df.orderBy(order) if order else df


def with_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the first column of ``ids``."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key))
    return df.join(wanted, key, "left_semi")


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """One row per requested id with the row found, or nulls if there is none."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return wanted.join(df, key, "left")


def lookup_one(df: DataFrame, value, key: str = "id"):
    """The row with this key, or None."""
    return df.where(F.col(key) == F.lit(value)).limit(1).first()


def unknown_ids(ids: DataFrame, universe: DataFrame) -> DataFrame:
    """Requested ids (first column) that are not in the first column of ``universe``."""
    key = ids.columns[0]
    return ids.select(key).distinct().join(universe.select(F.col(universe.columns[0]).alias(key)), key, "left_anti")


def require_known(value, universe: DataFrame) -> None:
    """Raise if a single id is not in the first column of ``universe``."""
    if lookup_one(universe, value, universe.columns[0]) is None:
        raise ValueError(f"unknown id: {value}")
