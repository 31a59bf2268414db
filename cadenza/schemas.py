"""Domain tables: column types, allowed values and foreign keys.

Ids are strings in production; every operator only compares and orders ids, so any
orderable id type (the test tables use longs) works.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The table and column names, types and nullability of the domain.
DDL = {
    "User": "id string not null, role string not null, username string not null, "
    "email string not null, password string not null, name string, image string, "
    "accountType string not null, status string not null",
    "Song": "id string not null, title string not null, duration int, lyric string, "
    "filePathAudio string not null, privacy boolean not null, uploadUserId string, "
    "releaseDate date, image string, createdAt timestamp_ntz not null",
    "Like": "likeId string not null, userId string not null, songId string not null",
    "SongPlayHistory": "historyId string not null, userId string not null, "
    "songId string not null, playtime int",
    "Follow": "followerId string not null, userId string not null, artistId string not null",
    "Artist": "id string not null, name string not null, avatar string, bio string, hide boolean",
    "ArtistSong": "artistSongId string not null, songId string not null, "
    "artistId string not null, main boolean not null",
    "Genre": "genreId string not null, name string not null",
    "ArtistGenre": "artistGenreId string not null, artistId string not null, "
    "genreId string not null",
    "Album": "albumId string not null, title string not null, releaseDate date, "
    "albumType string not null",
    "AlbumSong": "id string not null, songId string not null, albumId string not null",
    "AlbumImage": "albumImageId string not null, albumId string not null, image string, size int",
    "Comment": "id string not null, commentParentId string, userId string not null, "
    "songId string not null, content string not null, hide boolean not null, "
    "createdAt timestamp_ntz not null, updatedAt timestamp_ntz not null",
    "Report": "id string not null, userId string, commentId string not null, "
    "content string not null, status string not null, createdAt timestamp_ntz not null, "
    "updatedAt timestamp_ntz not null",
}

# What the enumerated columns may hold.
ENUMS = {
    ("User", "role"): ["Admin", "User"],
    ("User", "accountType"): ["PREMIUM", "FREE"],
    ("User", "status"): ["NORMAL", "LOCK3", "LOCK7", "PERMANENT"],
    ("Album", "albumType"): ["album", "single", "ep"],
    ("Report", "status"): ["AI", "PENDING", "DELETE", "NOTDELETE"],
}

# Child table, child column -> parent table, parent key.
FOREIGN_KEYS = [
    ("Comment", "userId", "User", "id"),
    ("Comment", "songId", "Song", "id"),
    ("Song", "uploadUserId", "User", "id"),
    ("Like", "userId", "User", "id"),
    ("Like", "songId", "Song", "id"),
    ("SongPlayHistory", "userId", "User", "id"),
    ("SongPlayHistory", "songId", "Song", "id"),
    ("Follow", "userId", "User", "id"),
    ("Follow", "artistId", "Artist", "id"),
    ("ArtistSong", "songId", "Song", "id"),
    ("ArtistSong", "artistId", "Artist", "id"),
    ("ArtistGenre", "artistId", "Artist", "id"),
    ("ArtistGenre", "genreId", "Genre", "genreId"),
    ("AlbumSong", "songId", "Song", "id"),
    ("AlbumSong", "albumId", "Album", "albumId"),
    ("AlbumImage", "albumId", "Album", "albumId"),
    ("Report", "userId", "User", "id"),
    ("Report", "commentId", "Comment", "id"),
]


def schema(table: str) -> StructType:
    """The declared schema of one domain table."""
    return StructType.fromDDL(DDL[table])


def enum_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows whose enumerated columns hold a value that is not allowed."""
    bad = [~F.col(c).isin(v) for (t, c), v in ENUMS.items() if t == table and c in df.columns]
    return df.where(reduce(Column.__or__, bad, F.lit(False)))
