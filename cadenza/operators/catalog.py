"""Songs and artists as nested records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import local_time_text, media_url, row_salt, secure_media_path
from cadenza.plans.materialize import by_shuffle, cut


@dataclass(frozen=True)
class Media:
    """Where stored objects are, and the secrets paths are sealed with; given by the caller."""

    marker: str
    bucket: str
    endpoint: str
    password: str
    nonce: str

    def url(self, path):
        return media_url(path, self.marker, self.bucket, self.endpoint)

    def sealed(self, path, row_id):
        return secure_media_path(path, self.marker, self.password, row_salt(row_id, self.nonce))


def _nested(df: DataFrame, key: str, name: str, *fields) -> DataFrame:
    """Child rows of each key as one sorted array of structs."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _or_empty(df: DataFrame, name: str):
    return F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)


def artist_genres(artist_genre: DataFrame, genre: DataFrame) -> DataFrame:
    """(artistId, genres)."""
    return _nested(artist_genre.join(genre, "genreId"), "artistId", "genres", "genreId", "name")


def song_albums(album: DataFrame, album_song: DataFrame, album_image: DataFrame, media: Media) -> DataFrame:
    """(songId, album): albums of each song with their images."""
    images = _nested(
        album_image.select("albumId", media.url(F.col("image")).alias("image"), "size"),
        "albumId", "albumImages", "image", "size",
    )
    whole = album.select("albumId", "title", "albumType").join(images, "albumId", "left")
    whole = whole.select("albumId", "title", "albumType", _or_empty(whole, "albumImages"))
    return _nested(by_shuffle(album_song).join(whole, "albumId"), "songId", "album", "albumId", "title", "albumType", "albumImages")


def song_artists(artist: DataFrame, artist_song: DataFrame, genres: DataFrame) -> DataFrame:
    """(songId, artists): artists of each song with genres, and ``main`` of the bridge row."""
    whole = artist.select(F.col("id").alias("artistId"), "name").join(genres, "artistId", "left")
    whole = whole.select("artistId", "name", _or_empty(whole, "genres"))
    rows = artist_song.select("songId", "artistId", "main").join(whole, "artistId")
    return _nested(
        rows, "songId", "artists",
        F.col("artistId").alias("id"), "name", "genres", F.struct("main").alias("ArtistSong"),
    )


def song_cards(t, media: Media, ids: DataFrame | None = None) -> DataFrame:
    """One nested record per song of the domain ``t``, or per song in ``ids``.

    Each kind of child is folded to one array per song before it is joined, so albums and
    artists do not multiply each other. ``ids`` narrows the bridge tables too.
    """
    song, album_song, artist_song = t.song, t.album_song, t.artist_song
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        wanted = cut(wanted, "wanted-songs")
        song = song.join(by_shuffle(wanted), "id", "left_semi")
        wanted = wanted.withColumnRenamed("id", "songId")
        album_song = album_song.join(by_shuffle(wanted), "songId", "left_semi")
        artist_song = artist_song.join(by_shuffle(wanted), "songId", "left_semi")
    albums = song_albums(t.album, album_song, t.album_image, media)
    artists = song_artists(t.artist, artist_song, artist_genres(t.artist_genre, t.genre))
    cards = (
        song.join(by_shuffle(albums.withColumnRenamed("songId", "id")), "id", "left")
        .join(by_shuffle(artists.withColumnRenamed("songId", "id")), "id", "left")
    )
    return cards.select(
        F.col("id").cast("string").alias("id"),
        "title",
        local_time_text(F.col("releaseDate")).alias("releaseDate"),
        "duration",
        "lyric",
        media.sealed(F.col("filePathAudio"), F.col("id")).alias("filePathAudio"),
        local_time_text(F.col("createdAt")).alias("createdAt"),
        _or_empty(cards, "album"),
        _or_empty(cards, "artists"),
    )


def artist_cards(t, media: Media, ids: DataFrame | None = None) -> DataFrame:
    """One nested record per artist of the domain ``t``, or per artist in ``ids``."""
    artist = t.artist
    if ids is not None:
        artist = artist.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")
    genres = artist_genres(t.artist_genre, t.genre).withColumnRenamed("artistId", "id")
    cards = artist.join(genres, "id", "left")
    return cards.select(
        F.col("id").cast("string").alias("id"),
        "name",
        media.url(F.col("avatar")).alias("avatar"),
        "bio",
        _or_empty(cards, "genres"),
    )


def ranked_cards(recommended: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of recommended items with the user and rank they belong to."""
    picks = recommended.withColumn("id", F.col("item_id").cast("string"))
    return picks.select("user_id", "rank", "id").join(cards, "id")
