"""The supplied order/event/document tables seen as the domain tables.

Likes and plays are order lines (user = customer, song = part), follows are customer-supplier
pairs, comments are documents whose author, song and time come from the event with the same
number. Only the names of columns are given a new meaning; no row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "MEDIA"


@dataclass
class Domain:
    """Domain tables over one folder of test tables; each is built when first asked for."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def read_stream(self, name: str) -> DataFrame:
        """A stream over the files of a table, be it one file or a folder of them.

        The path is a pattern that fits this name only: as base path of its files Spark takes a
        plain one, which must be a folder.
        """
        return self.spark.readStream.schema(self.read(name).schema).parquet(f"{self.folder}/{name}.parque[t]")

    @cached_property
    def user(self) -> DataFrame:
        key, name = F.col("c_custkey"), F.col("c_name")
        image = F.when(F.col("c_acctbal") >= 0, F.concat(
            F.when(key % 2 == 0, f"{MARKER}/avatar/").otherwise("https://img.example.org/"), key.cast("string"), F.lit(".png")
        ))
        return self.read("customer").select(
            key.alias("id"),
            F.when(key % 100 == 0, "Admin").otherwise("User").alias("role"),
            name.alias("username"),
            F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
            F.lit("").alias("password"),
            name.alias("name"),
            image.alias("image"),
            F.when(F.col("c_mktsegment") == "BUILDING", "PREMIUM").otherwise("FREE").alias("accountType"),
            F.lit("NORMAL").alias("status"),
        )

    @cached_property
    def song(self) -> DataFrame:
        key = F.col("p_partkey")
        path = F.when(
            key % 2 == 0, F.concat(F.lit("audio/"), F.lit(f"{MARKER}/"), F.col("p_brand"), F.lit("/"), key.cast("string"), F.lit(".mp3"))
        ).otherwise(F.concat(F.lit("https://cdn.example.org/"), key.cast("string"), F.lit(".mp3")))
        return self.read("part").select(
            key.alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_size").cast("int").alias("duration"),
            F.lit(None).cast("string").alias("lyric"),
            path.alias("filePathAudio"),
            (F.col("p_type") == "SMALL").alias("privacy"),
            F.lit(None).cast("long").alias("uploadUserId"),
            F.when(F.col("p_size") > 5, F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int"))).alias("releaseDate"),
            F.lit(None).cast("string").alias("image"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey)").alias("createdAt"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("userId"))
        return self.read("lineitem").join(orders, "l_orderkey")

    @staticmethod
    def _line_id():
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    @cached_property
    def like(self) -> DataFrame:
        return self._lines.where("l_returnflag = 'R'").select(
            self._line_id().alias("likeId"), "userId", F.col("l_partkey").alias("songId")
        )

    @cached_property
    def play(self) -> DataFrame:
        return self._lines.where("l_returnflag <> 'R'").select(
            self._line_id().alias("historyId"), "userId", F.col("l_partkey").alias("songId"), F.col("l_quantity").cast("int").alias("playtime")
        )

    @cached_property
    def follow(self) -> DataFrame:
        return self._lines.where("l_returnflag = 'R' and l_linestatus = 'F'").select(
            self._line_id().alias("followerId"), "userId", F.col("l_suppkey").alias("artistId")
        )

    @cached_property
    def event_as_song(self) -> DataFrame:
        """Edges to event ids taken as songs, many of them unknown."""
        return self.read("events").select(F.col("user_id").alias("userId"), F.col("event_id").alias("songId"))

    @cached_property
    def event_as_user(self) -> DataFrame:
        """Edges of event ids taken as users, many of them unknown."""
        return self.read("events").select(F.col("event_id").alias("userId"), F.get_json_object("props", "$.k").cast("long").alias("songId"))

    @cached_property
    def artist(self) -> DataFrame:
        key = F.col("s_suppkey")
        avatar = F.concat(F.when(key % 2 == 0, f"{MARKER}/artist/").otherwise("artist/"), key.cast("string"), F.lit(".jpg"))
        return self.read("supplier").select(
            key.alias("id"), F.col("s_name").alias("name"), avatar.alias("avatar"),
            F.lit(None).cast("string").alias("bio"), (F.col("s_acctbal") < 0).alias("hide"),
        )

    @cached_property
    def artist_song(self) -> DataFrame:
        pairs = self.read("lineitem").groupBy(F.col("l_partkey").alias("songId"), F.col("l_suppkey").alias("artistId"))
        return pairs.agg(F.max(F.col("l_linenumber") == 1).alias("main")).select(
            F.concat_ws("-", "songId", "artistId").alias("artistSongId"), "songId", "artistId", "main"
        )

    @cached_property
    def genre(self) -> DataFrame:
        nation = self.read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("genreId"), F.col("n_name").alias("name"))
        region = self.read("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("genreId"), F.col("r_name").alias("name"))
        return nation.unionAll(region)

    @cached_property
    def artist_genre(self) -> DataFrame:
        nation = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        both = F.explode(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
        rows = self.read("supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("artistId"), both.alias("genreId"))
        return rows.select(F.concat_ws("-", "artistId", "genreId").alias("artistGenreId"), "artistId", "genreId")

    @cached_property
    def album(self) -> DataFrame:
        return self.read("part").select(F.col("p_brand").alias("albumId")).distinct().select(
            "albumId", F.col("albumId").alias("title"), F.lit(None).cast("date").alias("releaseDate"), F.lit("album").alias("albumType")
        )

    @cached_property
    def album_song(self) -> DataFrame:
        return self.read("part").select(
            F.concat_ws("-", "p_brand", "p_partkey").alias("id"), F.col("p_partkey").alias("songId"), F.col("p_brand").alias("albumId")
        )

    @cached_property
    def album_image(self) -> DataFrame:
        image = F.concat(F.when(F.col("p_type") == "SMALL", "").otherwise(f"{MARKER}/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(".jpg"))
        return self.read("part").select("p_brand", "p_type").distinct().select(
            F.concat_ws("-", "p_brand", "p_type").alias("albumImageId"), F.col("p_brand").alias("albumId"),
            image.alias("image"), F.length("p_type").alias("size"),
        )

    @cached_property
    def comment_request(self) -> DataFrame:
        return comment_request(self.read("documents"), self.read("events"))

    @cached_property
    def existing_comment(self) -> DataFrame:
        """Comments already stored, as far as a reply to them may ask: the labelled documents."""
        return self.read("labels").select(F.col("doc_id").alias("id"))

    def tables(self) -> dict[str, DataFrame]:
        """Domain tables by their declared name."""
        return {
            "User": self.user, "Song": self.song, "Like": self.like, "SongPlayHistory": self.play, "Follow": self.follow,
            "Artist": self.artist, "ArtistSong": self.artist_song, "Genre": self.genre, "ArtistGenre": self.artist_genre,
            "Album": self.album, "AlbumSong": self.album_song, "AlbumImage": self.album_image,
        }


def comment_request(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Comment requests; every third one is a reply."""
    about = events.select(
        F.col("event_id").alias("doc_id"),
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("long").alias("songId"),
        F.col("ts").alias("createdAt"),
    )
    return documents.select("doc_id", "text").join(about, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") - 7).alias("commentParentId"),
        "userId",
        "songId",
        F.col("text").alias("content"),
        "createdAt",
    )


def event_edges(events: DataFrame) -> DataFrame:
    """Purchases as likes and views as plays: (kind, userId, songId)."""
    kind = F.when(F.col("event_type") == "purchase", "like").when(F.col("event_type") == "view", "play")
    return events.select(
        kind.alias("kind"), F.col("user_id").alias("userId"), F.get_json_object("props", "$.k").cast("long").alias("songId")
    ).where(F.col("kind").isNotNull())
