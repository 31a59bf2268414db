"""Schemas, listings, cards, reading and writing."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.operators import catalog, integrity, listing
from cadenza.plans import materialize
from cadenza.plans.materialize import cut, shared_folder
from cadenza.sources import tables
from cadenza.sources.testdata import Domain


def test_adapter_has_the_declared_columns(spark):
    for name, df in Domain(spark, "/root/testdata/sf0.001").tables().items():
        declared = schemas.schema(name)
        assert df.columns == declared.names, name
        assert schemas.enum_violations(df, name).isEmpty(), name
        for mine, want in zip(df.schema, declared):
            if not mine.name.lower().endswith("id"):
                assert mine.dataType == want.dataType, (name, mine.name)


def test_enum_violations(spark):
    df = spark.createDataFrame([("x", "Free"), ("y", "FREE")], "id string, accountType string")
    assert [r["id"] for r in schemas.enum_violations(df, "User").collect()] == ["x"]


def test_every_table_reads_with_its_schema(spark, tmp_path):
    for name in schemas.DDL:
        path = str(tmp_path / name)
        spark.createDataFrame([], schemas.schema(name)).write.parquet(path)
        assert tables.read_table(spark, name, path).columns == schemas.schema(name).names


def test_csv_json_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, None), (3, 4, "x")], "user_id long, item_id long, note string")
    for _ in range(2):
        tables.write_csv(df, str(tmp_path / "csv"))
        tables.write_json(df, str(tmp_path / "json"))
        tables.append(df, str(tmp_path / "rows"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {"user_id": 1, "item_id": 2, "note": None} in lines and len(lines) == 2
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:postgresql://h/d", "songs", user="u", password="p")
    assert plain["dbtable"] == "songs" and plain["user"] == "u" and "numPartitions" not in plain
    split = tables.jdbc_options("jdbc:postgresql://h/d", "plays", "id", 1, 1000, 8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "1", "1000", "8")
    with pytest.raises(ValueError):
        tables.jdbc_options("u", "t", "id")


def test_cut_goes_to_the_shared_folder(spark):
    df = cut(spark.range(5), "five")
    assert df.count() == 5 and shared_folder(spark).removeprefix("file:") in df.inputFiles()[0]


def test_shared_folder_without_setting(spark, monkeypatch):
    monkeypatch.setattr(materialize, "_SETTING", "spark.no.such.setting")
    assert shared_folder(spark) == shared_folder(spark)
    assert cut(spark.range(3), "three").count() == 3


def test_select_rows(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "title string, n int")
    assert [r["title"] for r in listing.select_rows(df, {"n": 1}, order="title").collect()] == ["a", "b"]
    grouped = listing.select_rows(df, group="n", aggregates=[F.count("*").alias("k")], order="n")
    assert [tuple(r) for r in grouped.collect()] == [(1, 2), (2, 1)]
    for bad in ({"conditions": {"x": 1}}, {"order": "x"}, {"group": "n"}):
        with pytest.raises(ValueError):
            listing.select_rows(df, **bad)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    ids = spark.createDataFrame([(2,), (2,), (5,)], "k long")
    assert sorted(map(tuple, listing.lookup(df, ids).collect())) == [(2, "b"), (5, None)]
    assert [r["id"] for r in listing.with_ids(df, ids).collect()] == [2]
    assert listing.lookup_one(df, 1)["name"] == "a" and listing.lookup_one(df, 9) is None


def test_fk_integrity(spark):
    like = spark.createDataFrame([("l", 1, 1), ("m", 7, 1), ("n", None, 3)], "likeId string, userId long, songId long")
    song = spark.createDataFrame([(1, None), (2, 1)], "id long, uploadUserId long")
    got = integrity.fk_integrity({"Like": like, "User": spark.range(3), "Song": song})
    assert sorted(map(tuple, got.collect())) == [("Like.songId", 3, 1), ("Like.userId", 2, 1), ("Song.uploadUserId", 1, 0)]
    users = spark.createDataFrame([(1, "ann")], "id long, name string")
    followed = integrity.expand(like, users, "userId").select("likeId", "parent_name").collect()
    assert [tuple(r) for r in followed] == [("l", "ann")]


class Songs:
    """A small domain with a song on two albums, one with no artist and one with no path marker."""

    def __init__(self, spark):
        df = spark.createDataFrame
        at = datetime(2024, 1, 1, 20)
        self.song = df(
            [(1, "one", 10, None, "a/MARK/1.mp3", date(2024, 5, 1), at), (2, "two", None, "la", "plain", None, at)],
            "id long, title string, duration int, lyric string, filePathAudio string, releaseDate date, createdAt timestamp_ntz",
        )
        self.album = df([(1, "A", "ep"), (2, "B", "album")], "albumId long, title string, albumType string")
        self.album_song = df([(1, 1), (1, 2)], "songId long, albumId long")
        self.album_image = df([(1, "MARK/c.jpg", 64), (1, None, 32)], "albumId long, image string, size int")
        self.artist = df(
            [(1, "ann", "MARK/a.jpg", "bio"), (2, "bob", None, None)], "id long, name string, avatar string, bio string"
        )
        self.artist_song = df([(1, 1, True), (1, 2, False)], "songId long, artistId long, main boolean")
        self.genre = df([(1, "rock"), (2, "jazz")], "genreId long, name string")
        self.artist_genre = df([(1, 1), (1, 2)], "artistId long, genreId long")


def test_cards(spark):
    t, media = Songs(spark), catalog.Media("MARK", "b", "e.org", "pw", "n")
    cards = {r["id"]: r.asDict(recursive=True) for r in catalog.song_cards(t, media).collect()}
    one, two = cards["1"], cards["2"]
    assert one["releaseDate"] == "05/01/2024 07:00:00" and one["createdAt"] == "01/02/2024 03:00:00"
    assert [a["title"] for a in one["album"]] == ["A", "B"]
    assert one["album"][0]["albumImages"] == [{"image": None, "size": 32}, {"image": "https://b.e.org/MARK/c.jpg", "size": 64}]
    assert one["album"][1]["albumImages"] == []
    assert [(a["name"], a["ArtistSong"]["main"], [g["name"] for g in a["genres"]]) for a in one["artists"]] == [
        ("ann", True, ["rock", "jazz"]), ("bob", False, []),
    ]
    assert one["filePathAudio"].startswith("U2FsdGVkX1") and two["filePathAudio"] == "plain"
    assert two["album"] == [] and two["artists"] == [] and two["releaseDate"] is None and two["lyric"] == "la"
    picked = catalog.song_cards(t, media, ids=spark.createDataFrame([(2,), (2,)], "k long")).collect()
    assert [r["id"] for r in picked] == ["2"]
    artists = {r["id"]: r for r in catalog.artist_cards(t, media).collect()}
    assert artists["1"]["avatar"] == "https://b.e.org/MARK/a.jpg" and artists["2"]["genres"] == []


def test_ranked_cards_keep_the_rank(spark):
    media = catalog.Media("MARK", "b", "e.org", "pw", "n")
    top = spark.createDataFrame([(9, 1, 2, 1.0), (9, 2, 1, 0.5)], "user_id long, rank int, item_id long, score double")
    got = catalog.ranked_cards(top, catalog.song_cards(Songs(spark), media)).orderBy("rank").collect()
    assert [(r["user_id"], r["rank"], r["title"]) for r in got] == [(9, 1, "two"), (9, 2, "one")]


def test_a_job_removes_its_scratch_tables(spark, tmp_path):
    from cadenza.plans.materialize import cut, scratch_tables

    def there(path):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    kept = str(tmp_path / "result")
    with scratch_tables(spark) as made:
        cut(spark.range(5), "one").write.parquet(kept)
        with scratch_tables(spark) as inner:
            cut(spark.range(3), "two").count()
        assert len(made) == len(inner) == 1 and there(made[0]) and not there(inner[0])
    assert not there(made[0])
    assert spark.read.parquet(kept).count() == 5


def test_songs_of_few_albums_are_not_broadcast(spark):
    """What has a row per song is joined by a shuffle: else the songs are gathered, and a task per album makes their rows."""
    t = Domain(spark, "/root/testdata/sf0.001")
    media = catalog.Media(marker="M", bucket="b", endpoint="e", password="p", nonce="n")
    albums = catalog.song_albums(t.album, t.album_song, t.album_image, media)
    plan = albums._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [albumId" in plan and "BuildLeft" not in plan
    cards = catalog.song_cards(t, media, ids=t.like.select("songId"))
    assert "LeftSemi, BuildRight" not in cards._jdf.queryExecution().executedPlan().toString()
