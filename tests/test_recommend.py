"""Ratings and recommendations against dense matrices and hand-made cases."""

import pytest
from pyspark.sql import functions as F

import dense
from cadenza.operators import matrix, ratings, recommend
from cadenza.operators.listing import require_known, unknown_ids
from cadenza.plans import recommenders as plans
from cadenza.sources.tables import read_triangle, write_triangle

EDGE = "userId long, songId long"


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def ids(spark, n):
    return spark.range(n)


@pytest.fixture
def interactions(spark):
    rows = dense.random_rows(3, users=20, items=15)
    likes = [(u, i) for u, i, w in rows for _ in range(w // 10)]
    plays = [(u, i) for u, i, w in rows for _ in range(w % 10)]
    return rows, spark.createDataFrame(likes, EDGE), spark.createDataFrame(plays, EDGE)


def test_combined_weights(spark):
    likes = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], EDGE)
    plays = spark.createDataFrame([(1, 1)] * 3 + [(3, 2)], EDGE)
    assert sorted_rows(ratings.combined_ratings(likes, plays)) == [(1, 1, 13), (2, 1, 20), (3, 2, 1)]
    assert sorted_rows(ratings.binary_ratings(likes, "songId")) == [(1, 1, 1), (2, 1, 1)]
    assert sorted_rows(ratings.duplicates(ratings.edges(likes, "songId"))) == [(2, 1, 2)]


def test_play_counts_equal_the_joined_form(spark):
    plays = spark.createDataFrame([(1, 1), (1, 1), (2, 9)], EDGE)
    songs = spark.createDataFrame([(1,), (2,)], "id long")
    joined = plays.join(songs, plays.songId == songs.id, "left").groupBy("userId", "songId").agg(F.count("songId"))
    assert sorted_rows(ratings.play_counts(plays)) == sorted_rows(joined)


def test_orphans_and_known_only(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 9, 5), (8, 1, 5)], "user_id long, item_id long, w long")
    users, items = spark.range(3), spark.range(3)
    assert sorted_rows(ratings.known_only(df, users, items).select("user_id", "item_id", "w")) == [(1, 1, 5)]
    assert sorted_rows(ratings.orphans(df, users, items)) == [(1, 9, False, True), (8, 1, True, False)]


def test_wide_matrix(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 3, 4)], "user_id long, item_id long, w long")
    users, items = spark.range(1, 4), spark.range(1, 4)
    wide = ratings.wide_matrix(df, users, items, prefix="s")
    assert wide.columns == ["user_id", "s1", "s2", "s3"]
    assert sorted_rows(wide) == [(1, 5, 0, 0), (2, 0, 0, 4), (3, 0, 0, 0)]


def test_matrix_in_blocks(spark, tmp_path):
    """2,500 items in blocks of 400 columns, written as CSV and read back."""
    rows = [(u, (u * 997 + i * 131) % 2500, u + i + 1) for u in range(6) for i in range(40)]
    users, items = spark.range(8), spark.range(2500)
    blocks, index = matrix.wide_blocks(spark.createDataFrame(rows, "user_id long, item_id long, w long"), users, items, 400)
    assert index.count() == 2500 and blocks.count() == 8 * 7
    assert blocks.columns == ["user_id", "block", *[f"c{i}" for i in range(400)]]
    assert blocks.where(" OR ".join(f"c{i} IS NULL" for i in range(400))).count() == 0
    matrix.write_blocks(blocks, index, str(tmp_path))
    assert sorted_rows(matrix.read_blocks(spark, str(tmp_path), columns=400)) == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "blocks").glob("block=*")) == [f"block={i}" for i in range(7)]


def test_matrix_blocks_made_wide_last(spark, tmp_path, monkeypatch):
    """Rows are dealt out and sorted while they hold their cells only; a piece writes to few blocks."""
    monkeypatch.setattr(matrix, "PIECE_CELLS", 100)
    rows = [(u, (u * 7 + i) % 30, u + i + 1) for u in range(20) for i in range(3)]
    df = spark.createDataFrame([*rows, *rows, (3, 29, None)], "user_id long, item_id long, w long")
    blocks, index = matrix.wide_blocks(df, spark.range(20), spark.range(30), 5)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan and plan.index("Sort [block") > plan.index("AS c4")
    matrix.write_blocks(blocks, index, str(tmp_path))
    assert sorted_rows(matrix.read_blocks(spark, str(tmp_path), columns=5)) == sorted((u, i, 2 * w) for u, i, w in rows)
    assert len(list((tmp_path / "blocks").glob("block=*/*.csv"))) <= 6 + 6


def test_matrix_lines_are_those_of_the_wide_rows(spark, tmp_path):
    """Lines put together from sparse rows are the same text as the wide rows written cell by cell, and both are read."""
    odd = ["a,b", 'c"d', " e ", "f", "7", "", "'", "g\\h"]
    rows = [(u, i, w) for u in odd[:6] for i, w in ((0, 5), (3, -12), (4, 100), (11, 0), (12, 7))]
    df = spark.createDataFrame([*rows, (None, 2, 9), ("f", 5, None)], "user_id string, item_id long, w long")
    users = spark.createDataFrame([(u,) for u in [*odd, None]], "id string")
    blocks, index = matrix.wide_blocks(df, users, spark.range(13), 5)
    matrix.write_blocks(blocks, index, str(tmp_path / "lines"))
    matrix.write_blocks(blocks.select("*"), index, str(tmp_path / "cells"))

    def text(name):
        return sorted((f.parent.name, line) for f in (tmp_path / name / "blocks").glob("block=*/*.csv") for line in f.read_text().splitlines()[1:])

    assert text("lines") == text("cells") and len(text("lines")) == 9 * 3
    assert {f.read_text().splitlines()[0] for f in (tmp_path / "lines/blocks").glob("*/*.csv")} == {"user_id,c0,c1,c2,c3,c4"}
    names = [f"c{i}" for i in range(5)]
    csv = spark.read.schema("user_id string, " + ", ".join(f"{c} long" for c in names) + ", block int").option("header", True).csv(str(tmp_path / "cells/blocks"))
    cells = csv.select("user_id", "block", F.posexplode(F.array(*names)).alias("place", "w")).where("w <> 0")
    want = sorted_rows(cells.join(index, ["block", "place"]).select(F.coalesce("user_id", F.lit("-")), "item_id", "w"))
    for name in ("lines", "cells"):
        got = matrix.read_blocks(spark, str(tmp_path / name), "string", columns=5)
        assert sorted_rows(got.select(F.coalesce("user_id", F.lit("-")), "item_id", "w")) == want
    assert len(want) == 24


def test_blocks_are_not_read_cell_by_cell(spark, tmp_path):
    """No row of as many values as a block has columns is made on reading."""
    df = spark.createDataFrame([(1, 2, 3)], "user_id long, item_id long, w long")
    matrix.write_blocks(*matrix.wide_blocks(df, spark.range(4), spark.range(9), 5), str(tmp_path))
    found = matrix.read_blocks(spark, str(tmp_path), columns=5)
    assert "c4#" not in found._jdf.queryExecution().toString() and [tuple(r) for r in found.collect()] == [(1, 2, 3)]


@pytest.mark.parametrize("most", [10**5, 3])
def test_offers_of_short_lists_are_not_broadcast(spark, monkeypatch, most):
    """The exploded offers of all short lists meet the few lowest items, which alone may be broadcast, if they are few."""
    monkeypatch.setattr(recommend, "BROADCAST_ITEMS", most)
    head = spark.createDataFrame([(0, 1, 5, 9)], "user_id long, rank int, item_id long, w long")
    mine = spark.createDataFrame([(u, u % 7, 1) for u in range(50)], "user_id long, item_id long, w long")
    users, items = spark.range(50).select(F.col("id").alias("user_id")), spark.range(200).select(F.col("id").alias("item_id"))
    page = recommend.fill_page(head, mine, users, items, 1, 4)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "HashJoin [position" in line and "BuildLeft" in line] == []
    assert ("BroadcastHashJoin [position" in plan) == (most > 3)
    got = {}
    for u, _, i, _ in sorted(tuple(r) for r in page.collect()):
        got.setdefault(u, []).append(i)
    assert got == {u: ([5] if u == 0 else []) + [i for i in range(9) if i != u % 7 and not (u == 0 and i == 5)][: 3 if u == 0 else 4] for u in range(50)}


def test_ratings_are_not_broadcast_to_sets_of_neighbours(spark):
    near = spark.createDataFrame([(0, 1, 1, 0.0), (1, 1, 0, 0.0), (2, 1, 0, 0.5)], "user_id long, rank int, other_id long, cos double")
    rows = spark.createDataFrame([(0, 7, 3), (0, 8, 4), (2, 8, 1)], "user_id long, item_id long, w long")
    found = recommend.recommend(near, rows, 1, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # but for the neighbours of very many, a row each, which are joined by a left join
    assert [x for x in plan.splitlines() if "BroadcastHashJoin [other_id" in x and "LeftOuter" not in x] == []
    assert sorted_rows(found) == [(1, 1, 8, 4), (1, 2, 7, 3), (2, 1, 7, 3)]


def test_triangle_export(spark, tmp_path):
    rows = [(u, v, 1 / (u + v + 3)) for u in range(12) for v in range(12) if u != v]
    df = spark.createDataFrame(rows, "user_id long, other_id long, cos double")
    write_triangle(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == len(rows) // 2
    assert sorted_rows(read_triangle(spark, str(tmp_path / "t"))) == sorted(rows)


@pytest.mark.parametrize("lane_users", [1, 7, 1000])
def test_neighbour_of_half_the_users(spark, lane_users):
    """One neighbour that half the users have and some with one each: rows as without lanes, none in a large lane."""
    near = [(u, 0) for u in range(1, 200)] + [(u, u % 10) for u in range(200, 400)]
    rows = [(o, i, o + i + 1) for o in range(10) for i in range(o + 1)]
    found = recommend.neighbor_rows(
        spark.createDataFrame(near, "user_id long, other_id long"), spark.createDataFrame(rows, "user_id long, item_id long, w long"), lane_users=lane_users
    )
    got = sorted(tuple(r) for r in found.select("user_id", "other_id", "item_id", "w").collect())
    assert got == sorted((u, o, i, w) for u, o in near for x, i, w in rows if x == o)
    if lane_users == 7:
        lanes = found.where("other_id = 0 AND item_id = 0").groupBy("lane").count().collect()
        assert len(lanes) > 20 and max(r["count"] for r in lanes) < 25


def test_defects(spark):
    df = spark.createDataFrame([(1, 1), (1, 9), (8, 1), (8, 9), (1, 9)], "user_id long, item_id long")
    assert sorted_rows(ratings.defects(df, spark.range(3), spark.range(3))) == [(5, 2, 3)]


def test_unknown_users_and_songs_take_no_part(spark):
    """Unknown user 9 is no neighbour, unknown songs 50 and 99 are not recommended."""
    edges = [(u, s) for u in range(1, 8) for s in range(1, 8) if (u + s) % 3] + [(9, s) for s in range(1, 8)] + [(1, 50), (9, 99), (2, 99)]
    likes = spark.createDataFrame(edges, "userId long, songId long")
    users, songs = spark.range(1, 8), spark.range(1, 8)
    known = spark.createDataFrame([e for e in edges if e[0] < 8 and e[1] < 8], likes.schema)
    none = likes.where("false")
    got = sorted_rows(plans.recommend_songs(likes, none, users, songs))
    assert got == sorted_rows(plans.recommend_songs(known, none, users, songs))
    assert {r[2] for r in got} <= set(range(1, 8))
    follow = likes.withColumnRenamed("songId", "artistId")
    got = sorted_rows(plans.recommend_artists(follow, users, songs))
    assert got == sorted_rows(plans.recommend_artists(known.withColumnRenamed("songId", "artistId"), users, songs))


@pytest.mark.parametrize("page", [1, 2, 5])
def test_pages_equal_dense(spark, interactions, page):
    """Page 5 lies past the end of most lists."""
    rows, likes, plays = interactions
    m = dense.matrix(rows, range(26), range(15))
    got = plans.recommend_songs(likes, plays, ids(spark, 26), ids(spark, 15), page=page, page_size=4)
    want = sorted((u, r, i, w / 10) for u, r, i, w in dense.pages(m, page * 4 - 3, page * 4))
    assert sorted_rows(got) == want


def test_given_users_equal_all_users(spark, interactions):
    _, likes, plays = interactions
    args = likes, plays, ids(spark, 26), ids(spark, 15)
    some = plans.recommend_songs(*args, user_ids=[5, 10])
    assert sorted_rows(some) == [r for r in sorted_rows(plans.recommend_songs(*args)) if r[0] in (5, 10)]


def test_whole_catalog(spark, interactions):
    rows, likes, plays = interactions
    m = dense.matrix(rows, range(26), range(15))
    r = ratings.combined_ratings(likes, plays)
    near = plans.top_neighbors(r, plans.universe(ids(spark, 26)), user_ids=[3, 10])
    got = recommend.recommend_from_catalog(near, r, [3, 10], plans.item_ids(ids(spark, 15)))
    assert sorted_rows(got) == sorted(r for r in dense.pages(m, 1, 99) if r[0] in (3, 10))


def test_nothing_seen_before(spark, interactions):
    rows, likes, plays = interactions
    seen = {(u, i) for u, i, _ in rows}
    got = plans.recommend_songs(likes, plays, ids(spark, 26), ids(spark, 15))
    assert not seen & {(u, i) for u, _, i, _ in sorted_rows(got)}


def test_ties_go_to_the_lower_item(spark):
    rows = [(0, 0), (1, 0), (1, 5), (1, 3)]
    got = plans.recommend_from_likes(spark.createDataFrame(rows, EDGE))
    assert [r for r in sorted_rows(got) if r[0] == 0] == [(0, 1, 3, 1.0), (0, 2, 5, 1.0)]


def test_artists_with_users_near_nobody(spark):
    follows = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 2), (2, 1), (9, 3)], "userId long, artistId long")
    rows = [(0, 0, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1), (9, 3, 1)]
    m = dense.matrix(rows, range(12), range(30))
    got = plans.recommend_artists(follows, ids(spark, 12), ids(spark, 30))
    assert sorted_rows(got) == sorted(dense.pages(m, 1, 10))


def test_report(spark):
    likes = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 2)], EDGE)
    plays = spark.createDataFrame([(0, 0), (1, 0), (3, 4)], EDGE)
    got = {r["user_id"]: r for r in plans.recommend_report(likes, plays).collect()}
    assert got[0]["similar_users"] == [1, 2] and got[0]["recommended_songs"] == [1, 2]
    assert got[0]["similar_play_users"] == [1, 3] and got[0]["recommendations_play"] == [4]
    assert got[2]["error"] == got[3]["error"] == "unknown user" and got[2]["similar_users"] is None


def test_bad_arguments(spark, interactions):
    _, likes, plays = interactions
    with pytest.raises(ValueError, match="unknown user: 77"):
        plans.recommend_songs(likes, plays, ids(spark, 26), ids(spark, 15), user_ids=[1, 77])
    with pytest.raises(ValueError, match="start at 1"):
        plans.recommend_songs(likes, plays, ids(spark, 26), ids(spark, 15), page=0)
    with pytest.raises(ValueError, match="unknown id: 30"):
        require_known(30, ids(spark, 26))
    assert sorted_rows(unknown_ids(spark.createDataFrame([(1,), (40,)], "id long"), ids(spark, 26))) == [(40,)]


def test_no_interactions(spark):
    empty = spark.createDataFrame([], EDGE)
    got = plans.recommend_songs(empty, empty, ids(spark, 3), ids(spark, 4), page_size=2)
    assert sorted_rows(got) == [(u, r, r - 1, 0.0) for u in range(3) for r in (1, 2)]


def test_tasks_grow_with_the_neighbors_rows(spark, monkeypatch):
    """A join that makes many rows of small ones has as many tasks as these need, and the same rows."""
    r = spark.createDataFrame([(u, i, 1) for u in range(20) for i in range(10)], "user_id long, item_id long, w long")
    near = spark.createDataFrame([(u, (u + d) % 20) for u in range(20) for d in (1, 2)], "user_id long, other_id long")
    want = sorted_rows(recommend.neighbor_rows(near, r))
    monkeypatch.setattr(recommend, "JOINED_ROWS", 20)
    got = recommend.neighbor_rows(near, r)
    assert got.rdd.getNumPartitions() == 20
    assert sorted_rows(got) == want and len(want) == 400
