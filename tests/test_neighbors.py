"""Similarity and neighbours against dense matrices, in particular with hot items."""

import time

import pytest
from pyspark.sql import functions as F

import dense
from cadenza.operators import neighbors, pairs, similarity
from cadenza.plans.materialize import cut

SCHEMA = "user_id long, item_id long, w long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def everybody(spark, n):
    return spark.range(n).select(F.col("id").alias("user_id"))


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("part_raters", [1000, 3])
def test_similarity(spark, seed, part_raters):
    rows = dense.random_rows(seed)
    m = dense.matrix(rows, range(46), range(30))
    sim = dense.cosines(m)
    want = sorted((u, v, sim.loc[u, v]) for u in m.index for v in m.index if u != v and sim.loc[u, v] > 0)
    got = sorted_rows(similarity.similarity(frame(spark, rows), part_raters))
    assert got == want
    assert all(0 < c <= 1 + 1e-12 for _, _, c in got)


@pytest.mark.parametrize("seed", range(3))
def test_neighbors_plain(spark, seed):
    rows = dense.random_rows(seed)
    m = dense.matrix(rows, range(46), range(30))
    got = sorted_rows(neighbors.top_neighbors(frame(spark, rows), everybody(spark, 46)))
    assert got == sorted(dense.neighbors(m))


@pytest.mark.parametrize(
    "seed,listed_raters,block_items,block_rows,popular",
    [(0, 8, 100, 2048, 0.4), (1, 8, 100, 4, 0.4), (2, 3, 100, 3, 0.4), (3, 3, 2, 5, 0.9), (4, 0, 100, 7, 0.6), (5, 10, 1, 2, 0.8)],
)
def test_neighbors_with_hot_items(spark, monkeypatch, seed, listed_raters, block_items, block_rows, popular):
    monkeypatch.setattr(neighbors, "BLOCK_ITEMS", block_items)
    rows = dense.random_rows(seed, popular=popular, per_user=3)
    m = dense.matrix(rows, range(46), range(30))
    got = neighbors.top_neighbors(
        frame(spark, rows), everybody(spark, 46), listed_raters=listed_raters, block_rows=block_rows
    )
    assert sorted_rows(got) == sorted(dense.neighbors(m))


def test_only_hot_items(spark):
    """A third of the users hold one item and nothing else; the others one item besides it."""
    rows = [(u, 0, 10) for u in range(30)] + [(u, 1 + u % 7, 1) for u in range(10, 30)]
    m = dense.matrix(rows, range(30), range(8))
    got = neighbors.top_neighbors(frame(spark, rows), everybody(spark, 30), listed_raters=2, block_rows=3)
    assert sorted_rows(got) == sorted(dense.neighbors(m))


def test_user_with_many_items_is_split(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART_ITEMS", 2)
    rows = dense.random_rows(7, per_user=8)
    m = dense.matrix(rows, range(46), range(30))
    got = neighbors.top_neighbors(frame(spark, rows), everybody(spark, 46))
    assert sorted_rows(got) == sorted(dense.neighbors(m))


def test_given_users(spark):
    rows = dense.random_rows(1)
    m = dense.matrix(rows, range(46), range(30))
    got = neighbors.top_neighbors(frame(spark, rows), everybody(spark, 46), user_ids=[5, 20])
    assert sorted_rows(got) == sorted(r for r in dense.neighbors(m) if r[0] in (5, 20))


def test_string_ids(spark):
    rows = dense.random_rows(2)
    text = [(f"u{u:02}", f"i{i:02}", w) for u, i, w in rows]
    df = spark.createDataFrame(text, "user_id string, item_id string, w long")
    users = everybody(spark, 46).select(F.format_string("u%02d", "user_id").alias("user_id"))
    want = sorted((f"u{u:02}", r, f"u{v:02}", c) for u, r, v, c in dense.neighbors(dense.matrix(rows, range(46), range(30))))
    assert sorted_rows(neighbors.top_neighbors(df, users)) == want
    assert sorted_rows(neighbors.top_neighbors(df, users, listed_raters=5, block_rows=4)) == want


def test_few_users_and_cold_users(spark):
    few = neighbors.top_neighbors(frame(spark, [(0, 0, 10)]), everybody(spark, 3))
    assert sorted_rows(few) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0)]
    cold = neighbors.top_neighbors(frame(spark, []), everybody(spark, 7))
    assert [r for r in sorted_rows(cold) if r[0] == 6] == [(6, i + 1, i, 0.0) for i in range(5)]


@pytest.mark.parametrize("seed", range(8, 12))
def test_most_popular_items_need_no_probe(spark, seed):
    """Rare items give most users partners good enough to skip the most popular hot items."""
    rows = dense.random_rows(seed, users=60, items=12, per_user=5, popular=0.7)
    m = dense.matrix(rows, range(66), range(12))
    got = neighbors.top_neighbors(frame(spark, rows), everybody(spark, 66), k=3, listed_raters=6, block_rows=8)
    assert sorted_rows(got) == sorted(dense.neighbors(m, 3))


def test_probes(spark):
    """Popular items are left out exactly when the rest of the row cannot reach the floor."""
    hot = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "item_id long, raters long")
    askers = spark.createDataFrame(
        [(0, 100, [1, 2, 3], [6, 6, 5], 0.0), (1, 100, [1, 2, 3], [6, 6, 5], 0.55), (2, 100, [1, 2, 3], [6, 6, 5], 0.9)],
        "row_id long, n long, items array<long>, weights array<long>, floor double",
    )
    got = sorted_rows(neighbors._probes(askers, hot))
    shares = [(72 + 25) ** 0.5 / 10, (36 + 25) ** 0.5 / 10, 0.5]
    assert [r[:2] for r in got] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 1)]
    # the level of the least share of a partner with which the floor can be reached
    want = [0, 0, 0] + [int(0.55 / s * neighbors.LEVELS) for s in shares[:2]] + [int(0.9 / shares[0] * neighbors.LEVELS)]
    assert [r[2] for r in got] == want


@pytest.mark.parametrize("levels", [1, 3, 50])
def test_levels_of_shares(spark, monkeypatch, levels):
    """However fine the index, the same neighbours; dominated and balanced rows under two popular items."""
    monkeypatch.setattr(neighbors, "LEVELS", levels)
    rows = [(u, 0, 1 + u % 5) for u in range(40)] + [(u, 1, 1 + u % 3) for u in range(0, 40, 2)] + [(u, 2 + u % 9, 1 + u % 7) for u in range(0, 40, 3)]
    m = dense.matrix(rows, range(42), range(11))
    got = neighbors.top_neighbors(frame(spark, rows), everybody(spark, 42), listed_raters=6, block_rows=5)
    assert sorted_rows(got) == sorted(dense.neighbors(m))


@pytest.mark.parametrize("seed,floor,part_raters", [(0, 0.3, 1000), (1, 0.5, 3), (2, 0.7, 5), (3, 0.95, 2), (4, 1.0, 1000), (5, 0.01, 4)])
def test_similar_users(spark, seed, floor, part_raters):
    rows = dense.random_rows(seed, per_user=6, popular=0.7)
    m = dense.matrix(rows, range(46), range(30))
    sim = dense.cosines(m)
    got = sorted_rows(similarity.similar_users(frame(spark, rows), floor, part_raters))
    assert got == sorted((u, v, sim.loc[u, v]) for u in m.index for v in m.index if u != v and sim.loc[u, v] >= floor)
    assert got


def test_similar_users_odd_rows(spark):
    one = frame(spark, [(0, 0, 1), (1, 0, 7), (2, 1, 1)])
    assert sorted_rows(similarity.similar_users(one, 1.0)) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert sorted_rows(similarity.similar_users(frame(spark, []), 0.5)) == []
    with pytest.raises(ValueError):
        similarity.similar_users(one, 0.0)


def test_bounds_come_before_pairs(spark):
    """All users share one item that is a small part of their rows: no pair is made of it, where all pairs would be n^2."""
    rows = [(u, 0, 1) for u in range(300)] + [(u, 1 + u // 2 * 3 + i, 3) for u in range(300) for i in range(3)]
    candidates = similarity.candidate_pairs(frame(spark, rows), 0.5)
    assert candidates.count() == 150
    assert similarity.similar_users(frame(spark, rows), 0.5).count() == 300


@pytest.mark.parametrize("seed", range(2))
def test_pair_changes(spark, seed):
    """Changes of dot products and lengths add up to those of the sum of the weights."""
    old, new = dense.random_rows(seed, per_user=5), dense.random_rows(seed + 50, users=20, per_user=3)
    before, after = dense.matrix(old, range(46), range(30)), dense.matrix(old + new, range(46), range(30))
    want = after.to_numpy() @ after.to_numpy().T - before.to_numpy() @ before.to_numpy().T
    got = similarity.pair_changes(frame(spark, old), frame(spark, new)).collect()
    assert {(r[0], r[1]): r[2] for r in got if r[2]} == {(u, v): want[u, v] for u in range(46) for v in range(46) if u != v and want[u, v]}
    norms = similarity.norm_changes(frame(spark, old), frame(spark, new)).collect()
    assert {r[0]: r[1] for r in norms} == {u: want[u, u] for u in range(46) if want[u, u]}


@pytest.mark.parametrize("entries", [1, 40, 10**6])
def test_pairs_are_summed_a_few_users_at_a_time(spark, entries, monkeypatch):
    rows = dense.random_rows(3, per_user=6, popular=0.7)
    m = dense.matrix(rows, range(46), range(30)).to_numpy()
    rated = similarity.with_norms(frame(spark, rows))
    table = similarity._placed(rated, ["n"], ["n"], 4, half=True).repartition(1, "user_id").sortWithinPartitions("user_id", "part").toArrow()
    monkeypatch.setattr(pairs, "ENTRIES", entries)
    batches = pairs.per_pair(["n"], [], pairs.all_pairs)(iter(table.to_batches(max_chunksize=5)))
    got = [r for b in batches for r in b.to_pylist()]
    want = m @ m.T
    assert {(r["user_id"], r["other_id"]): r["dot"] for r in got} == {(u, v): want[u, v] for u in range(46) for v in range(u + 1, 46) if want[u, v]}
    assert len(got) == len({(r["user_id"], r["other_id"]) for r in got})


def test_short_rows_are_not_looked_up_again(spark):
    """Where all items of both rows are listed, the candidates' products are exact."""
    rows = [(u, u // 4 * 2 + i, 1) for u in range(40) for i in range(3)]
    candidates = similarity.candidate_pairs(frame(spark, rows), 0.2)
    assert not candidates.isEmpty() and candidates.where("open").isEmpty()


def test_tables_of_a_row_per_user_are_not_broadcast(spark):
    rows = frame(spark, dense.random_rows(1, per_user=5))
    near = spark.createDataFrame([(0, 1, 2, 0.5)], "user_id long, rank int, other_id long, cos double")
    users = everybody(spark, 40)
    for df in (similarity.with_norms(rows), neighbors.fill_up(near, users, users, 2)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_neighbors_of_given_users_are_cut_where_pairs_are_made(spark, monkeypatch):
    """Only the first k pairs of a user and part leave the task that sums them, with item lists in parts."""
    rows = dense.random_rows(5, per_user=6, popular=0.7)
    monkeypatch.setattr(similarity, "PART_RATERS", 4)
    near = similarity.nearest_of(frame(spark, rows), [3, 4], 2)
    assert near.count() == 4
    whole = similarity.similarity_of(frame(spark, rows), [3, 4])
    assert sorted_rows(neighbors.nearest(near, 2)) == sorted_rows(neighbors.nearest(whole, 2))


@pytest.mark.parametrize("ids", [lambda u: f"u{99 - u}", lambda u: (u - 20) * 2**57, lambda u: u - 20])
def test_nearest_of_users_with_any_ids(spark, ids):
    """Sums and ranks go by the ids, be they texts or numbers far apart."""
    rows = dense.random_rows(2, per_user=6, popular=0.5)
    plain = neighbors._nearest_of_all(frame(spark, rows), 50, 1000, 8).select("user_id", "other_id", "cos")
    kind = "string" if isinstance(ids(0), str) else "long"
    named = spark.createDataFrame([(ids(u), i, w) for u, i, w in rows], f"user_id {kind}, item_id long, w long")
    got = neighbors._nearest_of_all(named, 50, 1000, 8).select("user_id", "other_id", "cos")
    assert sorted_rows(got) == sorted((ids(u), ids(v), c) for u, v, c in plain.collect())
    top = neighbors._nearest_of_all(named, 3, 1000, 8).collect()
    ranked = {}
    for u, v, c in sorted(got.collect(), key=lambda r: (r[0], -r[2], r[1])):
        ranked.setdefault(u, []).append(v)
    assert {(r["user_id"], r["rank"]): r["other_id"] for r in top} == {(u, i + 1): v for u, vs in ranked.items() for i, v in enumerate(vs[:3])}


def test_partitions_grow_with_the_pairs(spark, monkeypatch):
    rated = similarity.with_norms(frame(spark, dense.random_rows(1, per_user=6)))
    monkeypatch.setattr(similarity, "PARTITION_ENTRIES", 50)
    r = rated.groupBy("item_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert similarity._placed(rated, ["n"], ["n"], None).rdd.getNumPartitions() == -(-r // 50) > 4


def test_levels_of_small_items_are_not_told_apart(spark, monkeypatch):
    """An asker is sent once to an item whose askers and rows fit into one block."""
    sent = []
    blocks = neighbors._blocks

    def counted(rows, opposite, block_rows):
        sent.append(rows.groupBy("row_id", "item_id").count().agg(F.max("count")).first()[0])
        return blocks(rows, opposite, block_rows)

    monkeypatch.setattr(neighbors, "_blocks", counted)
    rows = frame(spark, dense.random_rows(4, per_user=6, popular=0.5))
    small = sorted_rows(neighbors.top_neighbors(rows, everybody(spark, 46), listed_raters=5))
    assert sent == [1, 1]
    assert sorted_rows(neighbors.top_neighbors(rows, everybody(spark, 46), listed_raters=5, block_rows=2)) == small
    assert sent[2] > 1


@pytest.mark.parametrize("part_raters", [1000, 3])
@pytest.mark.parametrize("name", [int, "u{:03}".format, lambda u: u - 20])
def test_users_in_parts_with_packed_lists(spark, monkeypatch, name, part_raters):
    """Users of more than two items are split into parts by partner, of items in pieces too, whatever their ids are."""
    monkeypatch.setattr(similarity, "PART_ITEMS", 2)
    rows = dense.random_rows(7, per_user=6, popular=0.6)
    sim = dense.cosines(dense.matrix(rows, range(46), range(30)))
    kind = "string" if isinstance(name(0), str) else "long"
    df = spark.createDataFrame([(name(u), i, w) for u, i, w in rows], f"user_id {kind}, item_id long, w long")
    want = sorted((name(u), name(v), sim.loc[u, v]) for u in range(46) for v in range(46) if u != v and sim.loc[u, v] > 0)
    assert sorted_rows(similarity.similarity(df, part_raters)) == want


def test_lists_are_packed(spark):
    """A list takes the bytes of its largest value for each of them, with half of it only what comes after the member's own."""
    rows = [(u, 0, 1 + u) for u in range(300)]
    placed = similarity._placed(similarity.with_norms(frame(spark, rows)), ["n"], ["n"], None, half=True)
    sizes = placed.select("user_id", "raters", *[F.octet_length(c).alias(c) for c in ("other_id", "w_other", "n_other")]).collect()
    assert sorted(tuple(r) for r in sizes) == [(u, n, 2 * n, 2 * n, 3 * n) for u in range(299) for n in [299 - u]]


def test_pairs_are_summed_in_rounds(spark, monkeypatch):
    """Many pairs are shuffled some users at a time, with the same result."""
    written, write = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(similarity, "LEAST_ROUND", 60)
    monkeypatch.setattr(similarity, "ROUND_ENTRIES", 2)
    rows = dense.random_rows(4, per_user=5, popular=0.3)
    m = dense.matrix(rows, range(46), range(30))
    assert sorted_rows(neighbors.top_neighbors(frame(spark, rows), everybody(spark, 46))) == sorted(dense.neighbors(m))
    assert written.count("round") > 2
    sim = dense.cosines(m)
    got = sorted_rows(similarity.similar_users(frame(spark, rows), 0.3, 4))
    assert got == sorted((u, v, sim.loc[u, v]) for u in m.index for v in m.index if u != v and sim.loc[u, v] >= 0.3)


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = shuffles(), spark.conf.get(setting)
    cut(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == kept
