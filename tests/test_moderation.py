"""Routing of comments, in batch and as a stream."""

import os
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import dense
from cadenza.operators import moderation as mod
from cadenza.queries.jobs import QUERIES, load_word_scorer
from cadenza.streaming import jobs as streams

REQUEST = "id long, commentParentId long, userId long, songId long, content string, createdAt timestamp_ntz"
AT = datetime(2024, 1, 1, 20, 0, 0)
ROWS = [
    (1, None, 1, 5, "nice song", AT),
    (2, 1, 1, 5, "you stupid clown", AT),  # blocked, parent exists
    (3, 99, 1, 5, "Trash! TRASH, scum", AT),  # blocked, parent does not exist
    (4, 99, 2, 5, "only one idiot here", AT),  # one word: accepted, parent kept
    (5, 1, 2, 5, None, AT),
    (6, None, 7, 5, "clownish idiotic", AT),  # no whole word
]


def requests(spark):
    return spark.createDataFrame(ROWS, REQUEST)


def existing(spark):
    return spark.createDataFrame([(1,)], "id long")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_scores(spark):
    scored = mod.score(requests(spark))
    assert by_id(scored, "toxic", "blocked") == {
        1: (0.0, False), 2: (0.9375, True), 3: (0.9375, True), 4: (0.75, False), 5: (0.0, False), 6: (0.0, False),
    }
    assert scored.where(F.size("scores") != mod.CLASSES).isEmpty()
    model = mod.score(requests(spark), mod.model_scores(load_word_scorer))
    assert by_id(model, "scores", "content") == by_id(scored, "scores", "content")


def test_threshold_is_strict(spark):
    at = mod.score(requests(spark), lambda c: F.array(*[F.lit(0.9)] * 6))
    above = mod.score(requests(spark), lambda c: F.array(*[F.lit(0.9000001)] * 6))
    assert at.where("blocked").isEmpty() and above.where("not blocked").isEmpty()


def test_parents_and_hiding(spark):
    rows = mod.moderated_comments(mod.score(requests(spark)), existing(spark))
    assert by_id(rows, "commentParentId", "hide") == {
        1: (None, False), 2: (1, True), 3: (None, True), 4: (99, False), 5: (1, False), 6: (None, False),
    }


def test_parents_among_the_requests(spark):
    """A reply may name an earlier request, by time and then id, blocked or not, but no later one and not itself."""
    later = datetime(2024, 1, 2)
    rows = [
        (1, None, 1, 5, "nice", later), (2, 1, 1, 5, "stupid clown", AT), (3, 2, 1, 5, "stupid clown", AT), (4, 5, 1, 5, "stupid clown", AT),
        (5, 1, 1, 5, "stupid clown", later), (6, 6, 1, 5, "stupid clown", AT), (7, 42, 1, 5, "stupid clown", AT), (42, None, 1, 5, "old", later),
    ]
    rows = mod.moderated_comments(mod.score(spark.createDataFrame(rows, REQUEST)), spark.createDataFrame([(42,), (42,)], "id long"))
    assert by_id(rows, "commentParentId") == {1: (None,), 2: (None,), 3: (2,), 4: (None,), 5: (1,), 6: (None,), 7: (42,), 42: (None,)}


def test_a_scorer_is_loaded_once_per_process(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")
        return load_word_scorer()

    scores = mod.model_scores(load, key="counted")
    df = requests(spark).repartition(40).persist()
    for _ in range(2):
        mod.score(df, scores).write.format("noop").mode("overwrite").save()
    df.unpersist()
    with open(loads) as f:
        found = f.read().split()
    assert len(found) == len(set(found))


def test_reports_and_outcomes(spark):
    scored = mod.score(requests(spark))
    rows = mod.reports(scored).collect()
    assert sorted(r["commentId"] for r in rows) == [2, 3]
    assert {(r["userId"], r["content"], r["status"]) for r in rows} == {(None, mod.REPORT_TEXT, "AI")}
    got = by_id(mod.outcomes(scored), "status", "message")
    assert got[2] == ("error", mod.BLOCKED_MESSAGE) and got[4] == ("success", mod.ACCEPTED_MESSAGE)


def test_accepted_cards(spark):
    users = spark.createDataFrame(
        [(1, "one", "1@x", "MARK/1.png", "User", None), (2, "two", "2@x", None, "Admin", "Two")],
        "id long, username string, email string, image string, role string, name string",
    )
    cards = mod.accepted_cards(mod.score(requests(spark)), users, "MARK", "b", "e.org")
    got = {r["id"]: r for r in cards.collect()}
    assert sorted(got) == [1, 4, 5]
    assert got[1]["user"]["image"] == "https://b.e.org/MARK/1.png" and got[4]["user"]["image"] is None
    assert got[1]["createdAt"] == "01/02/2024 03:00:00" and got[1]["myComment"] is True and got[1]["hide"] is False


def test_string_song_id_defaults_to_empty(spark):
    df = spark.createDataFrame([(None, None)], "songId string, content string")
    assert tuple(mod.with_defaults(df).first()) == ("", "")


def test_moderation_stream_in_two_batches_and_again(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(checkpoint):
        stream = spark.readStream.schema(REQUEST).parquet(source)
        streams.moderate_stream(stream, existing(spark), out, checkpoint).awaitTermination()

    def stored():
        comments = spark.read.parquet(f"{out}/comments").drop("batch_id")
        reports = spark.read.parquet(f"{out}/reports").drop("batch_id")
        return [sorted(map(str, d.collect())) for d in (comments, reports)]

    requests(spark).where("id <= 3").coalesce(1).write.mode("append").parquet(source)
    run(progress)
    requests(spark).where("id > 3").coalesce(1).write.mode("append").parquet(source)
    run(progress)
    scored = mod.score(requests(spark))
    want = [
        sorted(map(str, mod.moderated_comments(scored, existing(spark)).collect())),
        sorted(map(str, mod.reports(scored).collect())),
    ]
    assert stored() == want
    run(progress)  # nothing new
    assert stored() == want


def test_a_reply_to_a_comment_of_an_earlier_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    none = existing(spark).where("false")

    def run():
        stream = spark.readStream.schema(REQUEST).parquet(source)
        streams.moderate_stream(stream, none, out, progress).awaitTermination()
        return by_id(spark.read.parquet(f"{out}/comments"), "commentParentId")

    def add(*rows):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(source)

    add((1, None, 1, 5, "nice song", AT), (9, 8, 1, 5, "stupid clown", AT))
    assert run() == {1: (None,), 9: (None,)}
    add((2, 1, 1, 5, "stupid clown", AT), (8, None, 1, 5, "late parent", AT))
    want = {1: (None,), 9: (None,), 2: (1,), 8: (None,)}
    assert run() == want
    for n in (1, 0):  # a batch run again sees no later ones
        for name in (f"{n}", f".{n}.crc"):
            (tmp_path / "progress" / "commits" / name).unlink()
        assert run() == want


def test_compaction_counts_every_batch_once(spark, tmp_path):
    source, out, base, progress = (str(tmp_path / n) for n in ("in", "out", "base", "progress"))
    schema = "kind string, userId long, songId long"
    want = {}
    for n in range(4):
        spark.createDataFrame([("like", 1, 1), ("play", n, 2)], schema).coalesce(1).write.mode("append").parquet(source)
        streams.ratings_stream(spark.readStream.schema(schema).parquet(source), out, progress).awaitTermination()
        want[1, 1] = want.get((1, 1), 0) + 10
        want[n, 2] = want.get((n, 2), 0) + 1
        if n in (1, 2):
            streams.compact_ratings(spark, out, base, upto=n)
            streams.compact_ratings(spark, out, base, upto=n)  # again, after a failure
        got = {(r[0], r[1]): r[2] for r in streams.stored_ratings(spark, out, base).collect()}
        assert got == want


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """Losing the record of the last batch makes the stream run it again."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "kind string, userId long, songId long"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streams.ratings_stream(stream, out, progress).awaitTermination()
        return sorted(tuple(r) for r in streams.current_ratings(spark.read.parquet(out)).collect())

    spark.createDataFrame([("like", 1, 1), ("play", 1, 1), ("play", 2, 3)], schema).coalesce(1).write.parquet(source)
    assert run() == [(1, 1, 11), (2, 3, 1)]
    spark.createDataFrame([("like", 1, 1), ("like", 4, 4)], schema).coalesce(1).write.mode("append").parquet(source)
    want = [(1, 1, 21), (2, 3, 1), (4, 4, 10)]
    assert run() == want
    for name in ("1", ".1.crc"):
        (tmp_path / "progress" / "commits" / name).unlink()
    assert run() == want


def test_batches_of_like_length():
    """Scores in the order of the texts, texts cut to the window, and less padding than in the given order."""
    padded = []

    def score_tokens(lists):
        width = max(map(len, lists))
        padded.append(sum(width - len(x) for x in lists))
        return [[float(len(x)), float(sum(x))] for x in lists]

    texts = ["a" * ((i * 37) % 211) for i in range(300)]
    got = mod.in_batches(score_tokens, lambda t: [1] * len(t), max_tokens=128, rows=16)(texts)
    assert got == [[min(len(t), 128.0)] * 2 for t in texts]
    by_length, padded[:] = sum(padded), []
    for at in range(0, 300, 16):
        score_tokens([[1] * min(len(t), 128) for t in texts[at : at + 16]])
    assert by_length < sum(padded) / 5
    assert mod.in_batches(score_tokens, len)([]) == []


@pytest.mark.parametrize("stop", ["comments", "_commit"])
def test_a_report_and_its_comment_appear_together(spark, tmp_path, monkeypatch, stop):
    """A batch that stops between its outputs, or before its marker, shows neither; run again, it shows both."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    replace, commit = streams._replace, streams._commit
    broken = [True]

    def stopping(df, folder, batch_id):
        if broken[0] and stop == folder.rsplit("/", 1)[1] and batch_id == 1:
            raise RuntimeError("stopped")
        replace(df, folder, batch_id)

    def no_marker(session, folder, batch_id):
        if broken[0] and stop == "_commit" and batch_id == 1:
            raise RuntimeError("stopped")
        commit(session, folder, batch_id)

    monkeypatch.setattr(streams, "_replace", stopping)
    monkeypatch.setattr(streams, "_commit", no_marker)

    def run():
        stream = spark.readStream.schema(REQUEST).parquet(source)
        streams.moderate_stream(stream, existing(spark), out, progress).awaitTermination()

    def shown():
        comments = {r["id"] for r in streams.visible(spark, out, "comments").collect()}
        return comments, {r["commentId"] for r in streams.visible(spark, out, "reports").collect()}

    requests(spark).where("id <= 2").coalesce(1).write.mode("append").parquet(source)
    run()
    assert shown() == ({1, 2}, {2})
    requests(spark).where("id > 2").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException):
        run()
    assert shown() == ({1, 2}, {2})
    broken[0] = False
    run()
    assert shown() == ({1, 2, 3, 4, 5, 6}, {2, 3})


def test_nothing_is_visible_before_the_first_batch(spark, tmp_path):
    requests(spark).write.parquet(str(tmp_path / "comments" / "batch_id=0"))
    assert streams.visible(spark, str(tmp_path), "comments").count() == 0


def test_parents_are_reduced_before_they_are_grouped(spark):
    """Stored comments are only looked up: what is grouped by id has passed a semi join with the wanted parents."""
    scored = mod.score(requests(spark))
    plan = mod.moderated_comments(scored, existing(spark))._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [id") :] if "Aggregate [id" in plan else plan
    assert plan.count("LeftSemi") == 2 and "LeftSemi" in grouped


def test_similarity_over_batches(spark, tmp_path):
    """After each of three batches, one of them run again, as from all edges at once."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema, m = "kind string, userId long, songId long", None
    for n in range(3):
        rows = [(u, i, w) for u, i, w in dense.random_rows(n, users=12, items=9)]
        edges = [("like", u, i) for u, i, w in rows for _ in range(w // 10)] + [("play", u, i) for u, i, w in rows for _ in range(w % 10)]
        spark.createDataFrame(edges, schema).coalesce(1).write.mode("append").parquet(source)
        run = lambda: streams.similarity_stream(spark.readStream.schema(schema).parquet(source), out, progress).awaitTermination()
        run()
        if n == 1:
            for name in ("1", ".1.crc"):
                (tmp_path / "progress" / "commits" / name).unlink()
            run()
        m = dense.matrix(rows, range(18), range(9)) if m is None else m + dense.matrix(rows, range(18), range(9))
        sim = dense.cosines(m)
        want = {(u, v): sim.loc[u, v] for u in m.index for v in m.index if u != v and sim.loc[u, v] > 0}
        assert {(r[0], r[1]): r[2] for r in streams.current_similarity(spark, out).collect()} == want


@pytest.mark.parametrize("name", ["stream_moderation", "stream_reports"])
@pytest.mark.parametrize("files", [0, 3])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, name, files):
    rows = [(i, "you stupid clown" if i % 2 else "nice song") for i in range(1, 13)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    if files:
        documents.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        documents.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    events = "event_id long, user_id long, props string, ts timestamp_ntz"
    spark.createDataFrame([(i, 1, '{"k": 5}', AT) for i, _ in rows], events).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    hidden = {i for i, _ in rows if i % 2}
    if name == "stream_moderation":
        assert {r["id"]: r["hide"] for r in out.collect()} == {i: i in hidden for i, _ in rows}
    else:
        assert sorted(r["commentId"] for r in out.collect()) == sorted(hidden)
