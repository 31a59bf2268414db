"""The registered queries: each takes (spark, folder of test tables) and gives a DataFrame.

Nested results are flattened to text here so that any engine can compare them; the library
functions behind them return nested records.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import columns as fc
from cadenza.operators import catalog, integrity, listing, matrix, moderation, neighbors, ratings, recommend, similarity
from cadenza.plans import recommenders
from cadenza.plans.materialize import cut, scratch_path
from cadenza.sources.tables import read_triangle, write_csv, write_json, write_triangle
from cadenza.sources.testdata import MARKER, Domain, comment_request, event_edges
from cadenza.streaming import jobs as streams

MEDIA = catalog.Media(marker=MARKER, bucket="media", endpoint="objects.example.org", password="not a secret", nonce="run-1")
ONE_USER = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Domain(spark, folder))
    return f


def joined(items, fmt) -> F.Column:
    """An array as text: each element through ``fmt``, sorted, separated by bars."""
    return F.array_join(F.array_sort(F.transform(items, fmt)), "|")


# ---- listings


@query
def user_listing(t):
    return listing.user_listing(t.user)


@query
def song_listing(t):
    return listing.song_listing(t.song)


@query
def comment_listing(t):
    scored = cut(moderation.score(t.comment_request), "scored")
    rows = listing.comment_listing(moderation.moderated_comments(scored, t.existing_comment))
    return rows.withColumn("commentParentId", F.col("commentParentId").cast("string"))


@query
def point_lookup(t):
    """Who wrote each comment, asked for by comment id taken as user id: some do not exist."""
    asked = t.read("documents").select("doc_id").unionAll(t.read("events").select("event_id"))
    return listing.lookup(t.user.select("id", "username"), asked)


@query
def song_filter_order(t):
    return listing.select_rows(t.song, {"privacy": True, "duration": 10}, order="title").select("id", "title", "duration")


@query
def song_group_counts(t):
    counts = [F.count("*").alias("songs"), F.min("duration").alias("shortest"), F.max("duration").alias("longest")]
    return listing.select_rows(t.song, {"privacy": False}, group="title", aggregates=counts)


# ---- edges and ratings


@query
def like_edges(t):
    return ratings.edges(t.like, "songId").select("user_id", F.col("item_id").alias("song_id"), F.lit(1).alias("like"))


@query
def play_counts(t):
    return ratings.play_counts(t.play)


@query
def follow_edges(t):
    return ratings.binary_ratings(t.follow, "artistId").withColumnRenamed("item_id", "artist_id")


@query
def combined_ratings(t):
    rows = ratings.known_only(ratings.combined_ratings(t.like, t.play), t.user, t.song)
    return rows.select("user_id", "item_id", "w", (F.col("w") / ratings.LIKE_TENTHS).alias("score"))


@query
def orphan_interactions(t):
    """Likes, plays and follows by kind of defect, the sound ones included."""

    def summary(kind, edge, items):
        return ratings.defects(edge, t.user, items).select(F.lit(kind).alias("kind"), "*")

    return (
        summary("like", ratings.edges(t.like, "songId"), t.song)
        .unionAll(summary("play", ratings.edges(t.play, "songId"), t.song))
        .unionAll(summary("follow", ratings.edges(t.follow, "artistId"), t.artist))
        .unionAll(summary("event", ratings.edges(t.event_as_song, "songId"), t.song))
        .unionAll(summary("buyer", ratings.edges(t.event_as_user, "songId"), t.song))
    )


@query
def duplicate_edges(t):
    return ratings.duplicates(ratings.edges(t.like, "songId"))


@query
def fk_integrity(t):
    return integrity.fk_integrity(t.tables() | {"Comment": t.comment_request, "Report": _reports(t)})


@query
def unknown_users(t):
    """Users that the likes-only recommender does not know."""
    return listing.unknown_ids(t.user.select(F.col("id").alias("user_id")), t.like.select("userId"))


@query
def rating_matrix_wide(t):
    """Users x albums: the weight of each user's likes and plays of an album's songs."""
    by_song = ratings.combined_ratings(t.like, t.play)
    album = t.album_song.select(F.col("songId").alias("item_id"), "albumId")
    by_album = by_song.join(album, "item_id").select("user_id", F.col("albumId").alias("item_id"), "w")
    wide = ratings.wide_matrix(by_album, t.user, t.album.select(F.col("albumId").alias("id")))
    return wide.withColumnsRenamed({a: a.replace("Brand#", "album_") for a in wide.columns})


@query
def export_rating_matrix(t):
    """The same matrix written as CSV and read back."""
    path = scratch_path(t.spark, "matrix-csv")
    wide = rating_matrix_wide(t)
    write_csv(wide, path)
    return t.spark.read.schema(wide.schema).option("header", True).csv(path)


@query
def export_play_counts(t):
    """Play counts written as CSV and read back."""
    path = scratch_path(t.spark, "plays-csv")
    counts = ratings.play_counts(t.play)
    write_csv(counts, path)
    return t.spark.read.schema(counts.schema).option("header", True).csv(path)


@query
def export_song_records(t):
    """Songs written as JSON records, nulls kept, and read back."""
    path = scratch_path(t.spark, "songs-json")
    songs = t.song.select("id", "title", "duration", "privacy", "lyric", F.col("releaseDate").cast("string").alias("releaseDate"))
    write_json(songs, path)
    return t.spark.read.schema(songs.schema).json(path)


# ---- similarity and neighbours


def _like_ratings(t):
    return cut(ratings.binary_ratings(t.like, "songId"), "likes")


def _play_ratings(t):
    return cut(ratings.play_ratings(t.play), "plays")


def _combined(t):
    return cut(ratings.combined_ratings(t.like, t.play), "ratings")


def _follows(t):
    return cut(ratings.binary_ratings(t.follow, "artistId"), "follows")


@query
def user_norms(t):
    return similarity.user_norms(ratings.combined_ratings(t.like, t.play))


@query
def similarity_likes(t):
    return similarity.similarity(_like_ratings(t))


@query
def similarity_plays(t):
    return similarity.similarity(_play_ratings(t))


@query
def similarity_combined(t):
    return similarity.similarity(_combined(t))


@query
def similarity_follow(t):
    return similarity.similarity(_follows(t))


@query
def neighbors_likes(t):
    r = _like_ratings(t)
    return neighbors.top_neighbors(r, recommenders.raters(r))


@query
def neighbors_plays(t):
    r = _play_ratings(t)
    return neighbors.top_neighbors(r, recommenders.raters(r))


@query
def neighbors_combined(t):
    return neighbors.top_neighbors(_combined(t), recommenders.universe(t.user))


@query
def neighbors_follow(t):
    return neighbors.top_neighbors(_follows(t), recommenders.universe(t.user))


@query
def neighbors_follow_hot(t):
    """The same, artists with over 50 followers under the bounds for popular items."""
    return neighbors.top_neighbors(_follows(t), recommenders.universe(t.user), listed_raters=50)


# Users at least so similar are found by the similarity join.
SIMILAR = 0.2


@query
def similar_users_likes(t):
    """Every two users whose likes have a cosine of at least one fifth."""
    return similarity.similar_users(_like_ratings(t), SIMILAR)


@query
def similar_users_combined(t):
    return similarity.similar_users(_combined(t), SIMILAR)


@query
def similar_users_follow(t):
    return similarity.similar_users(_follows(t), SIMILAR)


@query
def export_similarity(t):
    """The similarity of users by their likes written as CSV, one triangle, and read back whole."""
    path = scratch_path(t.spark, "similarity-csv")
    write_triangle(similarity.similarity(_like_ratings(t)), path)
    return read_triangle(t.spark, path)


@query
def export_matrix_blocks(t):
    """Users x all songs written as CSV in blocks of columns, and its cells read back."""
    path, columns = scratch_path(t.spark, "matrix-blocks"), 500
    known = ratings.known_only(ratings.combined_ratings(t.like, t.play), t.user, t.song)
    matrix.write_blocks(*matrix.wide_blocks(known, t.user, t.song, columns), path)
    return matrix.read_blocks(t.spark, path, columns=columns)


# ---- recommendations


@query
def recommend_songs(t):
    return recommenders.recommend_songs(t.like, t.play, t.user, t.song)


def _users_with_events(t):
    events = t.read("events").select("user_id").distinct()
    return events.join(t.user.select(F.col("id").alias("user_id")), "user_id", "left_semi")


@query
def recommend_songs_given_users(t):
    """The first page of songs of the users with an event, given as a table."""
    asked = _users_with_events(t)
    return recommenders.recommend_songs(t.like, t.play, t.user, t.song, user_ids=asked)


@query
def similarity_given_users(t):
    """Rows of the similarity matrix of the users with an event."""
    return similarity.similarity_of(_combined(t), _users_with_events(t))


@query
def recommend_songs_unknown_ids(t):
    """Songs from edges that also name unknown users and songs, which take no part."""
    like = t.like.select("userId", "songId").unionByName(t.event_as_user)
    play = t.play.select("userId", "songId").unionByName(t.event_as_song)
    return recommenders.recommend_songs(like, play, t.user, t.song)


@query
def recommend_songs_page2(t):
    return recommenders.recommend_songs(t.like, t.play, t.user, t.song, page=2)


@query
def recommend_artists(t):
    return recommenders.recommend_artists(t.follow, t.user, t.artist)


@query
def recommend_likes(t):
    return recommenders.recommend_from_likes(t.like)


@query
def recommend_plays(t):
    return recommenders.recommend_from_plays(t.play)


@query
def recommend_report(t):
    report = recommenders.recommend_report(t.like, t.play)
    text = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in report.columns[1:5]}
    return report.withColumns(text)


@query
def recommend_one_user_full_catalog(t):
    """Every song one user has not touched, in rank order."""
    r = _combined(t)
    near = cut(neighbors.top_neighbors(r, recommenders.universe(t.user), user_ids=[ONE_USER]), "neighbors")
    songs = t.song.select(F.col("id").alias("item_id"))
    rows = recommend.recommend_from_catalog(near, r, [ONE_USER], songs)
    return rows.select("user_id", "rank", "item_id", (F.col("w") / ratings.LIKE_TENTHS).alias("score"))


@query
def neighbor_item_union(t):
    return recommenders.neighbor_items(t.like)


# ---- catalogue


def _flat_songs(cards):
    def image(x):
        return F.concat_ws(":", x["image"], x["size"].cast("string"))

    def album(x):
        return F.concat_ws(":", x["albumId"], x["title"], x["albumType"], F.array_join(F.array_sort(F.transform(x["albumImages"], image)), ","))

    def artist(x):
        genres = F.array_join(F.array_sort(F.transform(x["genres"], lambda g: F.concat_ws("=", g["genreId"], g["name"]))), ",")
        return F.concat_ws(":", x["id"].cast("string"), x["name"], x["ArtistSong"]["main"].cast("string"), genres)

    path = F.col("filePathAudio")
    sealed = path.startswith("http")
    return cards.select(
        "id", "title", "releaseDate", "duration", "createdAt",
        F.when(sealed, path).otherwise(fc.open_salted_aes(path, MEDIA.password)).alias("path"),
        joined("album", album).alias("albums"),
        joined("artists", artist).alias("artists"),
    )


@query
def song_cards(t):
    """Cards of all songs that somebody liked."""
    return _flat_songs(catalog.song_cards(t, MEDIA, ids=t.like.select("songId")))


@query
def artist_cards(t):
    """Cards of all artists that somebody follows."""
    cards = catalog.artist_cards(t, MEDIA, ids=t.follow.select("artistId"))
    genres = joined("genres", lambda g: F.concat_ws("=", g["genreId"], g["name"]))
    return cards.select("id", "name", "avatar", genres.alias("genres"))


@query
def recommended_song_cards(t):
    """The first page of songs of every user with the cards of the songs."""
    top = cut(recommenders.recommend_songs(t.like, t.play, t.user, t.song), "recommended")
    cards = catalog.song_cards(t, MEDIA, ids=top.select("item_id"))
    cards = cards.select("id", "title", "duration", F.size("album").alias("albums"), F.size("artists").alias("artists"))
    return catalog.ranked_cards(top, cards)


@query
def recommended_artist_cards(t):
    """The first page of artists of every user with the cards of the artists."""
    top = cut(recommenders.recommend_artists(t.follow, t.user, t.artist), "recommended")
    cards = catalog.artist_cards(t, MEDIA, ids=top.select("item_id"))
    genres = joined("genres", lambda g: F.concat_ws("=", g["genreId"], g["name"]))
    return catalog.ranked_cards(top, cards.select("id", "name", "avatar", genres.alias("genres")))


@query
def local_time_text(t):
    return t.read("events").select("event_id", fc.local_time_text(F.col("ts")).alias("local_time"))


@query
def media_url(t):
    return t.user.select("id", MEDIA.url(F.col("image")).alias("url"))


@query
def secure_media_path(t):
    """Sealed paths with key and initial vector, and what opening them gives; other paths as they are."""
    path = F.col("filePathAudio")
    key, iv = fc.key_and_iv(F.lit(MEDIA.password.encode()), fc.row_salt(F.col("id"), MEDIA.nonce))
    rows, marked = t.song.withColumn("sealed", MEDIA.sealed(path, F.col("id"))), path.contains(MARKER)
    return rows.select(
        "id",
        F.when(marked, F.hex(key)).alias("key"),
        F.when(marked, F.hex(iv)).alias("iv"),
        F.length("sealed").cast("int").alias("sealed_chars"),
        F.when(marked, fc.open_salted_aes(F.col("sealed"), MEDIA.password)).otherwise(F.col("sealed")).alias("payload"),
    )


# ---- moderation


def _scored(t):
    return moderation.score(t.comment_request)


def _reports(t):
    return moderation.reports(_scored(t))


def _text_ids(df):
    ids = [c for c in ("commentParentId", "userId", "songId") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def _scores_apart(scored):
    return scored.select("id", *[F.element_at("scores", i).alias(f"score_{i}") for i in range(1, 7)], "blocked")


@query
def moderation_scores(t):
    return _scores_apart(_scored(t))


def load_word_scorer() -> moderation.Scorer:
    """The stand-in scorer as a classifier in Python, to run through the model seam."""
    words = set(moderation.STAND_IN_WORDS)

    def score(texts):
        hits = [len(words & set(re.split("[^a-z]+", text.lower()))) for text in texts]
        return [[1.0 - 4.0**-h, 0.0, 0.0, 0.0, 0.0, 0.0] for h in hits]

    return score


@query
def moderation_scores_model(t):
    """The same scores from a Python classifier run over Arrow batches."""
    return _scores_apart(moderation.score(t.comment_request, moderation.model_scores(load_word_scorer)))


@query
def moderation_summary(t):
    """Blocked and accepted comments by the label their text has."""
    labels = t.read("labels").select(F.col("doc_id").alias("id"), "toxic")
    scored = _scored(t).select("id", "blocked").join(labels, "id", "left")
    return scored.groupBy("blocked", F.coalesce(F.col("toxic").cast("string"), F.lit("none")).alias("label")).agg(
        F.count("*").alias("comments")
    )


@query
def moderated_comments(t):
    rows = moderation.moderated_comments(cut(_scored(t), "scored"), t.existing_comment)
    return _shown(rows)


def _shown(rows):
    shown = {c: fc.local_time_text(F.col(c)) for c in ("createdAt", "updatedAt")}
    return _text_ids(rows.withColumns(shown))


@query
def moderation_reports(t):
    return _shown(_reports(t))


@query
def accepted_comment_cards(t):
    cards = moderation.accepted_cards(_scored(t), t.user, MEDIA.marker, MEDIA.bucket, MEDIA.endpoint)
    author = [F.col(f"user.{c}").alias(f"user_{c}") for c in ("username", "email", "image", "role", "name")]
    return _text_ids(
        cards.select(
            "id", "commentParentId", "userId", "songId", "content", "hide", "createdAt", "updatedAt",
            *author, "myComment", F.element_at("scores", 1).alias("toxic"),
        )
    )


@query
def moderation_outcomes(t):
    return moderation.outcomes(_scored(t)).select("id", "status", "message", F.element_at("score", 1).alias("toxic"))


# ---- streams


@query
def stream_moderation(t):
    """Comments stored by a stream over the document files."""
    documents = t.read_stream("documents")
    out = scratch_path(t.spark, "moderated-stream")
    job = streams.moderate_stream(
        comment_request(documents, t.read("events")), t.existing_comment, out, f"{out}/progress"
    )
    job.awaitTermination()
    return _shown(streams.visible(t.spark, out, "comments").drop("batch_id"))


@query
def stream_reports(t):
    """The reports of such a stream, each with the comment it is about."""
    documents = t.read_stream("documents")
    out = scratch_path(t.spark, "reported-stream")
    streams.moderate_stream(
        comment_request(documents, t.read("events")), t.existing_comment, out, f"{out}/progress"
    ).awaitTermination()
    comments = streams.visible(t.spark, out, "comments").select(F.col("id").alias("commentId"), F.col("content").alias("comment"), "hide")
    return _shown(streams.visible(t.spark, out, "reports").drop("batch_id")).join(comments, "commentId")


@query
def stream_ratings(t):
    """Weights accumulated by a stream over the event files, in two batches with a compaction between."""
    events, out = t.read("events"), scratch_path(t.spark, "ratings-stream")
    late = F.col("event_id") % 2 == 1
    for batch, part in enumerate((~late, late)):
        events.where(part).write.mode("append").parquet(f"{out}/source")
        source = t.spark.readStream.schema(events.schema).parquet(f"{out}/source")
        streams.ratings_stream(event_edges(source), f"{out}/increments", f"{out}/progress").awaitTermination()
        if batch == 0:
            streams.compact_ratings(t.spark, f"{out}/increments", f"{out}/base", upto=0)
    return streams.stored_ratings(t.spark, f"{out}/increments", f"{out}/base")


@query
def stream_similarity(t):
    """The similarity of users by their events, kept up to date over three batches."""
    events, out = t.read("events"), scratch_path(t.spark, "similarity-stream")
    for batch in range(3):
        events.where(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{out}/source")
        source = t.spark.readStream.schema(events.schema).parquet(f"{out}/source")
        streams.similarity_stream(event_edges(source), f"{out}/state", f"{out}/progress").awaitTermination()
    return streams.current_similarity(t.spark, f"{out}/state")


def load_batched_scorer() -> moderation.Scorer:
    """The stand-in scorer over word numbers, in batches of like length; only whole words are numbered, so no text is cut."""
    words = {w: i + 1 for i, w in enumerate(moderation.STAND_IN_WORDS)}

    def tokens_of(text):
        return sorted({words[w] for w in re.split("[^a-z]+", text.lower()) if w in words})

    return moderation.in_batches(lambda lists: [[1.0 - 4.0 ** -len(x), 0.0, 0.0, 0.0, 0.0, 0.0] for x in lists], tokens_of)


@query
def moderation_scores_batched(t):
    """The same scores from a classifier of token lists, cut to its window and batched by length."""
    return _scores_apart(moderation.score(t.comment_request, moderation.model_scores(load_batched_scorer)))
