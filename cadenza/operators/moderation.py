"""Scoring comments and routing them to visible comments, hidden comments and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import local_time_text, media_url, stable_id

# The threshold, the number of classes, the model's window, and the texts of reports and replies.
BLOCK_ABOVE = 0.9
MAX_TOKENS = 128
CLASSES = 6
REPORT_TEXT = "Comments that violate community standards"
REPORT_STATUS = "AI"
BLOCKED_MESSAGE = "Comment blocked due to community guidelines violation."
ACCEPTED_MESSAGE = "Comment success"

# Words of the stand-in scorer; a real classifier is given by the caller.
STAND_IN_WORDS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]

Scorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def with_defaults(request: DataFrame) -> DataFrame:
    """Missing content and song id become empty text (content) or stay null (typed ids)."""
    out = request.withColumn("content", F.coalesce("content", F.lit("")))
    if dict(out.dtypes)["songId"] == "string":
        out = out.withColumn("songId", F.coalesce("songId", F.lit("")))
    return out


def stand_in_scores(content: Column) -> Column:
    """Six scores from built-in expressions: the first is 1 - 4^-h for h distinct listed words."""
    word = rf"(?<![a-z])(?:{'|'.join(STAND_IN_WORDS)})(?![a-z])"
    found = F.regexp_extract_all(F.lower(content), F.lit(word), F.lit(0))
    hits = F.size(F.array_distinct(found))
    toxic = F.lit(1.0) - F.pow(F.lit(4.0), -hits)
    return F.array(toxic, *[F.lit(0.0)] * (CLASSES - 1))


_LOADED: dict[str, Scorer] = {}


def loaded(key: str, load: Callable[[], Scorer]) -> Scorer:
    """The scorer kept in this worker process under ``key``; another key takes its place."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def model_scores(load: Callable[[], Scorer], key: str | None = None) -> Callable[[Column], Column]:
    """A column function from a classifier: ``load`` runs once per worker process, whose tasks
    then score batches with it.

    The loader is what a worker runs to get the model (read weights, build a tokenizer); the
    scorer gets whole texts and returns one row of class scores per text. The scorer is kept
    under ``key``, by default the loader's name: give one that changes with what it loads.
    """
    kept_as = key or f"{load.__module__}.{load.__qualname__}"

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = loaded(kept_as, load)
        for texts in batches:
            yield pd.Series([list(map(float, row)) for row in score(texts.tolist())], index=texts.index)

    return run


def in_batches(
    score_tokens: Callable[[Sequence[Sequence[int]]], Sequence[Sequence[float]]],
    tokens_of: Callable[[str], Sequence[int]],
    max_tokens: int = MAX_TOKENS,
    rows: int = 64,
) -> Scorer:
    """A scorer of texts from one of token lists, which pads the lists of a call to the longest.

    Texts are cut to the model's window and go to it ``rows`` at a time in order of their length,
    so that little is padded; the scores come back in the order of the texts.
    """

    def score(texts: Sequence[str]) -> Sequence[Sequence[float]]:
        cut_texts = [tokens_of(t)[:max_tokens] for t in texts]
        order = sorted(range(len(cut_texts)), key=lambda i: len(cut_texts[i]))
        out: list[Sequence[float]] = [()] * len(cut_texts)
        for at in range(0, len(order), rows):
            some = order[at : at + rows]
            for i, row in zip(some, score_tokens([cut_texts[i] for i in some]), strict=True):
                out[i] = row
        return out

    return score


def score(request: DataFrame, scores: Callable[[Column], Column] = stand_in_scores) -> DataFrame:
    """Requests with ``scores``, the first of them as ``toxic``, and whether they are blocked."""
    out = with_defaults(request).withColumn("scores", scores(F.col("content")))
    toxic = F.element_at("scores", 1)
    return out.withColumn("toxic", toxic).withColumn("blocked", toxic > BLOCK_ABOVE)


def moderated_comments(scored: DataFrame, existing: DataFrame) -> DataFrame:
    """The comment rows to store. A blocked comment keeps its parent only if that exists in
    ``existing`` (id) or is an earlier request, by time and id; an accepted one keeps it unchecked.

    Only blocked replies need the lookup: stored comments and requests are first reduced to the
    parents these name, so nothing is grouped or sorted but those. ``scored`` is read several
    times: give it as a written table when the scorer is expensive.
    """
    lookup = F.col("blocked") & F.col("commentParentId").isNotNull()
    wanted = scored.where(lookup).select(F.col("commentParentId").alias("id")).distinct()
    # comments stored before have no time and come before all requests
    asked = scored.select("id", F.struct("createdAt", "id").alias("at")).join(wanted, "id", "left_semi")
    stored = existing.select("id").join(wanted, "id", "left_semi")
    stored = stored.select("id", F.lit(None).cast(asked.schema["at"].dataType).alias("at"))
    # one row per parent, its first appearance
    known = stored.unionByName(asked).groupBy(F.col("id").alias("commentParentId")).agg(
        F.min("at").alias("first"), F.max(F.col("at").isNull()).alias("stored")
    )
    there = F.coalesce(F.col("stored") | (F.col("first") < F.struct("createdAt", "id")), F.lit(False))
    checked = (
        scored.where(lookup)
        .join(known, "commentParentId", "left")
        .withColumn("commentParentId", F.when(there, F.col("commentParentId")))
    )
    out = checked.drop("first", "stored").unionByName(scored.where(~lookup))
    return out.select(
        "id",
        "commentParentId",
        "userId",
        "songId",
        "content",
        F.col("blocked").alias("hide"),
        "createdAt",
        F.col("createdAt").alias("updatedAt"),
    )


def reports(scored: DataFrame) -> DataFrame:
    """One report per blocked comment, by nobody."""
    return scored.where("blocked").select(
        stable_id("report", F.col("id")).alias("id"),
        F.lit(None).cast(scored.schema["userId"].dataType).alias("userId"),
        F.col("id").alias("commentId"),
        F.lit(REPORT_TEXT).alias("content"),
        F.lit(REPORT_STATUS).alias("status"),
        "createdAt",
        F.col("createdAt").alias("updatedAt"),
    )


def accepted_cards(scored: DataFrame, user: DataFrame, marker: str, bucket: str, endpoint: str) -> DataFrame:
    """Accepted comments with formatted times and their author."""
    author = user.select(
        F.col("id").alias("userId"),
        F.struct(
            "id", "username", "email", media_url(F.col("image"), marker, bucket, endpoint).alias("image"), "role", "name"
        ).alias("user"),
    )
    shown = local_time_text(F.col("createdAt"))
    return (
        scored.where(~F.col("blocked"))
        .join(author, "userId")
        .select(
            "id",
            "commentParentId",
            "userId",
            "songId",
            "content",
            F.lit(False).alias("hide"),
            shown.alias("createdAt"),
            shown.alias("updatedAt"),
            "user",
            F.lit(True).alias("myComment"),
            "scores",
        )
    )


def outcomes(scored: DataFrame) -> DataFrame:
    """Reply per request: status, message, scores."""
    return scored.select(
        "id",
        F.when(F.col("blocked"), "error").otherwise("success").alias("status"),
        F.when(F.col("blocked"), BLOCKED_MESSAGE).otherwise(ACCEPTED_MESSAGE).alias("message"),
        F.col("scores").alias("score"),
    )
