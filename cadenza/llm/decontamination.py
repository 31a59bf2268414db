"""Benchmark decontamination: a positional inverted index of the corpus, asked for the rarest benchmark words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.text import words
from cadenza.plans.materialize import cut

WINDOW = 13
# Words broadcast at once: at about 40 bytes a word, some 8 MB. More words take more passes.
TERMS = 200_000
# Passages broadcast at once, of up to 2 * WINDOW - 1 words each: some 8 MB.
PASSAGES = 20_000


def _passes(terms: DataFrame, per_pass: int) -> list[DataFrame]:
    """Distinct terms (term) in groups of about ``per_pass``, each small enough to broadcast."""
    n = -(-terms.count() // per_pass) or 1
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i)) for i in range(n)]


def _looked_up(index: DataFrame, probes: DataFrame, per_pass: int) -> DataFrame:
    """Postings with the ``probes`` of their term. The probes are broadcast in groups of about
    ``per_pass``, so a common term's postings stay where they lie and are no hot key of a shuffle.
    """
    n = -(-probes.count() // per_pass) or 1
    group = F.pmod(F.xxhash64(*probes.columns), F.lit(n))
    found = [index.join(F.broadcast(probes.where(group == i)), "term") for i in range(n)]
    met = found[0]
    for more in found[1:]:
        met = met.union(more)
    return met


def _tokenized(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text_hash, words) per row: what tells the documents apart, and their words."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(text).alias("words"))


def windows_of(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_key, item_id, words, length): the words of each item and how many make a window, all if few."""
    text = F.col(text_column).cast("string")
    found = items.select(F.col(id_column).cast("string").alias("item_id"), words(text).alias("words")).where(F.size("words") > 0)
    return found.distinct().select(
        F.xxhash64("item_id", "words").alias("item_key"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("length")
    )


def term_counts(tokenized: DataFrame, terms: DataFrame, per_pass: int = TERMS) -> DataFrame:
    """(term, n): occurrences in the whole corpus of each of ``terms`` (term). Counted before the shuffle."""
    tokens = tokenized.select(F.explode_outer("words").alias("term"))
    found = [tokens.join(group, "term").groupBy("term").agg(F.count("*").alias("n")) for group in _passes(terms, per_pass)]
    counted = found[0]
    for more in found[1:]:
        counted = counted.union(more)
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rarest_terms(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The word to look up for each window, its rarest one (ties: the first).

    The windows of an item that have the same rarest place follow each other, so they make one
    row (term, item_id, length, terms, before): ``terms`` from the first window's start to the
    last one's end, of which ``before`` come before the looked-up word.
    """
    places = items.select("item_key", "length", F.size("words").alias("size"), F.posexplode("words").alias("pos", "term"))
    places = places.join(counts, "term")
    ahead = Window.partitionBy("item_key").orderBy("pos")
    rarest = F.least(*[F.coalesce(F.lead(F.struct("n", "pos"), i).over(ahead), F.struct("n", "pos")) for i in range(1, window)], F.struct("n", "pos"))
    starts = places.withColumn("rarest", rarest).where(F.col("pos") <= F.col("size") - F.col("length"))
    spans = starts.groupBy("item_key", F.col("rarest.pos").alias("at")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.join(items, "item_key").select(
        F.element_at("words", F.col("at") + 1).alias("term"),
        "item_id",
        "length",
        F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("length")).alias("terms"),
        (F.col("at") - F.col("first")).alias("before"),
    )


def passage_terms(items: DataFrame, counts: DataFrame, near: float, window: int = WINDOW) -> DataFrame:
    """The words to look up for proximity matches, a row (term, item_id, terms, need) for each.

    An item of at least ``window`` words is cut into passages of so many, the last one up to the
    item's end. A match holds ``need`` of the ``terms``, the passage's d different words, so it
    holds one of the d - need + 1 rarest: only their postings are looked up, whichever of the
    passage's words a text has changed.
    """
    last = F.size("words") - window
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(window)), last))
    long = items.where(F.size("words") >= window).select("item_id", "words", F.explode(starts).alias("start"))
    passages = long.select("item_id", F.array_distinct(F.slice("words", F.col("start") + 1, F.lit(window))).alias("terms")).distinct()
    # rounded so that 0.7 * 10 needs 7
    passages = passages.withColumn("need", F.greatest(F.ceil(F.round(near * F.size("terms"), 6)), F.lit(1)).cast("int"))
    one = passages.withColumn("key", F.xxhash64("item_id", "terms"))
    ranked = one.select("*", F.explode("terms").alias("term")).join(counts, "term")
    order = Window.partitionBy("key", "item_id").orderBy("n", "term")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.size("terms") - F.col("need") + 1).select("term", "item_id", "terms", "need")


def positional_index(tokenized: DataFrame, terms: DataFrame, reach: int = WINDOW - 1, per_pass: int = TERMS) -> DataFrame:
    """Postings of ``terms`` (term): (doc_id, text_hash, term, pos, around, left).

    ``around`` is the words up to ``reach`` before and behind the place, ``left`` how many of
    them stand before it, so a phrase can be checked where the posting lies, without another
    read or shuffle of the texts. A posting of the empty term per document has its number of
    words as its place. One pass over the corpus, and the word arrays are not copied per word.
    """
    ended = tokenized.withColumn("ended", F.array_append("words", F.lit("")))
    places = ended.select("doc_id", "text_hash", "words", F.posexplode_outer("ended").alias("pos", "term"))
    left = F.least("pos", F.lit(reach))
    postings = []
    for i, group in enumerate(_passes(terms, per_pass)):
        if i == 0:
            group = F.broadcast(group.union(group.sparkSession.sql("SELECT '' AS term")))
        found = places.join(group, "term")
        around = F.slice("words", F.col("pos") - left + 1, left + 1 + reach)
        postings.append(found.select("doc_id", "text_hash", "term", "pos", around.alias("around"), left.alias("left")))
    index = postings[0]
    for more in postings[1:]:
        index = index.union(more)
    return index


def _exact(start: Column) -> Column:
    """Places of the windows that occur, counted from the first word of ``terms``."""
    offsets = F.sequence(F.lit(0), F.size("terms") - F.col("length"))

    def same(s: Column) -> Column:
        own = F.slice("around", F.greatest(start + s, F.lit(0)) + 1, F.col("length"))
        return (start + s >= 0) & (own == F.slice("terms", s + 1, F.col("length")))

    return F.filter(offsets, same)


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    near: float | None = None,
    per_pass: int = TERMS,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_column: str = "text",
    passages_per_pass: int = PASSAGES,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents (doc_id, text_hash, n_words), one per row of ``docs``, exact matches
    (doc_id, text_hash, item_id, pos, hits) and proximity matches (doc_id, text_hash, item_id, pos, share).

    An exact match lies around the place ``pos`` of a rare word; ``hits`` is the word places
    covered by windows that occur there. A proximity match (none without ``near``) is ``window``
    consecutive words around ``pos`` that hold at least ``near`` of a passage's different words,
    in any order; ``share`` is the most that one such stretch holds. See ``passage_terms``.

    1. Count the benchmark's words over the whole corpus.
    2. Choose each window's rarest word, and as many of each passage's rarest as a match cannot
       all lack, and write the positional index of these.
    3. Lay the windows over the postings of their word, shifted by its place in the window; the
       lists of the other words are met in the posting's own surroundings.
    """
    tokenized = _tokenized(docs, doc_id, text_column)
    wanted = cut(windows_of(items, window, item_id, text_column), "items")
    vocabulary = cut(wanted.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = cut(term_counts(tokenized, vocabulary, per_pass), "counts")
    rare = cut(rarest_terms(wanted, counts, window), "rare")
    terms = rare.select("term")
    if near is not None:
        passages = cut(passage_terms(wanted, counts, near, window), "passages")
        terms = terms.union(passages.select("term"))
    index = cut(positional_index(tokenized, terms.distinct(), window - 1, per_pass), "index")

    documents = index.where("term = ''").select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    postings = index.where("term <> ''")
    start = F.col("left") - F.col("before")
    first = F.col("pos") - F.col("before")
    covered = F.transform("exact", lambda s: F.sequence(first + s, first + s + F.col("length") - 1))
    met = _looked_up(postings, rare, passages_per_pass).withColumn("exact", _exact(start)).where(F.size("exact") > 0)
    exact = met.select("doc_id", "text_hash", "item_id", "pos", F.array_distinct(F.flatten(covered)).alias("hits"))
    if near is None:
        return documents, exact, None
    # few surroundings hold enough of the words at all; only in these stretch by stretch is looked
    close = _looked_up(postings, passages, passages_per_pass).where(F.size(F.array_intersect("terms", "around")) >= F.col("need"))
    stretches = F.sequence(F.lit(1), F.greatest(F.size("around") - window + 1, F.lit(1)))
    most = F.array_max(F.transform(stretches, lambda s: F.size(F.array_intersect("terms", F.slice("around", s, window)))))
    close = close.withColumn("most", most).where(F.col("most") >= F.col("need"))
    return documents, exact, close.select("doc_id", "text_hash", "item_id", "pos", (F.col("most") / F.size("terms")).alias("share"))


def _of_document(df: DataFrame, matches: DataFrame, *found: Column) -> DataFrame:
    """``df`` with what is ``found`` over the matches of each document."""
    of = matches.groupBy("doc_id", "text_hash").agg(*found).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return df.join(of, same, "left").drop("hit_id", "hit_hash")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, per_mille: int = 50, near: float | None = None, per_pass: int = TERMS, passages_per_pass: int = PASSAGES
) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated),
    with ``near`` also n_near and near_sha256.

    A document word inside any occurrence of a window is hit; ``n_items`` counts the items with
    one, ``items_sha256`` is over their ids, and at least ``per_mille`` hit words in a thousand
    make a document contaminated. ``n_near`` and ``near_sha256`` are the same as for items over
    those with a proximity match of share ``near``, exact or not; they do not judge the document.

    Null and wordless texts have no words and no hits; such items have no windows. Rows that
    repeat an id and text get equal rows, rows of one id with different texts each their own.
    Items without an id make hits but are not counted or named. Empty tables: no documents give
    an empty table, no items give documents without hits. Other columns are not read.
    """
    documents, exact, close = find_matches(docs, items, window, near, per_pass, passages_per_pass=passages_per_pass)
    # one row per document, as large as its own hits
    places = F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long")
    joined = _of_document(documents, exact, places.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    if close is not None:
        joined = _of_document(joined, close, F.array_sort(F.collect_set("item_id")).alias("close"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))

    def named(items: str, n: str, digest: str) -> list[Column]:
        ids = F.coalesce(items, F.array().cast("array<string>"))
        return [F.size(ids).cast("long").alias(n), F.sha2(F.array_join(ids, ","), 256).alias(digest)]

    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        *named("items", "n_items", "items_sha256"),
        ((n_hit > 0) & (1000 * n_hit >= per_mille * F.col("n_words"))).alias("contaminated"),
        *([] if close is None else named("close", "n_near", "near_sha256")),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, per_mille: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` lets pass, with all columns, of any name."""
    bad = contamination(docs, items, window, per_mille).where("contaminated")
    bad = cut(bad.select(F.col("doc_id").alias("bad_id_"), F.col("text_hash").alias("bad_hash_")).distinct(), "contaminated")
    # the row as one column, so that its names cannot clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("bad_id_")) & (F.col("text_hash") == F.col("bad_hash_"))
    return rows.join(bad, same, "left_anti").select("row.*")
