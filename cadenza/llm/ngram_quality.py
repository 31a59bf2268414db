"""Quality by perplexity: interpolated modified Kneser-Ney over byte n-grams, learned from trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.grams import GramTable, codes_of, groups, sums
from cadenza.llm.language_id import MAX_LANGUAGES
from cadenza.llm.text import short_batches, type_of
from cadenza.plans.materialize import cut

ORDER = 4
# So many of the corpus's most frequent grams are sent to the tasks, at some 60 bytes each; texts meet
# all others in a join.
FREQUENT = 150_000
# Documents less probable than so many of the trusted ones of their language are rejected.
QUANTILE = 0.95
# One in so many trusted documents is not learned from, and sets the threshold.
HELD_OUT = 5
# Grams that a task collects before it hands them on.
TALLY = 2_000_000


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): occurrences in ``docs`` (lang, text) of byte n-grams, the text's start padded
    with spaces; summed up in the tasks first. Texts are taken as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in held:
                codes, n = rows(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).cast(pa.binary())
            for lang in set(langs):
                of_lang = (texts[i].as_py() for i in np.flatnonzero(langs == lang))
                for data, _, start, end in groups(of_lang, order - 1):
                    edges = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, end, -1)
                    found = np.unique(codes_of(data, order)[np.cumsum(edges[:-1]) > 0], return_counts=True)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                if size > TALLY:
                    held.update({x: [rows(x)] for x in list(held)})
                    size = sum(len(c) for x in held.values() for c, _ in x)
                    if size > TALLY / 2:
                        yield from flush()
                        size = 0
        yield from flush()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, length: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * length)) - 1))


def per_language(df: DataFrame) -> DataFrame:
    """A table of one row per language as the small side of a join, after a look at its size.

    A join by shuffle would bring all rows of a language into one task.
    """
    df = cut(df, "per-language")
    if df.count() > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    return F.broadcast(df)


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what modified Kneser-Ney takes off counts of 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4))
    found = counts.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(i: int) -> Column:
        of, more = F.col(f"n{i}"), F.col(f"n{i + 1}")
        # small or odd counts of counts give no estimate
        usual = F.when((of > 0) & (more > 0), i - (i + 1) * y * more / of)
        return F.when((usual > 0) & (usual < i), usual).otherwise(0.75 * i).alias(f"d{i}")

    return found.select("lang", d(1), d(2), d(3))


def probabilities(trusted: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p) for all of ``wanted`` (lang, gram) under the counts of ``trusted`` (lang, gram, n).

    The highest order has the counts themselves, each lower one the number of different bytes
    seen in front. From single bytes upwards, each order's grams are joined with their counts,
    with the sums of their context, and with the next shorter gram's probability, all keyed by
    language and gram, so they are as many shards as there are partitions.
    """
    levels = [trusted]
    for length in range(order - 1, 0, -1):
        levels.insert(0, cut(levels[0].groupBy("lang", _suffix(F.col("gram"), length).alias("gram")).agg(F.count("*").alias("n")), "continuations"))
    asked = [wanted.select("lang", "gram")]
    for length in range(order - 1, 0, -1):
        asked.insert(0, asked[0].select("lang", _suffix(F.col("gram"), length).alias("gram")).distinct())
    lower = None
    for length, (counts, grams) in enumerate(zip(levels, asked, strict=True)):
        off = per_language(discounts(counts))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        priced = counts.join(off, "lang").select("lang", "gram", "n", taken.alias("d"))
        contexts = priced.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        found = grams.join(priced, ["lang", "gram"], "left").withColumn("context", F.shiftright("gram", 8)).join(contexts, ["lang", "context"], "left")
        if lower is None:
            found = found.withColumn("below", F.lit(1 / 256))
        else:
            found = found.withColumn("shorter", _suffix(F.col("gram"), length)).join(lower, ["lang", "shorter"])
        own = F.coalesce(F.greatest(F.col("n") - F.col("d"), F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((own + F.col("freed") * F.col("below")) / F.col("total"))
        found = cut(found.select("lang", "gram", p.alias("p")), "probabilities")
        lower = found.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
    return found


def scored(docs: DataFrame, grams: DataFrame, order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """(id, text_hash, lang, n_bytes, bits) per row of ``docs`` (id, text, lang) with ``grams``
    (lang, gram, n, p) of all their grams: the text's code length.

    The ``frequent`` most frequent grams, a bounded table, are looked up in the tasks. What is
    left of a document leaves as rows of gram and count and is joined with the sharded
    probabilities; no such gram is common, so no key is hot.
    """
    top = grams.orderBy(F.desc("n"), "lang", "gram").limit(frequent).select("lang", "gram", "p").toArrow()
    langs, gram, p = (top.column(i).to_numpy() for i in range(3))
    known = {x: (GramTable(gram[langs == x]), -np.log2(p[langs == x])) for x in set(langs)}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_type = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            langs = np.array(batch.column(2).to_pylist(), object)
            texts = batch.column(3).cast(pa.binary())
            n_bytes = np.array([len(x.as_py() or b"") for x in texts], np.int64)
            bits, rare = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                table, cost = shared.value.get(lang, (GramTable(np.zeros(0, np.int64)), np.zeros(0)))
                cost = np.append(cost, 0.0)  # for row -1
                for data, number, start, end in groups((texts[i].as_py() or b"" for i in rows), order - 1):
                    codes = codes_of(data, order)
                    found = table.find(codes)
                    part = np.zeros((len(rows), 1))
                    sums(cost[found][:, None], number, start, end, part)
                    bits[rows] += part[:, 0]
                    edges = np.searchsorted(missing := np.flatnonzero(found < 0), np.stack([start, end]))
                    for i, a, b in zip(number, *edges, strict=True):
                        if b > a:
                            left = np.unique(codes[missing[a:b]], return_counts=True)
                            rare[rows[i]] += [{"gram": g, "n": n} for g, n in zip(*(x.tolist() for x in left), strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n_bytes), pa.array(bits), pa.array(rare, rare_type)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "lang", "n_bytes", "bits", "rare"])

    rows = docs.select("id", F.xxhash64("text").alias("text_hash"), "lang", "text")
    schema = f"id {type_of(docs, 'id')}, text_hash long, lang string, n_bytes long, bits double, rare array<struct<gram:long,n:long>>"
    found = cut(rows.mapInArrow(run, schema), "scored")
    left = found.dropDuplicates(["id", "text_hash", "lang"]).select("id", "text_hash", "lang", F.inline("rare"))
    added = left.join(grams.select("lang", "gram", "p"), ["lang", "gram"]).groupBy("id", "text_hash", "lang")
    added = added.agg(F.sum(-F.log2("p") * F.col("n")).alias("added")).withColumnsRenamed({"id": "added_id", "text_hash": "added_hash", "lang": "added_lang"})
    same = F.col("id").eqNullSafe(F.col("added_id")) & (F.col("text_hash") == F.col("added_hash")) & (F.col("lang") == F.col("added_lang"))
    bits = F.col("bits") + F.coalesce("added", F.lit(0.0))
    return found.join(added, same, "left").select("id", "text_hash", "lang", "n_bytes", bits.alias("bits"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    order: int = ORDER,
    quantile: float = QUANTILE,
    frequent: int = FREQUENT,
    held_out: int = HELD_OUT,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """One row per document: (id, lang, n_bytes, perplexity, threshold, bucket, keep).

    Trusted documents are those of ``labels`` (id, quality) with quality 1. All of their text is
    learned from, one model per language, but for one in ``held_out`` by hash of its id (0: none).
    ``perplexity`` is 2 to the bits per byte. The ``threshold`` of a language is the ``quantile``
    of its held-out trusted documents' perplexities, of all its trusted ones if it has no such;
    ``keep`` tells whether a document is within it; ``bucket`` says in which third of its
    language's documents it is (head, middle, tail).

    A null language is a language of its own, "". Null and empty texts have no perplexity or
    bucket and are not kept. Without trusted text in a language every byte has probability 1/256,
    and there is no threshold: its documents are kept. Labels repeated, or of no document, add
    nothing; rows repeating an id each get a row. Empty tables: no documents give an empty table.
    Other columns are not read.
    """
    short_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), lang.alias("lang"))
    held = F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(held_out)) == 0 if held_out else F.lit(False)
    good = cut(labels.where("quality = 1").select(F.col(id_column).alias("id")).distinct().withColumn("held", held), "trusted-ids")
    full = rows.where("text <> ''")
    # trusted ids grow with the labels, so they are never broadcast, not even while they are few
    trusted = cut(gram_counts(full.join(good.where("not held").hint("merge"), "id", "left_semi"), order), "trusted-counts")
    corpus = cut(gram_counts(full, order), "corpus-counts")
    grams = cut(corpus.join(probabilities(trusted, corpus, order), ["lang", "gram"]), "grams")
    found = scored(rows, grams, order, frequent)
    found = cut(found.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes")))), "perplexities")

    exact = F.lit(10_000)
    thresholds = found.join(good, "id").groupBy("lang").agg(
        F.coalesce(
            F.percentile_approx(F.when(F.col("held"), F.col("perplexity")), quantile, exact), F.percentile_approx("perplexity", quantile, exact)
        ).alias("threshold")
    )
    thirds = found.groupBy("lang").agg(F.percentile_approx("perplexity", [1 / 3, 2 / 3], exact).alias("thirds"))
    limits = per_language(thirds.join(thresholds, "lang", "left"))
    bucket = F.when(F.col("perplexity") <= F.col("thirds")[0], "head").when(F.col("perplexity") <= F.col("thirds")[1], "middle")
    return found.join(limits, "lang").select(
        F.col("id").alias(id_column),
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"),
        "n_bytes",
        "perplexity",
        "threshold",
        F.when(F.col("perplexity").isNotNull(), bucket.otherwise("tail")).alias("bucket"),
        F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("threshold").isNull() & F.col("perplexity").isNotNull()), F.lit(False)).alias("keep"),
    )
