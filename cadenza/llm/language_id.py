"""Language ID by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.grams import GramTable, codes_of, groups, letters_of, sums
from cadenza.llm.text import short_batches, type_of

UNKNOWN = "und"
# Longest context in bytes.
ORDER = 3
# About so many documents of each language are learned from, chosen by a hash of their ids.
TRAIN_DOCS = 3000
# More languages than this are taken for a mistaken column.
MAX_LANGUAGES = 256


class PpmModel:
    """Frozen context trees of all languages, as tables of code lengths in bits.

    Built from counts of (order + 1)-grams per language: the first ``order`` bytes of a gram are
    a context, and dropping its first byte gives the same symbol in the next shorter context. In
    a context met t times with u different symbols, a symbol met n times has probability
    (2n - 1) / 2t, and escaping to the next shorter context u / 2t (PPM's method D). A symbol new
    to all contexts costs 8 bits after the last escape. A context never met is passed for free.
    """

    def __init__(self, languages: list[str], codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """``codes``: distinct (order + 1)-grams; ``counts``: a row for each, a column per language."""
        self.languages, self.order = languages, order
        levels = []
        for length in range(order + 1, 0, -1):
            levels.append((codes, counts))
            codes, back = np.unique(codes & ((1 << (8 * (length - 1))) - 1), return_inverse=True)
            shorter = np.zeros((len(codes), len(languages)))
            np.add.at(shorter, back, counts)
            counts = shorter
        self.grams: list[tuple[GramTable, np.ndarray]] = []  # by length - 1
        self.escapes: list[tuple[GramTable, np.ndarray]] = []
        unseen = np.full(len(languages), 8.0)
        for codes, counts in reversed(levels):
            contexts, of_gram = np.unique(codes >> 8, return_inverse=True)
            total = np.zeros((len(contexts), len(languages)))
            different = np.zeros_like(total)
            np.add.at(total, of_gram, counts)
            np.add.at(different, of_gram, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(different / (2 * total)), 0.0)
                seen = -np.log2((2 * counts - 1) / (2 * total[of_gram]))
            length = len(self.grams)
            shorter = self._lengths(codes & ((1 << (8 * length)) - 1), length) if length else unseen
            bits = np.where(counts > 0, seen, escape[of_gram] + shorter)
            self.grams.append((GramTable(codes), bits.astype(np.float32)))
            self.escapes.append((GramTable(contexts), escape.astype(np.float32)))

    def _lengths(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Bits of the last byte of each ``length``-gram, a column per language."""
        if length == 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        table, bits = self.grams[length - 1]
        rows = table.find(codes)
        out = bits[rows] if len(bits) else np.zeros((len(codes), len(self.languages)), np.float32)
        if len(new := np.flatnonzero(rows < 0)):
            table, escape = self.escapes[length - 1]
            left = table.find(codes[new] >> 8)
            add = np.where((left >= 0)[:, None], escape[left] if len(escape) else 0, 0)
            out[new] = add + self._lengths(codes[new] & ((1 << (8 * (length - 1))) - 1), length - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language takes for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        for data, *spans in groups(texts, self.order):
            sums(self._lengths(codes_of(data, self.order + 1), self.order + 1), *spans, out)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of least code length and its share of the posterior; ``und`` and 0 for
        a text that is null or has no letter."""
        known = [i for i, t in enumerate(texts) if self.languages and t and next(filter(str.isalpha, t), None)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths([letters_of(texts[i]) for i in known])
        if len(known):
            worse = bits - bits.min(axis=1, keepdims=True)
            scores[known] = 1 / np.exp2(-np.minimum(worse, 1000)).sum(axis=1)
            for i, best in zip(known, bits.argmin(axis=1), strict=True):
                names[i] = self.languages[best]
        return names, scores


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over ``docs`` (lang, text), summed up in the tasks and then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                of_lang = (batch.column(1)[i].as_py() for i in np.flatnonzero(langs == lang))
                for data, _, start, end in groups(map(letters_of, of_lang), order):
                    inside = np.zeros(len(data) + 1, np.int64)
                    np.add.at(inside, start, 1)
                    np.add.at(inside, end, -1)
                    codes, n = np.unique(codes_of(data, order + 1)[np.cumsum(inside[:-1]) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> PpmModel:
    """Learn from about ``train_docs`` whole texts of each non-null language.

    That bounds the counts brought to the driver and sent to the tasks; which documents are taken
    depends on a hash of their ids alone. Prediction reads every text.
    """
    short_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    wanted = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000))
    for row in sizes:
        wanted = wanted | ((F.col("lang") == row["lang"]) & (draw < 1_000_000 * train_docs / row["count"]))
    found = gram_counts(labelled.where(wanted), order).toPandas()
    languages = sorted(set(found["lang"]))
    codes, row = np.unique(found["gram"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(codes), len(languages)))
    counts[row, np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object))] = found["n"]
    return PpmModel(languages, codes, counts, order)


def predict(docs: DataFrame, model: PpmModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; a map over Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_column, "lang_pred", "score"])

    rows = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text_"))
    return rows.mapInArrow(run, f"`{id_column}` {type_of(rows, id_column)}, lang_pred string, score double")


def is_held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never learned from: those whose crc32 of the id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score), the model learned from the others
    than the held-out ones with an id.

    Languages are compared by exact code lengths over the whole text; at equal lengths the first
    by name wins. Null and letterless texts are ``und`` with score 0, as are all texts when there
    is nothing to learn from. Repeated rows get equal predictions, a null id is not held out and
    not learned from, an empty table gives an empty one, other columns are not read.
    """
    learn = docs.where(~is_held_out(id_column) & F.col(id_column).isNotNull())
    model = train(learn, id_column=id_column, text_column=text_column, lang_column=lang_column, **options)
    found = predict(docs, model, id_column, text_column)
    return found.select(id_column, is_held_out(id_column).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language can be told (not ``und``), with all columns.

    Rows without a language get the predicted one; given ones stay. No shuffle of the texts.
    """
    learn = docs.where(~is_held_out(id_column) & F.col(id_column).isNotNull())
    model = train(learn, id_column=id_column, text_column=text_column, lang_column=lang_column, **options)
    if not model.languages:
        return docs.where(F.coalesce(F.col(text_column).cast("string"), F.lit("")).rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_column), docs.columns.index(lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                names, _ = shared.value.predict(part.column(text_at).to_pylist())
                known = pa.array([n != UNKNOWN for n in names], pa.bool_())
                filled = pc.coalesce(part.column(lang_at), pa.array(names, part.column(lang_at).type))
                yield part.set_column(lang_at, part.schema.field(lang_at), filled).filter(known)

    return docs.mapInArrow(run, docs.schema)
