"""License scan: phrases, and an exact containment join of text blocks with license notices."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.text import type_of
from cadenza.plans.materialize import cut

# Phrases that name a license by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices that licenses ask to be put into files.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
# Words of a block, if no notice is over half as long; one starts at every word.
BLOCK = 128
_SPACED = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters, digits and all other characters."""
    return text.translate(_SPACED).split()


def phrase_places(words: list[bytes], phrases: Mapping[bytes, str]) -> list[tuple[int, str]]:
    """(word number, label) for every place of every phrase; phrases are words joined by spaces."""
    text, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        at, last, word = text.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            word, last = word + text.count(b" ", last, at), at
            found.append((word, label))
            at = text.find(b" " + phrase + b" ", at + 1)
    return found


def block_words(notices: Mapping[str, str]) -> int:
    """Words of a block: room for the longest notice drawn out to twice its length."""
    return max([BLOCK, *(2 * len(words_of(text.encode())) for text in notices.values())])


def best_window(places: list[int], tokens: list[int], notice: frozenset[int], size: int, starts: range) -> int:
    """The most different tokens of ``notice`` in ``size`` words from one of ``starts`` on; places ascend."""
    held = [(p, t) for p, t in zip(places, tokens) if t in notice]
    inside: Counter[int] = Counter()
    best = end = 0
    # a window can begin with its first token of the notice, or at the last start
    for at, (place, token) in enumerate(held):
        first = min(place, starts[-1])
        while end < len(held) and held[end][0] < first + size:
            inside[held[end][1]] += 1
            end += 1
        best = max(best, len(inside))
        if place >= starts[-1]:
            break
        inside[token] -= 1
        if not inside[token]:
            del inside[token]
    return best


def token_counts(docs: DataFrame, tokens: frozenset[bytes], text_column: str = "text") -> dict[bytes, int]:
    """Occurrences of the given tokens in all texts, summed up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for x in batch.column(0).cast(pa.binary()):
                found.update(w for w in words_of(x.as_py() or b"") if w in tokens)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    counted = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "token binary, n long")
    # no more rows than tokens were given
    return {bytes(r["token"]): r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame,
    notices: Mapping[str, str] = NOTICES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n_words, places, spans), one per row, and matches
    (doc_id, text_hash, span, label, containment) of all blocks that hold at least ``threshold``
    of a notice's tokens. A block is ``block_words(notices)`` words, or the text if that is
    shorter, and starts at any word; the blocks that start in the same ``block_words`` words are
    one span, which gives the highest containment of its blocks.

    1. The notices' tokens are counted over the whole corpus; their global order is by count,
       rarest first. Only tokens of notices matter, as blocks may hold any others.
    2. A block that shares ``need`` of a notice's n tokens has one of the n - need + 1 rarest
       (prefix filter). Spans with such a token, and as many tokens of notices as any notice
       needs (length filter), go on as token numbers and places.
    3. Joined with the notices on these tokens, a pair can still have one more than what stands
       behind the shared token on either side (positional filter); what is left is counted
       exactly, first in the span, then in each of its blocks.
    """
    size = block_words(notices)
    tokens = {label: sorted(set(words_of(text.encode()))) for label, text in notices.items()}
    counts = token_counts(docs, frozenset(t for x in tokens.values() for t in x), text_column)
    ordered = sorted({t for x in tokens.values() for t in x}, key=lambda t: (counts.get(t, 0), t))
    number = {t: i for i, t in enumerate(ordered)}
    sides = [(label, sorted(number[t] for t in x), ceil(threshold * len(x) - 1e-9)) for label, x in tokens.items()]
    prefix = frozenset(ordered[t] for _, x, need in sides for t in x[: len(x) - need + 1])
    least = min((need for _, _, need in sides), default=0)
    named = {b" ".join(words_of(p.encode())): label for p, label in phrases.items()}

    def spans_of(words: list[bytes]) -> list[dict]:
        if prefix.isdisjoint(words):
            return []
        held = [(at, number[w]) for at, w in enumerate(words) if w in number]
        rare = sorted({n for at, t in held if ordered[t] in prefix for n in (at // size, at // size - 1)} & set(range(-(-len(words) // size))))
        out, start = [], 0
        for span in rare:
            while held[start][0] < span * size:
                start += 1
            stop = start
            while stop < len(held) and held[stop][0] < (span + 2) * size - 1:
                stop += 1
            if len({t for _, t in held[start:stop]}) >= least:
                out.append({"span": span, "places": [p for p, _ in held[start:stop]], "tokens": [t for _, t in held[start:stop]]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("word", pa.int64()), ("label", pa.string())])
        span = pa.struct([("span", pa.int64()), ("places", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32()))])
        for batch in batches:
            sizes, places, spans = [], [], []
            for x in batch.column(2).cast(pa.binary()):
                words = words_of(x.as_py() or b"")
                sizes.append(len(words))
                places.append([{"word": w, "label": label} for w, label in phrase_places(words, named)])
                spans.append(spans_of(words))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "places", "spans"])

    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = f"doc_id {type_of(rows, 'doc_id')}, text_hash long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<span:long,places:array<long>,tokens:array<int>>>"
    scanned = cut(rows.mapInArrow(run, schema), "scanned")

    heads = [(t, i, label, x, need) for label, x, need in sides for i, t in enumerate(x[: len(x) - need + 1])]
    heads = docs.sparkSession.createDataFrame(heads, "token int, i int, label string, notice array<int>, need int")
    spans = scanned.select("doc_id", "text_hash", F.inline("spans")).withColumn("held", F.array_sort(F.array_distinct("tokens")))
    met = spans.select("*", F.posexplode("held").alias("j", "token")).join(F.broadcast(heads), "token")
    behind = F.least(F.size("notice") - F.col("i"), F.size("held") - F.col("j"))
    # of the shared tokens that pass, a pair goes on with its first; all others are behind it
    shared = F.array_intersect("held", "notice")
    pairs = met.where((behind >= F.col("need")) & (F.col("token") == F.array_min(shared)) & (F.size(shared) >= F.col("need")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for span, places, tokens, notice in zip(*(batch.column(name).to_pylist() for name in ("span", "places", "tokens", "notice"))):
                best.append(best_window(places, tokens, frozenset(notice), size, range(span * size, (span + 1) * size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(best, pa.int64()), pa.array([len(x) for x in batch.column("notice").to_pylist()], pa.int64())], [*batch.schema.names[:5], "best", "n"])

    counted = pairs.select("doc_id", "text_hash", "span", "label", "need", "places", "tokens", "notice")
    counted = counted.mapInArrow(count, f"doc_id {type_of(rows, 'doc_id')}, text_hash long, span long, label string, need int, best long, n long")
    found = counted.where(F.col("best") >= F.col("need"))
    return scanned, found.select("doc_id", "text_hash", "span", "label", (F.col("best") / F.col("n")).alias("containment"))


def licenses(docs: DataFrame, notices: Mapping[str, str] = NOTICES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8, **columns) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels,
    labels, score).

    ``n_base`` counts the places of ``phrases``, with their first and last start and their
    labels; ``labels`` adds those of ``scan``'s matches. ``score`` is 1 with a phrase, else the
    highest containment found, else 0.

    Null, empty and wordless texts have no words, places or labels. Rows repeating an id and text
    get equal rows, rows of one id with different texts each their own; null ids are allowed. An
    empty table gives an empty one. Other columns are not read.
    """
    scanned, found = scan(docs, notices, phrases, threshold, **columns)
    added = found.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    added = added.withColumnsRenamed({"doc_id": "added_id", "text_hash": "added_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_hash") == F.col("added_hash"))
    base = F.array_sort(F.array_distinct("places.label"))
    none = F.array().cast("array<string>")
    return scanned.join(added, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("added", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
