"""PPM against a plain tree of dictionaries, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import grams, language_id


def plain_bits(train, text, order):
    """Code length of ``text`` after ``train`` (bytes), the same model by dictionaries."""
    trees = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        padded = b" " * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                trees[k][padded[i - k : i]][padded[i]] += 1
    padded, bits = b" " * order + text, 0.0
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            met = trees[k][padded[i - k : i]]
            total = sum(met.values())
            if met[padded[i]]:
                bits -= math.log2((2 * met[padded[i]] - 1) / (2 * total))
                break
            if total:
                bits -= math.log2(sum(n > 0 for n in met.values()) / (2 * total))
        else:
            bits += 8
    return bits


TRAIN = {
    "a": ["the cat sat on the mat", "a banana and the hat", "that is that"],
    "b": ["der hund und die katze", "größe über alles für den bär", "und das"],
    "c": ["le chat est sur la table", "été à la plage"],
}


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths(spark, order, monkeypatch):
    monkeypatch.setattr(grams, "GROUP", 64)
    rows = [(i, t, lang) for lang, texts in TRAIN.items() for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, order=order)
    texts = ["the hund", "Größe!! and é", "x" * 150, "zzz 12 ü", "la table " * 40]
    got = model.code_lengths([grams.letters_of(t) for t in texts])
    for i, text in enumerate(texts):
        for j, lang in enumerate("abc"):
            want = plain_bits([grams.letters_of(t) for t in TRAIN[lang]], grams.letters_of(text), order)
            assert got[i, j] == pytest.approx(want, rel=1e-5)


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000))
    table = grams.GramTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 2**40, 5000), keys)
    assert (table.find(others) == -1).all()
    assert (grams.GramTable(np.zeros(0, np.int64)).find(keys[:3]) == -1).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = {r["doc_id"]: r["held_out"] for r in found.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in held.items())
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_odd_rows(spark):
    rows = [(i, t, lang) for lang, texts in TRAIN.items() for i, t in enumerate(texts * 5)]
    rows += [(50, None, "a"), (51, "", "a"), (52, " 12 !?", "b"), (53, "the cat", None), (None, "the cat", "b"), (54, "。。", "a"), (55, "the cat sat " * 100_000, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (50, 51, 52, 53, 54, 55)] == ["und", "und", "und", "a", "und", "a"]
    assert by_id[None]["held_out"] is False and by_id[None]["lang_pred"] == "a"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema)).collect() == []
    got = language_id.identify(spark.createDataFrame([(1, "words", None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
