"""Periodic runs against plain Python over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import queries, runs
from cadenza.llm.text import table

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, min_words=24, min_periods=3):
    """(start, length, period) of every maximal stretch under its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(min_words, min_periods * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_lce(x, i, j):
    k = 0
    while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
        k += 1
    return k


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=60))
def test_common_prefixes(values):
    x = np.unique(np.array(values), return_inverse=True)[1]
    lce = runs.CommonPrefixes(x)
    pairs = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j]
    i, j = np.array(pairs).T
    assert lce(i, j).tolist() == [plain_lce(values, a, b) for a, b in pairs]


def of(words_lists, **kw):
    names = {w: i for i, w in enumerate(sorted({w for x in words_lists for w in x}))}
    flat = np.array([names[w] for x in words_lists for w in x], np.int64)
    sizes = np.array([len(x) for x in words_lists], np.int64)
    return [[tuple(r) for r in x.tolist()] for x in runs.runs_of_texts(flat, sizes, **kw)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6), max_size=4))
def test_powers(parts):
    """Texts put together from powers of short words over few letters."""
    texts = [[c for block, times in text for c in block * times] for text in parts]
    assert of(texts) == [plain_runs(t) for t in texts]
    assert of(texts, min_words=6, min_periods=4) == [plain_runs(t, 6, 4) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_in_small_grids(monkeypatch, seed):
    monkeypatch.setattr(runs, "GRID_POINTS", 50)
    rng = random.Random(seed)
    text = []
    while len(text) < 1500:
        block = [rng.randrange(30) for _ in range(rng.randrange(1, 120))]
        text += block * rng.choice([1, 1, 2, 3, 5]) + block[: rng.randrange(len(block) + 1)]
    assert of([text, text[:100], text[::-1]]) == [plain_runs(text), plain_runs(text[:100]), plain_runs(text[::-1])]


def edited(key, text):
    words = text.split(" ")
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and words:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_row(key, words):
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (key, len(found), best[0], best[1], best[2], milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_against_plain_python(spark):
    """Every document but the longest, whose plain version is quadratic."""
    got = {r["doc_id"]: tuple(r)[:8] for r in queries.op12_runs(spark, FOLDER).collect()}
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert len(got) == len(docs)
    checked = 0
    for key, text in docs:
        words = [w for w in edited(key, " ".join((text or "").split(" ")).translate({c: " " for c in range(9, 14)})) if w]
        raw = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        words = edited(key, " ".join(raw)) if raw else []
        if len(words) <= 3000:
            checked += 1
            assert got[key] == plain_row(key, words)
    assert checked > len(docs) * 0.9
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    tail = "  a b\tc\x0bd " * 40_000
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "x " * 30, 5), (3, long, 5), (4, tail, 5), (5, "x\x1cy x\x1cy " * 12, 5), (6, " \n ", 5), (7, "ß z " * 30, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect()}
    assert got[1] == got[2] == got[6] == (0, [], "")
    assert got[None] == (30, [(0, 30, 1)], "x")
    assert got[3] == (50_000, [], long)
    assert got[4] == (160_000, [(0, 160_000, 4)], "a b c d")
    assert got[5] == (24, [(0, 24, 1)], "x\x1cy")
    assert got[7] == (30, [(0, 30, 1)], "ß z")
    assert runs.periodic_runs(df.where("false")).collect() == []
