"""Kneser-Ney perplexities against plain dictionaries, and held-out labels."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import ngram_quality as q


def plain_model(texts, order):
    """p(bytes of length ``order``) by interpolated modified Kneser-Ney."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = b" " * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    off, total, freed = {}, defaultdict(float), defaultdict(float)
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0
            off[k, i] = d if 0 < d < i else 0.75 * i
        for g, c in counts[k].items():
            total[g[:-1], k] += c
            freed[g[:-1], k] += off[k, min(c, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        below = p(g[1:])
        if (g[:-1], k) not in total:
            return below
        c = counts[k][g]
        own = max(c - off[k, min(c, 3)], 0) if c else 0
        return (own + freed[g[:-1], k] * below) / total[g[:-1], k]

    return p


ROWS = [
    (1, "the cat sat on the mat, the cat ate", "a"), (2, "a dog and the cat and the mat", "a"), (3, "zzzz qqqq &&& the", "a"),
    (4, "größe und über die straße", "b"), (5, "das und die größe", "b"), (6, "ohne label", None), (7, None, "a"), (8, "", "b"),
    (3, "another text of the id", "a"), (None, "no id the cat", "a"), (2, "a dog and the cat and the mat", "a"), (9, "x" * 70, "c"),
]
LABELS = [(1, 1), (2, 1), (2, 1), (3, 0), (4, 1), (99, 1), (None, 1), (5, None), (8, 1)]


def run(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, n long, gram string".replace("n long", "n double"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    return q.judge_quality(docs, known, **options).collect()


@pytest.mark.parametrize("order,frequent", [(4, 150_000), (4, 3), (2, 0)])
def test_perplexities(spark, order, frequent):
    got = run(spark, ROWS, LABELS, order=order, frequent=frequent, held_out=0)
    assert len(got) == len(ROWS)
    good = {k for k, y in LABELS if y == 1 and k is not None}
    want = []
    for key, text, lang in ROWS:
        p = plain_model([t.encode() for k, t, x in ROWS if k in good and x == lang and t], order)
        data = (text or "").encode()
        padded = b" " * (order - 1) + data
        bits = -sum(np.log2(p(padded[i : i + order])) for i in range(len(data)))
        want.append((key, lang, len(data), 2 ** (bits / len(data)) if data else None))
    order_of = lambda r: str((r[0], r[1], r[2], r[3] and round(r[3], 6)))
    for r, w in zip(sorted(map(tuple, got), key=order_of), sorted(want, key=order_of), strict=True):
        assert r[:3] == w[:3] and (r[3] == w[3] or r[3] == pytest.approx(w[3], rel=1e-9))
    for r in got:
        if r["perplexity"] is None:
            assert not r["keep"] and r["bucket"] is None
        elif r["lang"] in ("a", "b"):
            assert r["keep"] == (r["perplexity"] <= r["threshold"])
        else:
            assert r["keep"] and r["threshold"] is None


def test_probabilities_add_up():
    rng = random.Random(1)
    p = plain_model([bytes(rng.choice(b"abc ") for _ in range(200)) for _ in range(3)], 3)
    assert sum(p(b"ab" + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_empty(spark):
    assert run(spark, [], LABELS) == []
    got = run(spark, [(1, "text", "a")], [(1, 1)], held_out=1)
    assert got[0]["perplexity"] == pytest.approx(256) and got[0]["keep"]


def test_long_text_and_small_tally(spark, monkeypatch):
    monkeypatch.setattr(q, "TALLY", 100)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    got = run(spark, [(1, text, "a"), (2, text[:1000], "a")], [(1, 1)], order=2, held_out=0)
    assert {r["n_bytes"] for r in got} == {1_500_000, 1000} and all(8 < r["perplexity"] < 10 for r in got)


def test_held_out_labels(spark):
    """Learned from even ids, judged on odd ones: bad texts are rejected, good ones stay."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = q.judge_quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["keep"] for r in found if r["quality"] == 1]
    bad = [r["keep"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.75 and np.mean(bad) < 0.25
