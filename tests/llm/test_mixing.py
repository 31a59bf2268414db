"""Pfair windows, deviation below one block, and the mix of a table against a plain one."""

import random
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from cadenza.llm import mixing  # noqa: E402


def dues(weights, blocks):
    """What is due to each source after every slot, step by step in exact fractions."""
    got = [Fraction(0)] * len(weights)
    for _ in range(sum(blocks)):
        left = Fraction(1)
        while left:
            going = [i for i in range(len(weights)) if got[i] < blocks[i]]
            rate = sum(weights[i] for i in going)
            step = min([left] + [(blocks[i] - got[i]) * Fraction(rate, weights[i]) for i in going])
            for i in going:
                got[i] += step * Fraction(weights[i], rate)
            left -= step
        yield list(got)


def held(weights, blocks, period):
    windows = mixing.Windows(weights, blocks)
    out = [x for start, given, end, then in mixing.periods(windows, period) for x in windows.schedule(start, given, end, then)]
    assert [x[2] for x in out] == list(range(sum(blocks)))
    had = [0] * len(weights)
    for (i, k, slot, release, deadline), due in zip(out, dues(weights, blocks)):
        assert k == had[i] and release <= slot < deadline
        had[i] += 1
        assert all(abs(n - d) < 1 for n, d in zip(had, due))
    assert had == blocks


@pytest.mark.parametrize("seed", range(40))
def test_deviation_below_one_block_at_every_slot(seed):
    """Also over many periods, with sources that leave, and with weights far apart."""
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 7, 25])
    weights = [rng.choice([1, 2, 7, 1000, rng.randint(1, 50), rng.randint(1, 10**6)]) for _ in range(n)]
    blocks = [rng.choice([1, 2, rng.randint(1, 100), rng.randint(1, 400)]) for _ in range(n)]
    held(weights, blocks, rng.choice([1, 2, 3, 10, 37, 10**6]))


def test_fifty_periods_of_weights_no_period_divides():
    weights = list(mixing.whole_weights({"a": 0.0000004, "b": 0.33333, "c": 0.6666666}).values())
    assert weights == [2, 1666650, 3333333]
    held(weights, [3, 1667, 3333], 100)


def test_whole_weights():
    assert mixing.whole_weights({"a": 0.5, "b": 0.25, "c": 1}) == {"a": 2, "b": 1, "c": 4}
    assert mixing.whole_weights({"a": 2.0 / 3, "b": 1e-30}, 1000) == {"a": 999, "b": 1}
    assert mixing.whole_weights({"x": 1e9, "y": 1}) == {"x": 10**9, "y": 1}


def test_thousands_of_sources(spark):
    docs = spark.createDataFrame([(i, f"s{i % 6000}") for i in range(9000)], "doc_id long, source string")
    found = mixing.mix(docs, block_docs=1)
    assert sorted(r["slot"] for r in found.collect()) == list(range(9000))


def test_large_mix_by_periods():
    """Billions of slots: the state of a period follows from the last, and all numbers fit."""
    weights = list(mixing.whole_weights({f"s{i}": (i + 1) ** 0.7 for i in range(5)}, 2**28).values())
    windows = mixing.Windows(weights, [3 * 10**9 // (i + 1) for i in range(5)])
    start, given = 10**9, windows.due(10**9)
    for i in sorted(range(5), key=lambda i: windows.times(i, np.array([given[i] + 1]), True)[0])[: start - sum(given)]:
        given[i] += 1
    then = windows.after(start, given, start + 20_000)
    assert sum(then) == start + 20_000
    assert all(r <= slot < d for _, _, slot, r, d in windows.schedule(start, given, start + 20_000, then))


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 10 + ["a", "b", None, ""]), 3, "x") for i in range(3000)]
    rows += [(7, "hot", 1, "y")] * 40 + [(None, "a", 1, "z"), (5000, "never", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, block long, key string")
    weights = {"hot": 0.5, "a": 0.25, "b": 0.15, "": 0.1, "absent": 3.0}
    found = mixing.mix(docs, weights, block_docs=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter((r[0], r[1]) for r in rows)
    placed = defaultdict(Counter)
    for r in found:
        if r["source"] == "never":
            assert r["slot"] is None and not r["drawn"]
        else:
            assert r["release"] <= r["slot"] < r["deadline"]
            placed[r["source"] or ""][r["slot"], r["block"]] += 1
    slots = [s for blocks in placed.values() for s, _ in blocks]
    assert len(slots) == len(set(slots))
    for blocks in placed.values():
        ordered = sorted(blocks)
        assert [b for _, b in ordered] == list(range(len(ordered)))
        assert [n for _, n in sorted(blocks.items())][:-1] == [4] * (len(ordered) - 1)
    drawn = Counter(r["source"] or "" for r in found if r["drawn"])
    for s, w in weights.items():
        if s != "absent":
            assert abs(drawn[s] / sum(drawn.values()) - w) < 0.02
    kept = mixing.drawn_documents(docs, weights, block_docs=4)
    assert kept.columns == docs.columns
    keep = Counter((r["doc_id"], r["source"]) for r in kept.collect())
    assert keep >= Counter((r["doc_id"], r["source"]) for r in found if r["drawn"])


def test_own_weights_and_empty(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(2000)], "doc_id long, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == 2000
    drawn = Counter(r["source"] for r in found if r["drawn"])
    want = 1800**0.7 / (1800**0.7 + 200**0.7)
    assert abs(drawn["big"] / sum(drawn.values()) - want) < 0.02 and drawn["small"] >= 190
    empty = spark.createDataFrame([], docs.schema)
    assert mixing.mix(empty).collect() == [] and mixing.drawn_documents(empty).collect() == []


def test_all_documents_stay(spark):
    """A source of one document and one of a third of the rows: nothing is lost."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(3000)] + [(3000, "one"), (3001, None), (None, "hot"), (None, "hot"), (7, "s7")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    assert Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs, "").collect())) == Counter(rows)


def test_others_go_on_with_renormalised_weights(spark):
    sizes = {"a": 2000, "b": 300, "c": 700, "none": 5}
    docs = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "doc_id string, source string")
    got = [r["source"] for r in mixing.mixed_documents(docs, {"a": 0.5, "b": 0.3, "c": 0.2}, block_docs=4).collect()]
    assert Counter(got) == {"a": 2000, "b": 300, "c": 700}
    b, c = (len(got) - got[::-1].index(s) for s in "bc")
    assert abs(b - 1000) < 20 and abs(c - 2750) < 30
    for n in range(0, b, 100):
        assert all(abs(got[:n].count(s) - w * n) <= 8 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for n in range(0, c - b, 100):
        assert abs(got[b : b + n].count("c") - 2 / 7 * n) <= 12
    assert set(got[c:]) == {"a"}


def test_periods_run_in_tasks(spark):
    windows = mixing.Windows([5, 3, 1], [40, 11, 30])
    whole, cut = (sorted(map(tuple, mixing.slot_table(spark, ["a", "b", "c"], windows, period).collect()), key=lambda r: r[2]) for period in (1000, 7))
    assert [r[2] for r in cut] == list(range(81)) and {r[:2] for r in cut} == {r[:2] for r in whole}
    assert all(r[3] <= r[2] < r[4] for r in cut)
