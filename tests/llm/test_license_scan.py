"""License scan against all blocks and all places."""

import random
import re

import pytest

from cadenza.llm import license_scan as ls
from test_decontamination import plain_words


def plain(text, notices, threshold):
    w = plain_words(text)
    places = []
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    best, labels = 0.0, {label for _, label in places}
    base = ",".join(sorted(labels))
    size = ls.block_words(notices)
    for label, notice in notices.items():
        tokens = set(plain_words(notice))
        starts = [i for i in range(len(w)) if w[i] in tokens]
        for at in starts:
            share = len(tokens & set(w[at : at + size])) / len(tokens)
            if share >= threshold - 1e-9:
                labels.add(label)
                best = max(best, share)
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), 1.0 if places else best)


def run(spark, rows, schema="doc_id long, text string", notices=ls.NOTICES, threshold=0.8):
    got = ls.licenses(spark.createDataFrame(rows, schema), notices, threshold=threshold)
    return sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_texts(spark, threshold):
    rng = random.Random(8)
    texts = [None, "", " .,;", "under the MIT license", "Cc by-nc, CC BY NC cc by nc nc", "apache license version 2 under the mit\nlicense x", "über the mit license under the mit licenses"]
    filler = ["the", "of", "license", "software", "copy", "this", "é", "to", "and", "word", "under", "free"]
    for label in ls.NOTICES:
        words = ls.NOTICES[label].split()
        for keep in (1.0, 0.85, 0.75, 0.55):
            some = [w for w in words if rng.random() <= keep]
            rng.shuffle(some)
            text = [rng.choice(filler) for _ in range(rng.choice([0, 50, 300]))]
            text[len(text) // 2 : 0] = some
            texts.append(" ".join(text))
    texts += [texts[10]] * 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "other text, under the mit license"), (None, texts[9]), (3, texts[3])]
    want = sorted(((k, *plain(t, ls.NOTICES, threshold)) for k, t in rows), key=str)
    assert run(spark, rows, threshold=threshold) == want


def test_long_text_empty_table_clashing_columns(spark):
    text = "the license " * 100_000 + "cc by nc " + ls.NOTICES["bsd"]
    rows = [(1, text, 5, ["x"])]
    got = run(spark, rows, "doc_id long, text string, block int, places array<string>")
    assert got == [(1, *plain(text, ls.NOTICES, 0.8))]
    assert got[0][6] == "bsd,cc-by-nc"
    assert run(spark, []) == []


def test_words():
    text = "aZ09_é\x7f\x00Ünd–x—y ²"
    assert [w.decode() for w in ls.words_of(text.encode())] == plain_words(text)
    assert re.fullmatch(r"[a-z0-9 ]+", " ".join(ls.PHRASES))


def test_many_phrases_in_one_text():
    """Places are numbered in one walk: 400,000 phrases take a moment, not minutes."""
    words = [b"cc", b"by", b"nc"] * 400_000
    found = ls.phrase_places(words, {b"cc by nc": "cc-by-nc"})
    assert found == [(3 * i, "cc-by-nc") for i in range(400_000)]


@pytest.mark.parametrize("length", [121, 141, 161])
def test_notices_drawn_out_from_every_offset(spark, length):
    """A notice among other words is found wherever it starts, if one block holds enough of it."""
    words, step = plain_words(ls.NOTICES["bsd"]), length / len(plain_words(ls.NOTICES["bsd"]))
    spread = ["x"] * length
    for i, w in enumerate(words):
        spread[int(i * step)] = w
    rows = [(i, " ".join(["y"] * i + spread + ["z"] * 200)) for i in range(140)]
    got = run(spark, rows)
    assert got == sorted(((k, *plain(t, ls.NOTICES, 0.8)) for k, t in rows), key=str)
    assert all(r[6] == "bsd" for r in got)


def test_notice_longer_than_a_block(spark):
    notice = " ".join(f"w{i}" for i in range(300))
    rows = [(i, "a " * i + notice.replace(" w1", " a w1") + " b" * 50) for i in range(0, 700, 90)]
    got = run(spark, rows, notices={"long": notice})
    assert got == sorted(((k, *plain(t, {"long": notice}, 0.8)) for k, t in rows), key=str)
    assert all(r[6] == "long" for r in got)


def test_best_window_against_all_starts():
    rng = random.Random(3)
    for _ in range(500):
        size, n = rng.randint(1, 9), rng.randint(1, 30)
        first = rng.randint(0, n)
        places = sorted(rng.sample(range(first, first + 2 * size - 1), rng.randint(0, 2 * size - 1)))
        tokens = [rng.randint(0, 6) for _ in places]
        notice = frozenset(rng.sample(range(7), rng.randint(1, 6)))
        want = max(len({t for p, t in zip(places, tokens) if a <= p < a + size} & notice) for a in range(first, first + size))
        assert ls.best_window(places, tokens, notice, size, range(first, first + size)) == want
