"""The prefix trie against a plain one, and its tables of slots."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_order(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len([w for w in node[-1][1].translate({c: " " for c in range(9, 14)}).split(" ") if w]) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        ends = ",".join(str(c) for c in members[node] if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, schema=SCHEMA, rebuilt=True, least_rows=prefix_trie.LEAST_ROWS):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, schema))
    convs = None
    if rebuilt:
        convs, turns = prefix_trie.with_shared_openings(turns)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, convs, least_rows).collect()), key=str)


def random_rows(seed, convs=120, letters=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), convs):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(["a", "b b"]) for _ in range(rng.randrange(letters)))))
    return rows


@pytest.mark.parametrize("seed,least_rows,bands", [(0, 10**9, 4096), (1, 3, 4096), (2, 8, 2), (3, 1, 1)])
def test_shards_and_top_tree(spark, monkeypatch, seed, least_rows, bands):
    """All in one subtree, or most nodes in a top tree of few or many bands."""
    monkeypatch.setattr(prefix_trie, "BAND_DEPTHS", bands)
    monkeypatch.setattr(prefix_trie, "SHARE", 10**6)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = random_rows(seed)
    assert trie(spark, rows, least_rows=least_rows) == plain_trie(plain_rebuilt(plain_order(rows)))
    assert trie(spark, rows, rebuilt=False, least_rows=least_rows) == plain_trie(plain_order(rows))


def test_long_conversations_and_copies(spark, monkeypatch):
    """One conversation in pieces, another twice, and many copies of a short one."""
    monkeypatch.setattr(prefix_trie, "SHARE", 10**6)
    rows = [(1, t, "user", f"x {t}") for t in range(300)]
    rows += [(c, t, "user", f"y {t % 7}") for c in (2, 3) for t in range(150)]
    rows += [(c, t, "user", "hello") for c in range(10, 200) for t in range(2)]
    assert trie(spark, rows, rebuilt=False, least_rows=40) == plain_trie(plain_order(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, None, "", ""), (2, 0, "assistant", "z"),
        (None, 0, "user", "a"), (None, None, None, None), (20, 1, "user", "x " * 100_000), (21, 5, "user", "x " * 100_000), (22, 5, "use", "rx"), (23, 5, "user", "x"),
    ]
    for rebuilt in (False, True):
        want = plain_order(rows)
        assert trie(spark, rows, rebuilt=rebuilt) == plain_trie(plain_rebuilt(want) if rebuilt else want)
    extra = [(*r, 3, "n") for r in rows]
    assert trie(spark, extra, SCHEMA + ", depth int, place string") == plain_trie(plain_rebuilt(plain_order(rows)))
    assert trie(spark, []) == []
    # every turn is left out, so only the root stays
    lone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie(spark, [(lone, 0, "user", "a")]) == plain_trie({lone: []})


def test_prefixes_over_many_ranges(spark):
    """A conversation that lies in several ranges is digested as a whole."""
    rows = [(7, t, "user", str(t % 3)) for t in range(2000)] + [(8, t, "user", str(t % 3)) for t in range(1500)]
    found = prefix_trie._prefixes(prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    pairs = found.groupBy("pa", "pb").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert sorted((r["d"], r["n"]) for r in pairs) == [(d, 2 if d <= 1500 else 1) for d in range(1, 2001)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(2**63), 2**63, (2, n))
    a[: n // 2] = a[n // 2 : n // 2 * 2]  # equal in one half of the digest
    slots = prefix_trie.Slots(a, b)
    assert sorted(slots(a, b).tolist()) == list(range(n))
    assert (slots(a, b + 1) == -1).all()


def test_equal_digests_are_refused():
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.array([1, 1]), np.array([2, 2]))
