"""SimHash near-duplicates against all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from cadenza.llm import graph, simhash


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows of (id, fp) -> the smallest id reachable, for each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


def check(spark, data, schema="doc_id long, text string"):
    docs = spark.createDataFrame(data, schema)
    got = sorted(map(str, (tuple(r) for r in simhash.near_duplicates(docs).collect())))
    rows = [(d[0], plain_fingerprint(d[1])) for d in data]
    want = [(k, f"{fp:016x}", c) for (k, fp), c in zip(rows, plain_components(rows), strict=True)]
    assert got == sorted(map(str, want))


def test_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))] for _ in range(60)]
    data = []
    for i, text in enumerate(base):
        data.append((1000 - i, " ".join(text)))
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(len(text))] = "CHANGED"
            data.append((2000 + i, "\n".join(text)))
        if i % 5 == 0:
            data.append((3000 - i, " ".join(text)))
    data += [(5, None), (4, ""), (9, " \n\t"), (None, ""), (None, "only here"), (7, "É É é"), (7, "É É é"), (7, "other")]
    data.append((1, "long " * 70_000 + "end"))
    check(spark, data)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fp string, id string, cell int, u long")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 1, 2)], docs.schema)
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == [1]


def test_links_keep_every_component(spark):
    """Random walks of one and two bits, a dense ball, and the corners of the signed range."""
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1, 1 << 63, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA, 1 << 62 | 1 << 63}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(15):
            fps.add(at)
            for _ in range(rng.choice([1, 2, 2, 3])):
                at ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i)}
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    rank = {x: i for i, x in enumerate(fps)}
    got = plain_components_of_edges(len(fps), [(rank[u], rank[v]) for u, v in edges])
    assert got == plain_components([(i, x) for i, x in enumerate(fps)])


def plain_components_of_edges(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            if label[u] != low or label[v] != low:
                label[u] = label[v] = low
                changed = True
    return label


def test_counts_bound_the_distance(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", simhash.segment_counts(F.col("a")).alias("ca"), simhash.segment_counts(F.col("b")).alias("cb")
    )
    for r in rows.collect():
        fields = [((r.ca >> s) & 3, (r.cb >> s) & 3) for s in range(0, 64, 2)]
        assert sum(abs(x - y) for x, y in fields) <= (r.a ^ r.b).bit_count()
        assert sum(x for x, _ in fields) == r.a.bit_count()


def test_no_table_of_a_row_per_fingerprint_is_broadcast(spark, monkeypatch):
    """Exploded grid points look as small as the fingerprints they are made of, so no join is left to Spark's estimate."""
    plans, write = [], simhash.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(graph, "cut", seen)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3 * 7 + j) % 50}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    for df in (simhash.near_duplicates(docs), simhash.without_near_duplicates(docs)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
