"""Every stage of the pipeline against a plain version over the smallest table."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from cadenza.llm import mixing, token_output  # noqa: E402
from cadenza.llm.text import table  # noqa: E402
from cadenza.plans.materialize import cut  # noqa: E402
from test_decontamination import plain as plain_contamination  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402
from test_token_output import expected as expected_tokens  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, FOLDER), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.schema == before.schema
        assert Counter(map(str, after.collect())) <= Counter(map(str, before.collect()))


def test_language(stages):
    before, after = stages[0]
    letters = {r["doc_id"] for r in before.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert {r["doc_id"] for r in after.collect()} == letters


def test_near_duplicates(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in before.collect()]
    want = {k for (k, _), c in zip(rows, plain_components(rows), strict=True) if k == c}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    judged = plain_contamination([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert any(r[-1] for r in judged)
    assert {r["doc_id"] for r in after.collect()} == {r[0] for r in judged if not r[-1]}


def test_mixing(spark, stages):
    """All documents, in the order of their slots."""
    before, after = stages[3]
    assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(before).collect()}
    placed = [slots[r["doc_id"]] for r in after.orderBy(*token_output.stored_order()).collect()]
    assert placed == sorted(placed) and len(set(placed)) > 1


def test_tokens(stages):
    """The token files hold the documents in the order of the mixing stage's table."""
    before, after = stages[4]
    rows = [(r["doc_id"], r["text"]) for r in before.orderBy(*token_output.stored_order()).collect()]
    assert [r[0] for r in rows] != sorted(r[0] for r in rows)
    assert [tuple(r) for r in after.orderBy("start").collect()] == expected_tokens(rows)


def test_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(map(tuple, stages[4][1].collect()))


def test_clashing_columns(spark):
    """Columns named as those that the stages use inside come through as they are."""
    names = ["row", "id", "text_hash", "slot_", "key_", "mixed_", "kept_id_", "kept_hash_", "bad_id_", "bad_hash_", "root", "fp", "tie", "before_0", "index_", "text_", "range_"]
    rows = [(i, f"some words that stand here for number {i} " * 9, "en", "ab"[i % 2], 1, *[f"{n} {i}" for n in names]) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, FOLDER), name)
        assert after.schema == docs.schema
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in docs.collect()}
        docs = after
    found = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in found.collect()} == {r["doc_id"] for r in docs.collect()} != set()


def test_repeated_and_null_rows(spark):
    long = "some words that stand here " * 20
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_hash_ int"
    rows = [(1, long, "en", "a", 1, 0)] * 3 + [(None, long, "en", "a", 1, 0), (2, None, "en", "a", 0, 0), (3, "other text of id three", None, "b", 0, 0)]
    rows += [(None, f"lone null {'x' * 30}", "en", None, 9, 0)] * 2
    docs = spark.createDataFrame([r[:5] for r in rows], schema.removesuffix(", text_hash_ int"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = cut(stage(spark, docs, FOLDER), name)
    got = sorted(((r["doc_id"], r["lang"]) for r in docs.collect()), key=str)
    assert got == [(1, "en"), (3, "en"), (None, "en")]
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, FOLDER), name)
    assert empty.collect() == []
