"""Simple-8b round trips, and token files against the tokenizer applied to whole texts."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import simple8b, token_output
from cadenza.plans.materialize import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 7, 64, 4096]))
def test_any_values(values, block):
    assert simple8b.unpack(simple8b.pack(np.array(values, np.uint64), block)).tolist() == values


@pytest.mark.parametrize("width", range(65))
def test_every_width(width):
    rng = random.Random(width)
    values = [rng.randrange(1 << width) for _ in range(5000)] + [0] * 500 + [(1 << width) - 1] * 300
    data = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(data).tolist() == values
    if width == 12:
        assert len(data) < 8 * len(values) / 4.9


def expected(rows, end_id=2):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, rows, schema="doc_id long, text string", files=None):
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    token_output.write_token_files(spark.createDataFrame(rows, schema), path, PATH, files=files)
    return [tuple(r) for r in token_output.read_token_files(spark, path).orderBy("start").collect()]


TEXTS = [
    None, "", " \n\t ", "Hello, WORLD it's 123 we'll go", "<|endoftext|> a<|startoftext|>b", "é ́x İ ΣΣ oΣ",
    "a b\x1cc\x85d　e", "你好 한글 \U0001f600\U0001f600", "don't'd''s", "x" * 3000, "\x00 \x0b\x0c\r",
]


def test_texts(spark, monkeypatch):
    rng = random.Random(2)
    words = ["The", "of,", "nächst", "12", "(ab", "|", "queue."]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)]
    shuffled = rng.sample(rows, len(rows))
    assert run(spark, shuffled) == expected(rows)
    assert run(spark, shuffled, files=1) == expected(rows)


def test_letters_before_and_behind_signs(spark):
    """Every letter at which pieces might be cut, between all signs."""
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalpha()]
    rows = [(i, " ".join(f"x{c}{s}{c}{s}" for s in signs)) for i, c in enumerate(letters)]
    rng = random.Random(3)
    rows += [(len(rows) + i, "".join(rng.choice(letters[-250:] + signs + ["İ", " "]) for _ in range(300))) for i in range(200)]
    assert run(spark, rows) == expected(rows)


def test_memory_of_the_memo(monkeypatch):
    """What is remembered is given up beyond its bytes, and nothing changes by it."""
    monkeypatch.setattr(token_output, "MEMO_BYTES", 2000)
    memo = token_output.Memo(lambda parts: (np.array([len(p) for p in parts], np.uint32), np.ones(len(parts), np.int64)))
    for k in range(20):
        parts = ["a" * (i + k) for i in range(8)] + [f"b{k}"]
        ids, sizes = memo(parts)
        assert ids.tolist() == [len(p) for p in parts] and sizes.tolist() == [1] * 9
        assert memo.held < 2000 + 9 * (token_output.ENTRY_BYTES + 40)


def test_given_order(spark):
    rows = [(i, f"text {i}", 100 - i) for i in range(50)]
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    token_output.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, place int"), path, PATH, order=[F.col("place")])
    got = [tuple(r) for r in token_output.read_token_files(spark, path).orderBy("start").collect()]
    assert got == expected([r[:2] for r in rows[::-1]])


def test_records_and_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(token_output, "RECORD_IDS", 50)
    monkeypatch.setattr(token_output, "TEXT_BYTES", 900)
    rows = [(i, "some words here " * (i % 40)) for i in range(120)]
    assert run(spark, rows) == expected(rows)


def test_long_text_ties_and_empty_table(spark):
    rows = [(2, "many words " * 150_000)] * 2 + [(1, "same")] * 3
    assert run(spark, rows) == expected(sorted(rows))
    assert run(spark, [(0, "zero"), (None, "null id")]) == expected([(None, "null id"), (0, "zero")])
    assert run(spark, []) == []


def test_clashing_columns(spark):
    rows = [(1, "a b", 5, "x"), (2, "c", 6, "y")]
    assert run(spark, rows, "doc_id long, text string, id long, tie string") == expected([r[:2] for r in rows])
