"""Merkle fingerprints against trees built by hand."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cadenza.llm import merkle

from test_line_dedup import text_hash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fingerprint(text):
    def cut(text, pattern):
        return re.split(pattern, text)

    digests, shown = [], []
    for section in cut(text, merkle.SECTION):
        paragraphs = [[sha(leaf)[:32] for leaf in cut(p, merkle.LEAF)] for p in cut(section, merkle.PARAGRAPH)]
        digests.append(sha(",".join(sha(",".join(leaves))[:32] for leaves in paragraphs))[:32])
        shown.append(";".join(",".join(d[:8] for d in leaves) for leaves in paragraphs))
    return sha(",".join(digests)) + ":" + "/".join(shown)


def plain_likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    left, right = (set(re.split("[,;/]", x[65:])) for x in (a, b))
    return len(left & right) / max(len(left), len(right))


def plain(rows):
    by_id = {}
    for key, text in rows:
        by_id.setdefault(key, []).append(text or "")
    ids = sorted(by_id, key=lambda k: (k is not None, k or 0), reverse=True)
    out = []
    for key, text in rows:
        text = text or ""
        follows = min(by_id[ids[(ids.index(key) + 1) % len(ids)]], key=text_hash)
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        a, b, c = map(plain_fingerprint, (text, edited, follows))
        left, right = (re.split("[;/]", x[65:]) for x in (a, b))
        changed = 0 if a[:64] == b[:64] else len(set(left) - set(right))
        out.append((key, len(text), sha(edited), a, b, plain_likeness(a, b), plain_likeness(a, c), changed))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    got = merkle.fingerprint_edits(spark.createDataFrame(rows, schema))
    return sorted(map(tuple, got.collect()), key=str)


def test_texts(spark):
    rng = random.Random(3)
    words = ["an", "Every", "word", "of", "é", "\U0001f600", "some\n", "text.\n\n", "end\n\n\n", "  ", "apple"]
    rows = [(7 * i - 30, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(50)]
    rows += [(5000, None), (5001, ""), (5002, "x"), (5003, "\n\n"), (5004, "\n\n\n"), (rows[0][0], "another text"), (None, "no id"), rows[3], rows[3], (9000, "word an " * 50_000)]
    assert run(spark, rows) == plain(rows)


def test_few_rows_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(4, "only one text", 3, "q")]
    assert run(spark, rows, "doc_id long, text string, need int, print string") == plain([r[:2] for r in rows])
    rows = [(4, "a b"), (4, "a b"), (2, None)]
    assert run(spark, rows) == plain(rows)


def test_roots_and_edits(spark):
    texts = ["a b\nc\n\nd", "a b\nc\n\n\nd", "a b\nC\n\nd", "a b\nc\n\nd\ne", "", " "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", merkle.fingerprint(F.col("t")))
    prints = {r["i"]: r["p"] for r in rows.collect()}
    assert len({p[:64] for p in prints.values()}) == len(texts)
    pair = spark.createDataFrame([(prints[0], prints[i]) for i in range(4)], "a string, b string")
    got = [r[0] for r in pair.select(merkle.edits(F.col("a"), F.col("b"))).collect()]
    assert got == [[], [1], [1], [2]]


def test_paragraphs_put_in_and_moved(spark):
    first = "one\ntwo\nthree\ntwo\nfour"
    others = ["new\n" + first, "three\ntwo\none\ntwo\nfour", "one\nthree\nfour", "one\nTWO\nthree\nnew\nfour", ""]
    pair = spark.createDataFrame([(i, first, t) for i, t in enumerate(others)], "i int, a string, b string")
    pair = pair.select("i", *[merkle.fingerprint(F.col(c)).alias(c) for c in "ab"])
    found = pair.select(merkle.edits(F.col("a"), F.col("b")), F.size(merkle.changed(F.col("a"), F.col("b"))), "i").orderBy("i").collect()
    assert [tuple(r)[:2] for r in found] == [([], 0), ([], 0), ([1, 3], 1), ([1, 3], 1), ([0, 1, 2, 3, 4], 4)]


SCRIPTS = {
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать",
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική και",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待三人行必有我师一日不见如隔三秋",
    "ja": "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である人間は理性と良心とを授けられており互いに",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิต่างมีเหตุผลและมโนธรรมและควรปฏิบัติต่อกัน",
    "it, no word with a or e": "sono solo quindi molto giusti ognuno di loro li fu nostro dopo poi tutti contro nuovi primi sopra",
}


def test_half_a_paragraph_stays_in_any_script(spark):
    """Of one paragraph with its second half replaced, leaves of the first half stay."""
    rows = [(n, t, t[: len(t) // 2] + "?" * (len(t) // 2)) for n, t in SCRIPTS.items()]
    pair = spark.createDataFrame(rows, "n string, a string, b string").select("n", *[merkle.fingerprint(F.col(c)).alias(c) for c in "ab"])
    for r in pair.select("n", "a", merkle.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert r["a"] == plain_fingerprint(SCRIPTS[r["n"]])
        assert 0 < r["near"] < 1, r["n"]
