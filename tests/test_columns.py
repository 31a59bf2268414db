"""Display columns: times, URLs, encrypted paths."""

import base64
import hashlib
import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from cadenza.functions import columns as fc

PASSWORD = "correct horse"
TEXTS = [
    "a/b.mp3", "", 'quo"te\\back', "tab\tnew\nline\r\b\f\x01\x1f", "\x7f", "Đường đến", "emoji 🎵 end", "x" * 200, "/slash/", "'",
    "abc\n", "abc\r", "abc\u0085", "abc\u2028", 'a"b\n', "\n", "é" * 500,
]


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def key_iv(password, salt):
    out, last = b"", b""
    for _ in range(3):
        last = hashlib.md5(last + password + salt).digest()
        out += last
    return out[:32], out[32:]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").coalesce(1)


def test_json_literal(texts):
    assert one(texts, fc.json_literal(F.col("text"))) == [json.dumps(t) for t in TEXTS]


def test_key_and_iv(spark):
    salt = bytes(range(200, 208))
    row = spark.range(1).select(*fc.key_and_iv(F.lit(PASSWORD.encode()), F.lit(salt))).first()
    assert tuple(map(bytes, row)) == key_iv(PASSWORD.encode(), salt)


def test_sealed_text_opens_again(texts):
    sealed = fc.salted_aes(F.col("text"), PASSWORD, fc.row_salt(F.col("id"), "n"))
    rows = texts.withColumn("sealed", sealed)
    assert one(rows, fc.open_salted_aes(F.col("sealed"), PASSWORD)) == TEXTS
    for text, line in zip(TEXTS, one(rows, "sealed")):
        raw = base64.b64decode(line)
        assert "\n" not in line and "\r" not in line
        assert raw[:8] == b"Salted__" and len(raw) == 16 + 16 * (len(text.encode()) // 16 + 1)


@pytest.mark.skipif(not shutil.which("openssl"), reason="no openssl")
def test_sealed_text_opens_with_another_tool(texts):
    sealed = one(texts, fc.salted_aes(F.col("text"), PASSWORD, fc.row_salt(F.col("id"), "n")))
    for text, line in zip(TEXTS, sealed):
        command = ["openssl", "enc", "-d", "-aes-256-cbc", "-md", "md5", "-pass", f"pass:{PASSWORD}", "-provider", "default"]
        out = subprocess.run(command, input=base64.b64decode(line), capture_output=True, check=True)
        assert out.stdout == text.encode()


def test_salts_differ_by_row_and_nonce(texts):
    a, b = one(texts, fc.row_salt(F.col("id"), "n")), one(texts, fc.row_salt(F.col("id"), "m"))
    assert len({bytes(s) for s in a + b}) == 2 * len(TEXTS) and all(len(s) == 8 for s in a + b)


def test_after_marker(spark):
    paths = ["x/M.K/a/b.mp3", "M.K/a M.K/b", "M.K", "MxK/a", "plain", "end/M.K/", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1)
    want = ["a/b.mp3", "a ", "M.K", "MxK/a", "plain", "", None]
    assert one(df, fc.after_marker(F.col("path"), "M.K")) == want


def test_urls_and_secure_paths(spark):
    paths = ["a/MARK/b.png", "MARK", "https://else/where.png", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1)
    path = F.col("path")
    assert one(df, fc.media_url(path, "MARK", "b", "e.org")) == [
        "https://b.e.org/a/MARK/b.png", "https://b.e.org/MARK", "https://else/where.png", "", None,
    ]
    secure = df.withColumn("s", fc.secure_media_path(path, "MARK", PASSWORD, F.lit(b"12345678")))
    got = one(secure, F.when(path.contains("MARK"), fc.open_salted_aes(F.col("s"), PASSWORD)).otherwise(F.col("s")))
    assert got == ['"b.png"', '"MARK"', "https://else/where.png", "", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_time_does_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            "select timestamp_ntz'2024-01-01 20:00:00' a, timestamp_ntz'2024-03-09 19:30:01.5' b, date'2024-05-01' c, cast(null as date) d"
        )
        row = df.select(*[fc.local_time_text(F.col(x)) for x in "abcd"]).first()
        assert tuple(row) == ("01/02/2024 03:00:00", "03/10/2024 02:30:01", "05/01/2024 07:00:00", None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_stable_id(spark):
    ids = one(spark.range(3), fc.stable_id("report", F.col("id")))
    assert len(set(ids)) == 3 and ids == one(spark.range(3), fc.stable_id("report", F.col("id")))
