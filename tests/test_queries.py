"""Every registered query against its SQL counterpart, on the smallest test tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check
from cadenza.queries.jobs import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, db, name):
    ok, text = check.compare(spark, db, FOLDER, name)
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "rank", "item_id", "score"]
    assert df.count() == 150 * 10
