"""Column expressions on texts that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z, all else unchanged (``lower`` would change other alphabets too, but it is the faster one)."""
    changed = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(changed)


# What separates words: every ASCII character that is neither a digit nor, after lower-casing, a letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Lower-cased words of a text as an array; null and wordless texts give an empty one."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in smaller Arrow batches than Spark's default of 10,000 rows, which suits
    numbers: a batch is held several times over on both sides. A setting of the user's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)
