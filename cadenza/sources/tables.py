"""Reading and writing domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.schemas import schema


def read_table(spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A domain table from files, with its declared schema (no inference pass)."""
    return spark.read.format(fmt).schema(schema(table)).options(**options).load(path)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower=None,
    upper=None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **properties,
) -> dict[str, str]:
    """Reader options for a database table, split into ranges of a numeric or time column.

    Without a partition column Spark reads the table through one connection and one task, so
    name one for anything large. Credentials come from the caller.
    """
    options = {"url": url, "dbtable": table, "fetchsize": fetch_size, **properties}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": partitions,
        }
    return {k: str(v) for k, v in options.items()}


def read_jdbc(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """A database table; takes the arguments of ``jdbc_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(*args, **kwargs)).load()


def write_csv(df: DataFrame, path: str) -> None:
    """Export as CSV files with header, replacing what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Export as JSON records, one per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_triangle(pairs: DataFrame, path: str) -> None:
    """Export a symmetric table (user_id, other_id, cos) as CSV, each pair once."""
    write_csv(pairs.where("user_id < other_id").select("user_id", "other_id", "cos"), path)


def read_triangle(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The symmetric table of a ``write_triangle`` export, both directions."""
    rows = spark.read.schema(f"user_id {id_type}, other_id {id_type}, cos double").option("header", True).csv(path)
    return rows.unionByName(rows.select(F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"), "cos"))
