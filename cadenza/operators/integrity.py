"""Declared associations between the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.schemas import FOREIGN_KEYS


def expand(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id", prefix: str = "parent_") -> DataFrame:
    """Follow an association from child to parent; works in the other direction alike."""
    renamed = parent.select([F.col(c).alias(f"{prefix}{c}") for c in parent.columns])
    return child.join(renamed, F.col(child_key) == F.col(f"{prefix}{parent_key}"))


def fk_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key among the given tables: non-null references and those without parent.

    References are counted per key before the join, so a key referenced by very many rows
    crosses the network once per map task.
    """

    def check(child: str, column: str, parent: str, key: str) -> DataFrame:
        refs = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
        known = tables[parent].select(F.col(key).alias("k"), F.lit(1).alias("known"))
        return refs.join(known, "k", "left").agg(
            F.lit(f"{child}.{column}").alias("relation"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("refs"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        )

    checks = [check(*fk) for fk in FOREIGN_KEYS if fk[0] in tables and fk[2] in tables]
    return reduce(DataFrame.unionAll, checks)
