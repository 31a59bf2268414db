"""Sums along an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.plans.materialize import cut


def suffix_sums(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with, per row, ``rest``: the sum of ``value`` over it and the later rows of its group
    by ``order``; and per group ``total`` and ``size``.

    Rows are dealt out in ranges of (group, order) and written once, so a group of any size lies
    in as many ranges as it needs; only one row per group and range is summed up over the ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("value_", value).repartitionByRange(n, group, *order).withColumn("range_", F.spark_partition_id())
    dealt = cut(dealt, name)
    of_group = Window.partitionBy(group)
    later = of_group.orderBy("range_").rowsBetween(1, Window.unboundedFollowing)
    ranges = dealt.groupBy(group, "range_").agg(F.sum("value_").alias("sum_"), F.count("*").alias("size_"))
    ranges = ranges.select(
        group, "range_", F.coalesce(F.sum("sum_").over(later), F.lit(0)).alias("later_"),
        F.sum("sum_").over(of_group).alias("total"), F.sum("size_").over(of_group).alias("size"),
    )
    within = Window.partitionBy(group, "range_").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    summed = dealt.withColumn("within_", F.sum("value_").over(within)).join(ranges, [group, "range_"])
    return summed.select(*df.columns, (F.col("within_") + F.col("later_")).alias("rest"), "total", "size")
