"""Places in a global order without bringing a table, or a group of it, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.plans.materialize import cut


def ranges(df: DataFrame, order: list[Column | str], name: str = "ranges") -> DataFrame:
    """``df`` in ranges of ``order``, written once: more columns range_ and place_.

    Ranges are numbered upwards and are about equally large whatever the values; place_ counts
    from 1 within a range. Rows alike in ``order`` get places in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id())
    dealt = cut(dealt, name)
    return dealt.withColumn("place_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)))


def number_within(df: DataFrame, group: str, order: list[Column | str], name: str = "ranges") -> DataFrame:
    """``df`` with index_: the place from 0 of each row within its ``group`` (nulls are one) by ``order``.

    A group of any size is spread over as many ranges as it needs; only one row per group and
    range is added up over the ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, group, *order).withColumn("range_", F.spark_partition_id()), name)
    sizes = dealt.groupBy(group, "range_").agg(F.count("*").alias("size_"))
    earlier = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias("group_"), F.col("range_").alias("of_range_"), F.coalesce(F.sum("size_").over(earlier), F.lit(0)).alias("before_")
    )
    placed = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(group, "range_").orderBy(*order)))
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("of_range_")))
    index = (F.col("before_") + F.col("place_") - 1).alias("index_")
    return joined.select(*[F.col(c) for c in df.columns], index)
