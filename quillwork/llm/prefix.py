"""Prefix sums over very large ordered groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: str, bucket: str, order: list[Column], size: Column, name: str) -> DataFrame:
    """df with `name`: the sum of size over the rows of the same group up to and with this one, in the order (bucket, *order).

    group must have no nulls. Buckets are summed first (a row per group and bucket), the sums of a group's earlier buckets are
    carried over, and rows are sorted only within their bucket, so a task never holds more than one bucket of a group.
    """
    sized = df.withColumn("_size", size.cast("long"))
    sums = sized.groupBy(group, bucket).agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sized.join(sums, [group, bucket]).withColumn(name, F.col("_before") + F.sum("_size").over(inside)).drop("_size", "_before")
