"""Running totals and ranks without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_bucket(c: Column) -> Column:
    """A number that orders texts as they are ordered, by their first three characters, so that many texts fall into many buckets."""
    code = lambda i: F.least(F.ascii(F.substring(c, i, 1)), F.lit(255)).cast("long")
    return code(1) * 65_536 + code(2) * 256 + code(3)


def running_total(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """*rows* with *name*, the sum of *value* over the rows of the same *group* before each row.

    Rows are ordered by *bucket* (a whole number), then by *order*. Only the sums of the buckets are ordered within a
    group; the rows themselves are ordered within a bucket. So a task holds one bucket, however large the group is.
    Null values count as 0.
    """
    v = F.coalesce(F.col(value), F.lit(0))
    sums = rows.groupBy(*group, bucket).agg(F.sum(v).alias("_rt_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_rt_before", F.coalesce(F.sum("_rt_sum").over(before), F.lit(0))).drop("_rt_sum")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_rt_inside", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return found.join(sums, [*group, bucket]).withColumn(name, F.col("_rt_before") + F.col("_rt_inside")).drop("_rt_before", "_rt_inside")
