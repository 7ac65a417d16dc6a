"""Exact percentiles, summaries and histograms without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_total

#: Parts into which the range of values is cut for running counts.
PARTS = 1_000


def exact_percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """The percentiles of *value* in each group, interpolated linearly at (n - 1) * share: *group*, ``share``, ``value``.

    Equal values are counted first; counts run over parts of the value range; only the values that a share falls on
    remain. Null and NaN values don't count. Without *group* all rows are one.
    """
    own = group or ["_all"]
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    clean = clean.withColumn("_all", F.lit(0)) if not group else clean
    counted = clean.groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    span = counted.groupBy(*own).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("long")
    placed = running_total(counted.join(F.broadcast(span) if not group else span, own).withColumn("_part", part), own, "_part", ["_v"], "_n", "_before")
    wanted = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_h", (F.col("_total") - 1) * F.col("share"))
    low, high = F.floor("_h"), F.least(F.floor("_h") + 1, F.col("_total") - 1)
    holds = lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_n"))
    marked = wanted.withColumn("_a", F.when(holds(low), F.col("_v"))).withColumn("_b", F.when(holds(high), F.col("_v"))).where("_a is not null or _b is not null")
    ends = marked.groupBy(*own, "share").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_h").alias("_h"))
    found = ends.withColumn("value", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h")))
    return found.select(*group, "share", "value")


def summary(rows: DataFrame, value: str) -> DataFrame:
    """Count, least, greatest, mean and population deviation of the numbers in *value*, rounded to 6."""
    v = F.col(value).cast("double")
    clean = rows.where(v.isNotNull() & ~F.isnan(v))
    return clean.agg(F.count("*").alias("n"), *[F.round(f(v), 6).alias(name) for name, f in (("least", F.min), ("greatest", F.max), ("mean", F.avg), ("deviation", F.stddev_pop))])


def histogram(rows: DataFrame, group: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """The rows in each of *bins* equal bins between *low* and *high*; the last bin is closed, values beyond fall into the ends."""
    v = F.col(value).cast("double")
    at = F.least(F.greatest(F.floor((v - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group, at.alias("bin")).agg(F.count("*").alias("n"))


def rank_areas(rows: DataFrame, value: str, positive: str) -> DataFrame:
    """How well *value* separates rows with *positive* true from the others: ``auc`` (ties count half), Cliff's ``delta``,
    ``n_positive``, ``n_negative``, ``mean_gap``. Equal values are counted first and ranked by parts of their range."""
    v = F.col(value).cast("double")
    clean = rows.where(v.isNotNull() & ~F.isnan(v) & F.col(positive).isNotNull())
    counted = clean.groupBy(v.alias("_v")).agg(F.count_if(positive).alias("_pos"), F.count_if(~F.col(positive)).alias("_neg"))
    span = counted.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("long")
    placed = running_total(counted.join(F.broadcast(span), F.lit(True)).withColumn("_part", part).withColumn("_all", F.lit(0)), ["_all"], "_part", ["_v"], "_neg", "_below")
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    s = placed.agg(won.alias("won"), F.sum("_pos").alias("n_positive"), F.sum("_neg").alias("n_negative"), F.sum(F.col("_v") * F.col("_pos")).alias("sp"), F.sum(F.col("_v") * F.col("_neg")).alias("sn"))
    auc = F.try_divide("won", F.col("n_positive") * F.col("n_negative"))
    gap = F.try_divide("sp", "n_positive") - F.try_divide("sn", "n_negative")
    return s.select("n_positive", "n_negative", F.round(auc, 6).alias("auc"), F.round(2 * auc - 1, 6).alias("delta"), F.round(gap, 6).alias("mean_gap"))
