"""Comparing two ranked feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_total, text_bucket


def ranked_set(rows: DataFrame, category: str, name: str, support: str) -> DataFrame:
    """One row for each category and name with its support and ``rank`` within the category, the best first.

    Ranks are counts of the rows before, taken by buckets of support and beginning of the name, so that no task ranks a
    whole category.
    """
    once = rows.where((F.col(name) != "") & F.col(category).isNotNull()).groupBy(F.col(category).alias("category"), F.col(name).alias("name")).agg(F.max(support).alias("support"))
    bucket = F.when(F.col("support").isNull(), F.lit(2**62)).otherwise(-F.col("support").cast("long") * 2**24 + text_bucket(F.col("name")))
    placed = running_total(once.withColumn("_bucket", bucket).withColumn("_one", F.lit(1)), ["category"], "_bucket", ["name"], "_one", "_before")
    return placed.withColumn("rank", (F.col("_before") + 1).cast("int")).drop("_bucket", "_one", "_before")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (F.col("a.category") == F.col("b.category")) & (F.col("a.name") == F.col("b.name")), "full_outer")


def feature_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All features of both sets with membership, supports and ranks."""
    membership = F.when(F.col("a.name").isNotNull() & F.col("b.name").isNotNull(), "both").when(F.col("a.name").isNotNull(), "set_1_only").otherwise("set_2_only")
    return _joined(a, b).select(F.coalesce("a.category", "b.category").alias("category"), F.coalesce("a.name", "b.name").alias("name"), membership.alias("membership"), F.col("a.support").alias("support_1"), F.col("b.support").alias("support_2"), F.col("a.rank").alias("rank_1"), F.col("b.rank").alias("rank_2"))


def jaccard_series(a: DataFrame, b: DataFrame, first: int, last: int) -> DataFrame:
    """For each category and k the Jaccard similarity of the two top-k sets, and the sizes it comes from.

    One full join; a feature enters the union at the lesser of its ranks and the intersection at the greater, so that
    all k come from two cumulative counts.
    """
    joined = _joined(a.where(F.col("rank") <= last), b.where(F.col("rank") <= last)).select(F.coalesce("a.category", "b.category").alias("category"), F.least("a.rank", "b.rank").alias("enters"), F.when(F.col("a.rank").isNotNull() & F.col("b.rank").isNotNull(), F.greatest("a.rank", "b.rank")).alias("meets"))
    steps = joined.select("category", F.col("enters").alias("k"), F.lit(1).alias("u"), F.lit(0).alias("i")).unionByName(joined.where("meets is not null").select("category", F.col("meets").alias("k"), F.lit(0).alias("u"), F.lit(1).alias("i"))).groupBy("category", "k").agg(F.sum("u").alias("u"), F.sum("i").alias("i"))
    ks = joined.select("category").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(last)))).join(steps, ["category", "k"], "left").fillna(0, ["u", "i"])
    upto = Window.partitionBy("category").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = ks.select("category", "k", F.sum("u").over(upto).alias("union_size"), F.sum("i").over(upto).alias("shared"))
    return summed.where(F.col("k") >= first).withColumn("jaccard", F.round(F.when(F.col("union_size") > 0, F.col("shared") / F.col("union_size")).otherwise(0.0), 6))


def peaks(series: DataFrame) -> DataFrame:
    """The least k with the greatest Jaccard similarity of each category, and how many k share it."""
    best = series.groupBy("category").agg(F.max("jaccard").alias("peak_jaccard"))
    return series.join(best, "category").where("jaccard = peak_jaccard").groupBy("category", "peak_jaccard").agg(F.min("k").alias("peak_k"), F.count("*").alias("tied"))


def venn(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """For each category how many features only one top-k set has and how many both have."""
    u = feature_union(a.where(F.col("rank") <= k), b.where(F.col("rank") <= k))
    return u.groupBy("category").agg(*[F.count_if(F.col("membership") == m).alias(m) for m in ("set_1_only", "both", "set_2_only")])


def linear_fit(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least squares of y on x for each group: ``slope``, ``intercept``, ``r``; null where x (or for r, y) is constant."""
    valid = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    s = valid.groupBy(group).agg(F.count("*").alias("n"), F.covar_pop(xd, yd).alias("c"), F.var_pop(xd).alias("vx"), F.var_pop(yd).alias("vy"), F.avg(xd).alias("mx"), F.avg(yd).alias("my"))
    slope = F.when(F.col("vx") > 0, F.try_divide("c", "vx"))
    r = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return s.select(group, "n", F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 6).alias("intercept"), F.round(r, 6).alias("r"))
