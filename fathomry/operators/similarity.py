"""Similar vectors, groups of linked items, threshold sweeps and what merging keeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, small_side

#: Vectors that cells are built around, at least and at most, and vectors of a block of a cell, about.
PIVOTS, MOST_PIVOTS, BLOCK = 8, 2_048, 512


def cosine_pairs(items: DataFrame, key: str, vector: str, threshold: float, scope: str | None = None, pivots: int | None = None, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """All pairs of items whose cosine is at least *threshold*: ``l`` < ``r``, ``similarity`` (rounded to 6).

    Exact. Each vector belongs to the cell of its nearest pivot (the pivots are the vectors with the lowest hashes; their
    number grows with the root of the vectors' number in a scope, up to MOST_PIVOTS).
    Two cells can hold a pair only if the angle between their pivots is at most the greatest angles within both plus
    the angle of the threshold; others are never compared. Cells are cut into blocks, and a block pair is one matrix
    product in a task. With *scope* only items of equal, known scope are compared, and each scope has its own blocks. A low
    threshold leaves all cells near, and then all pairs of a scope are compared. The comparison uses the exact cosine,
    the result a rounded one. Zero vectors are similar to nothing; null vectors and keys don't take part.
    """
    scratch = scratch or Scratch(items.sparkSession)
    spark = items.sparkSession
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = items.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.transform(vector, lambda x: x.cast("double")).alias("v"), norm.alias("n")).where("n > 0 and scope is not null")
    unit = unit.select("id", "scope", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    n, scopes = unit.agg(F.count("*"), F.count_distinct("scope")).first()
    pivots = pivots or int(min(MOST_PIVOTS, max(PIVOTS, (n / max(1, scopes)) ** 0.5)))
    drawn = np.array([r.v for r in unit.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()])  # bounded by pivots
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    if not len(drawn):
        return spark.createDataFrame([], "l long, r long, similarity double")

    def in_cells(batches):
        for pdf in batches:
            if len(pdf):
                dots = np.clip(np.stack(pdf["v"].to_numpy()) @ drawn.T, -1, 1)
                pdf["cell"] = dots.argmax(axis=1)
                pdf["far"] = np.arccos(dots.max(axis=1))
                yield pdf

    cells = unit.mapInPandas(in_cells, "id long, scope string, v array<double>, cell int, far double")
    cells = scratch.keep(cells, "cells")
    far = {r.cell: r.far for r in cells.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # a row for each pivot
    own = np.array(sorted(far))
    reach = np.array([far[c] for c in own])
    between = np.arccos(np.clip(drawn[own] @ drawn[own].T, -1, 1)) - reach[:, None] - reach[None]
    x, y = np.nonzero(np.triu(between <= angle + 1e-9))
    partners = spark.createDataFrame(pd.DataFrame({"a": own[x].astype("int32"), "b": own[y].astype("int32")}))
    counts = scratch.keep(cells.groupBy("scope", "cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "counts")
    placed = cells.join(small_side(counts), ["scope", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("far", "blocks")

    def side(cell: str, other: str) -> DataFrame:
        """The vectors of the cells *cell*, once for each block of the cells *other* of their scope."""
        partner = partners.join(counts.select(F.col("cell").alias(other), F.col("scope").alias("_scope"), "blocks"), other)
        met = placed.join(small_side(partner), (placed["cell"] == F.col(cell)) & (placed["scope"] == F.col("_scope")))
        return met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    left = side("a", "b").where("a < b or block <= other").select("id", "scope", "v", "a", "b", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"))
    right = side("b", "a").where("a < b or other < block").select("id", "scope", "v", "a", "b", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("first"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["first"]]
        other = pdf[~pdf["first"]] if (pdf["a"].iloc[0], pdf["i"].iloc[0]) != (pdf["b"].iloc[0], pdf["j"].iloc[0]) else own
        if not len(own) or not len(other):
            return pd.DataFrame({"l": [], "r": [], "similarity": []}).astype({"l": "int64", "r": "int64"})
        dots = np.stack(own["v"].to_numpy()) @ np.stack(other["v"].to_numpy()).T
        x, y = np.nonzero(dots >= threshold)
        a, b, s = own["id"].to_numpy()[x], other["id"].to_numpy()[y], dots[x, y]
        keep = a < b if other is own else a != b
        return pd.DataFrame({"l": np.minimum(a, b)[keep], "r": np.maximum(a, b)[keep], "similarity": s[keep]})

    pairs = left.unionByName(right).groupBy("scope", "a", "b", "i", "j").applyInPandas(multiply, "l long, r long, similarity double")
    return pairs.select("l", "r", F.round("similarity", 6).alias("similarity"))


def linked_groups(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The connected groups of *links* (``a``, ``b``): ``item``, ``group`` (the least item). Items without link are in none.

    Stars of two kinds by turns: an item tells its greater neighbours, then its lesser ones, the least it knows, until
    nothing changes. Neighbourhoods are never gathered, only their least item is taken.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars0")
    n, before = 0, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        n += 1
        last, edges = edges, scratch.keep(small, f"stars{n}")
        now = edges.count()
        if now == before and edges.join(last, ["a", "b"], "left_anti").isEmpty():  # distinct links, as many, and none of them new
            break
        scratch.drop(f"stars{n - 1}")
        before = now
    roots = edges.select(F.col("b").alias("item")).distinct()
    return edges.select(F.col("a").alias("item"), F.col("b").alias("group")).unionByName(roots.select("item", F.col("item").alias("group")))


def sweep_groups(pairs: DataFrame, thresholds: list[float], scratch: Scratch) -> Iterator[tuple[float, int, DataFrame | None]]:
    """From the highest threshold down: the threshold, the pairs at or above it, and the groups they link (``item``, ``group``; None if no pair is).

    *pairs* has ``l``, ``r``, ``similarity``. Each step links the groups found so far instead of the items, so a pair
    is used once, at the first threshold it reaches.
    """
    spark = pairs.sparkSession
    steps = sorted({round(t, 6) for t in thresholds}, reverse=True)
    clean = pairs.where("l is not null and r is not null and l <> r and similarity is not null and not isnan(similarity)")
    level = F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: t > F.col("similarity")))
    best = clean.groupBy(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).agg(F.max("similarity").alias("similarity")).withColumn("level", level).where(F.col("level") < len(steps))
    best = scratch.keep(best.select("a", "b", "level"), "levels")
    counted = {r.level: r["n"] for r in best.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each threshold
    found, total = None, 0
    for k, threshold in enumerate(steps):
        total += counted.get(k, 0)
        new = best.where(F.col("level") == k).select("a", "b")
        if counted.get(k, 0):
            if found is None:
                found = scratch.keep(linked_groups(new, Scratch(spark)), f"groups{k}")
            else:
                known = found.withColumnRenamed("group", "g")
                named = new.join(known.withColumnRenamed("item", "a"), "a", "left").select(F.coalesce("g", "a").alias("a"), "b").join(known.withColumnRenamed("item", "b"), "b", "left").select("a", F.coalesce("g", "b").alias("b"))
                merged = linked_groups(named, Scratch(spark))
                renamed = known.join(merged.select(F.col("item").alias("g"), F.col("group").alias("h")), "g", "left").select("item", F.coalesce("h", "g").alias("group"))
                fresh = merged.join(found.select("item"), "item", "left_anti").select("item", "group")
                found = scratch.keep(renamed.unionByName(fresh), f"groups{k}")
        yield threshold, total, found


def threshold_sweep(pairs: DataFrame, thresholds: list[float], scratch: Scratch | None = None) -> DataFrame:
    """For each threshold: ``pairs`` at or above it, ``groups`` linked by them, ``grouped`` items and ``absorbed`` ones."""
    spark, out = pairs.sparkSession, []
    for threshold, total, found in sweep_groups(pairs, thresholds, scratch or Scratch(spark)):
        items, groups = found.agg(F.count("*"), F.count_distinct("group")).first() if found is not None else (0, 0)
        out.append((threshold, total, groups, items, items - groups))
    return spark.createDataFrame(out, "threshold double, pairs long, groups long, grouped long, absorbed long")


def sweep_by(pairs: DataFrame, thresholds: list[float], items: DataFrame, key: str, category: str, scratch: Scratch | None = None) -> DataFrame:
    """For each threshold and *category* of the items: ``grouped`` items, ``groups`` and ``absorbed`` items."""
    every: DataFrame | None = None
    for threshold, _, found in sweep_groups(pairs, thresholds, scratch or Scratch(pairs.sparkSession)):
        if found is not None:
            joined = found.join(items, found["item"] == items[key]).select(F.lit(threshold).alias("threshold"), category, "group")
            every = joined if every is None else every.unionByName(joined)
    if every is None:
        return items.select(F.lit(0.0).alias("threshold"), category).limit(0).groupBy("threshold", category).agg(F.count("*").alias("grouped"), F.count("*").alias("groups"), F.count("*").alias("absorbed"))
    counted = every.groupBy("threshold", category).agg(F.count("*").alias("grouped"), F.count_distinct("group").alias("groups"))
    return counted.withColumn("absorbed", F.col("grouped") - F.col("groups"))


def canonical_items(groups: DataFrame, items: DataFrame, key: str, rank: list) -> DataFrame:
    """``group``, ``canonical`` (the member that comes first by *rank*, expressions of which greater ones win) and ``members``."""
    joined = groups.join(items, groups["item"] == items[key])
    return joined.groupBy("group").agg(F.max_by("item", F.struct(*rank, -F.col("item"))).alias("canonical"), F.count("*").alias("members"))


def merge_retention(items: DataFrame, groups: DataFrame, canonical: DataFrame, key: str, category: str) -> DataFrame:
    """For each category the items before merging, those kept and those absorbed."""
    joined = items.join(groups, items[key] == groups["item"], "left").join(canonical.select(F.col("canonical").alias("_c")), items[key] == F.col("_c"), "left")
    absorbed = F.col("item").isNotNull() & F.col("_c").isNull()
    return joined.groupBy(category).agg(F.count("*").alias("items"), F.count_if(~absorbed).alias("kept"), F.count_if(absorbed).alias("absorbed"))
