"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch


def is_match(left: Column, right: Column, similarity: Column, threshold: float) -> Column:
    """Whether a pair links two records: both indices given and different, similarity a number >= threshold."""
    return left.isNotNull() & right.isNotNull() & (left != right) & similarity.isNotNull() & ~F.isnan(similarity) & (similarity >= threshold)


def merge_groups(pairs: DataFrame, threshold: float = 0.9, left: str = "left_index", right: str = "right_index", similarity: str = "similarity", scratch: Scratch | None = None) -> DataFrame:
    """Group the records that matches link directly or through others.

    Result: ``group_id`` (smallest index of the group) and ``row_index``, one row for each record in a match.

    Method: seed-tree pruning. In each round every vertex tells its neighbours the smallest index it knows; a vertex
    that no one holds for a minimum leaves the graph and hangs under the smallest index it was told, in a forest. The
    other minima stay linked among themselves. When no link is left, the seeds' indices flow down the forest, round by
    round from the last to the first; each round writes its own vertices only. Each round costs a constant number of joins on vertices; long chains take about
    log n rounds. Minima are pre-aggregated before each shuffle, no neighbourhood is collected, and a hub's links stay
    rows that adaptive execution can split.

    Nulls, NaN, pairs of a record with itself, turned and repeated pairs are harmless; extra columns are ignored; an
    empty table gives an empty result. A record without match isn't in the result.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    l, r, s = (F.col(f"`{c}`") for c in (left, right, similarity))
    links = (
        pairs.where(is_match(l, r, s, threshold))
        .select(F.least(l, r).cast("long").alias("a"), F.greatest(l, r).cast("long").alias("b"))
        .distinct()
    )
    links = scratch.keep(links, "links0")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        n = len(rounds)
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        minima = ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        told = ends.join(minima, "u").select(F.col("v").alias("u"), "m").unionByName(minima).distinct()
        told = scratch.keep(told, f"told{n}")
        best = told.groupBy("u").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("u")).alias("held"))
        tree = scratch.keep(best.where(~F.col("held")).select(F.col("u").alias("child"), F.col("best").alias("parent")), f"tree{n}")
        left_over = told.join(best.select("u", "best"), "u").where("m != best").select(F.col("best").alias("a"), F.col("m").alias("b")).distinct()
        links = scratch.keep(left_over, f"links{n + 1}")
        scratch.drop(f"links{n}", f"told{n}")
        rounds.append(tree)
    known: DataFrame | None = None
    for n, tree in reversed(list(enumerate(rounds))):
        if known is None:
            level = tree.select(F.col("child").alias("row_index"), F.col("parent").alias("group_id"))
        else:
            parents = known.select(F.col("row_index").alias("parent"), "group_id")
            level = tree.join(parents, "parent", "left").select(F.col("child").alias("row_index"), F.coalesce("group_id", "parent").alias("group_id"))
        level = scratch.keep(level, f"found{n}")
        known = level if known is None else known.unionByName(level)
        scratch.drop(f"tree{n}")
    if known is None:
        return links.select(F.col("a").alias("group_id"), F.col("b").alias("row_index"))
    seeds = known.select("group_id").distinct().select("group_id", F.col("group_id").alias("row_index"))
    return known.select("group_id", "row_index").unionByName(seeds)
