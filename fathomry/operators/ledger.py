"""Ledgers and statuses: overlays, resumption, summaries of services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(rows: DataFrame, ledger: DataFrame, keys: list[tuple[Column, Column]], value: str, order: Column, default: str) -> DataFrame:
    """*rows* with ``status``, that of the ledger row found by the first of *keys* (of the row, of the ledger) that hits.

    For each key the last ledger row by *order* counts. Null keys never hit.
    """
    joined, found = rows, []
    for i, (own, theirs) in enumerate(keys):
        latest = ledger.select(theirs.alias("_k"), F.col(value).alias("_v"), order.alias("_o")).where("_k is not null").groupBy("_k").agg(F.max_by("_v", "_o").alias(f"_v{i}")).withColumnRenamed("_k", f"_k{i}")
        joined = joined.join(latest, own == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce(*found, F.lit(default)).alias("status"))


def remaining(rows: DataFrame, done: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """The rows that none of *keys* finds among those done. One anti-join for each key, none on an OR."""
    left = rows
    for own, theirs in keys:
        k = done.select(theirs.alias("_k")).where("_k is not null").distinct()
        left = left.join(k, own == F.col("_k"), "left_anti")
    return left


def services_of(services: Column) -> Column:
    """The sorted distinct services of a row; ``unknown`` if there are none."""
    held = F.array_sort(F.array_distinct(F.filter(F.coalesce(services, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))))
    return F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("unknown")))


def service_summary(rows: DataFrame, services: Column, outcomes: dict[str, Column]) -> DataFrame:
    """For each service the rows and how many have each outcome; a row counts once for each of its services."""
    each = rows.select(F.explode(services_of(services)).alias("service"), *[c.alias(n) for n, c in outcomes.items()])
    return each.groupBy("service").agg(F.count("*").alias("total"), *[F.count_if(F.col(n)).alias(n) for n in outcomes])


def service_combinations(rows: DataFrame, services: Column) -> DataFrame:
    """The rows of each combination of services, named by the services joined with +."""
    return rows.select(F.array_join(services_of(services), "+").alias("combination")).groupBy("combination").agg(F.count("*").alias("total"))
