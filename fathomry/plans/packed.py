"""The query of the packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..tables import table
from .registry import query


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["feature_id", "canonical_feature_name", "matching_aliases", "related_terms"]
    rows = table(spark, folder, "expected_features").select(*columns).unionByName(table(spark, folder, "inventory_rows").select(*columns))
    names = rows.select(F.col("canonical_feature_name").alias("value"))
    return split_packed(rows, ["feature_id"], ["matching_aliases", "related_terms"], names).distinct()
