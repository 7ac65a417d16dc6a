"""Aggregating feature rows: identities, best rows, modal names, ordered unions, decisions, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from .running import running_total, text_bucket

#: The rank of the kinds of evidence, the best first.
EVIDENCE_ORDER = ("definition", "taxonomy_row", "example", "named_mention")
#: The categories that come first in reports.
CATEGORY_ORDER = ("persuasion", "moral_framing", "sentiment_affect")
#: The percentiles of score reports.
PERCENTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def with_identity(rows: DataFrame, category: str = "category", name: str = "feature_name") -> DataFrame:
    """*rows* with ``normalized_name`` and ``identity``, category::name."""
    normalized = text.normalize_name(F.col(name))
    return rows.withColumn("normalized_name", normalized).withColumn("identity", values.feature_key(F.col(category), normalized))


def first_rows(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row by *position* of each key; null and empty keys are one. Equal positions end at the row's content."""
    columns = rows.columns
    keyed = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(position, *[c for c in columns if c != position]).alias("_row"))
    return keyed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_row").alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by *order* of each key; rows with a null or empty key are dropped."""
    held = rows
    for k in keys:
        held = held.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    others = [c for c in rows.columns if c not in keys]
    best = held.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def best_row(rank: list[Column], row: Column, position: Column) -> Column:
    """The row with the greatest *rank*, the earliest of equals, as an aggregate."""
    return F.max_by(row, F.struct(*rank, -position))


def evidence_rank(kind: Column) -> Column:
    order = F.array(*[F.lit(k) for k in EVIDENCE_ORDER])
    return F.when(F.array_position(order, kind) > 0, len(EVIDENCE_ORDER) + 1 - F.array_position(order, kind)).otherwise(0)


def modal_names(rows: DataFrame, keys: list[str], name: str, position: str) -> DataFrame:
    """The most frequent non-empty *name* of each key, the first seen of equals. Counted before names meet."""
    counted = rows.where(F.trim(name) != "").groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return counted.groupBy(*keys).agg(F.max_by(name, F.struct("n", -F.col("p"), name)).alias("modal_name"))


def aggregate_features(rows: DataFrame, keys: list[str], position: str, sums: list[str], sets: list[str]) -> DataFrame:
    """A row for each key: ``rows``, the sums, the ordered unions of array columns as arrays, and first positions.

    The values of an array column are made distinct for each key before they are gathered, each at the place where it
    was first seen, so that a hot key gathers its distinct values only.
    """
    found = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(position).alias("first_position"), *[F.sum(s).alias(s) for s in sums])
    for s in sets:
        exploded = rows.select(*keys, F.col(position).alias("_p"), F.posexplode(F.coalesce(s, F.array().cast("array<string>"))).alias("_i", "_v")).where("_v is not null and _v != ''")
        seen = exploded.groupBy(*keys, "_v").agg(F.min(F.struct("_p", "_i")).alias("_at"))
        union = seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(s))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        found = found.alias("a").join(union.alias("b"), same, "left").select("a.*", F.coalesce(f"b.{s}", F.array().cast("array<string>")).alias(s))
    return found


def with_decisions(features: DataFrame, decisions: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """*features* with the columns of their decision, or the *defaults* where they have none, and ``decided``."""
    d = decisions.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in defaults], F.lit(True).alias("_has"))
    joined = features.join(d, features[key] == d["_key"], "left")
    return joined.select(*[features[c] for c in features.columns], *[F.when(F.col("_has"), F.coalesce(F.col(f"_{c}"), v)).otherwise(v).alias(c) for c, v in defaults.items()], F.coalesce("_has", F.lit(False)).alias("decided"))


def top_of_category(features: DataFrame, category: str, order: list[Column], limit: int) -> DataFrame:
    """The first *limit* rows of each category (0: all), with ``category_rank``. Equal rows share no rank."""
    ranked = features.withColumn("category_rank", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    return ranked.where(F.col("category_rank") <= limit) if limit > 0 else ranked


def category_priority(category: Column) -> Column:
    """The place of a category in reports: the fixed ones first, the others behind them."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)
    return F.when(place > 0, place).otherwise(len(CATEGORY_ORDER) + 1)


def score_percentiles(rows: DataFrame, metrics: list[str], category: str) -> DataFrame:
    """The percentiles of each metric over all rows (category null) and of each category: linear, rounded to 4."""
    each = rows.select(category, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(category, "m.*")
    shares = F.array(*[F.lit(p) for p in PERCENTILES])
    quantiles = F.percentile("value", list(PERCENTILES))
    overall = each.groupBy("metric").agg(quantiles.alias("q")).select(F.lit(None).cast("string").alias(category), "metric", "q")
    by = each.groupBy(category, "metric").agg(quantiles.alias("q")).where(F.col(category).isNotNull())
    pairs = F.arrays_zip(shares.alias("percentile"), F.col("q").alias("value"))
    return overall.unionByName(by).select(category, "metric", F.explode(pairs).alias("z")).select(category, "metric", F.col("z.percentile").alias("percentile"), F.round("z.value", 4).alias("value"))


def batches(rows: DataFrame, category: str, key: str, size: int) -> DataFrame:
    """Batches of *size* keys in the order of keys within each category, with an id that changes with their content.

    Keys are numbered by buckets of their beginnings, so that no task orders a whole category.
    """
    placed = rows.select(category, key).distinct().withColumn("_bucket", text_bucket(F.col(key))).withColumn("_one", F.lit(1))
    numbered = running_total(placed, [category], "_bucket", [key], "_one", "_n")
    grouped = numbered.groupBy(category, F.floor(F.col("_n") / size).alias("batch")).agg(F.array_join(F.array_sort(F.collect_list(key)), "\n").alias("_keys"), F.count("*").alias("keys"))
    ident = F.concat_ws(":", F.col(category), (F.col("batch") + 1).cast("string"), values.short_hash(F.col("_keys"), 10))
    return grouped.select(category, (F.col("batch") + 1).alias("batch"), "keys", ident.alias("batch_id"))
