"""Folding mentions, decisions and matched names into one row for each feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as f


def joined_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """*a* with the other columns of *b*, joined on *keys* of which nulls are equal."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.alias("a").join(b.alias("b"), same, how).select("a.*", *[f"b.{c}" for c in b.columns if c not in keys])


def aggregate_mentions(rows: DataFrame, keys: list[str], name: str, position: str, rank: list[Column], best: list[str], mean: str, sets: list[str]) -> DataFrame:
    """A row for each key: ``rows``, ``first_position``, ``modal_name``, ``mean`` (null counts as 0, rounded to 4), the *best*
    columns of the row that comes first by *rank* (as ``best_``...), and the ordered unions of the array columns *sets*.

    Each part is combined before its shuffle, and array values are made distinct before they are gathered.
    """
    found = f.aggregate_features(rows, keys, position, [], sets)
    top = f.best_row(rank, F.struct(*best), F.col(position))
    single = rows.groupBy(*keys).agg(F.round(F.avg(F.coalesce(F.col(mean).cast("double"), F.lit(0.0))), 4).alias("mean"), top.alias("_b"))
    single = single.select(*keys, "mean", *[F.col(f"_b.{c}").alias(f"best_{c}") for c in best])
    return joined_on(joined_on(found, single, keys), f.modal_names(rows, keys, name, position), keys)


def curate(features: DataFrame, decisions: DataFrame, key: str, sums: list[str], greatest: list[str]) -> DataFrame:
    """The features folded by their decisions: ``canonical``, ``rejected``, ``members``, ``keys``, the sums and the maxima.

    *decisions* has *key*, ``target`` (the canonical key, null for the feature's own) and ``reject``, one row for each key.
    A feature without decision stays as it is.
    """
    joined = features.join(decisions.select(key, "target", "reject"), key, "left")
    folded = joined.withColumn("canonical", F.coalesce("target", key)).withColumn("rejected", F.coalesce("reject", F.lit(False)))
    return folded.groupBy("canonical", "rejected").agg(F.count("*").alias("members"), F.count_distinct(key).alias("keys"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest])


def merge_groups_of(items: DataFrame, groups: DataFrame, key: str, rank: list[Column], sums: list[str], greatest: list[str], keep: list[str]) -> DataFrame:
    """The items with each group folded into its canonical item: *key* and *keep* of that item, ``members``, sums and maxima.

    *groups* has ``item`` and ``group``. Items of no group stay as they are. The canonical item is the first by *rank*
    (greater ones win), then by the least key.
    """
    joined = items.join(groups, items[key] == groups["item"], "left")
    own = F.when(F.col("group").isNull(), F.struct(F.lit(1).alias("lone"), F.col(key).alias("of"))).otherwise(F.struct(F.lit(0).alias("lone"), F.col("group").alias("of")))
    best = f.best_row(rank, F.struct(key, *keep), F.col(key))
    found = joined.groupBy(own.alias("_g")).agg(best.alias("_b"), F.count("*").alias("members"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest])
    return found.select("_b.*", "members", *sums, *greatest)


def known_matches(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that mean each known entry, in two tiers: ``known``, ``tier`` (name, alias or none) and ``row``.

    *known* has ``known``, ``category`` (blank matches any), ``label`` and ``aliases``; *candidates* ``row``, ``category``, ``name`` and
    ``names`` (all its names). Rows of the entry's own name win; only if there are none, those that share an alias count.
    Joins are on names; the category is a condition.
    """
    fits = (F.col("k.category") == "") | (F.col("k.category") == F.col("c.category"))
    k, c = known.alias("k"), candidates.alias("c")
    exact = k.join(c, F.col("k.label") == F.col("c.name")).where(fits & (F.col("k.label") != "")).select("k.known", F.lit("name").alias("tier"), "c.row")
    left = known.join(exact.select("known").distinct(), "known", "left_anti").withColumn("alias", F.explode("aliases")).where("alias <> ''").alias("k")
    named = candidates.withColumn("alias", F.explode(F.array_distinct("names"))).where("alias <> ''").alias("c")
    other = left.join(named, F.col("k.alias") == F.col("c.alias")).where(fits).select("k.known", F.lit("alias").alias("tier"), "c.row").distinct()
    found = exact.unionByName(other)
    none = known.join(found.select("known").distinct(), "known", "left_anti").select("known", F.lit("none").alias("tier"), F.lit(None).cast(candidates.schema["row"].dataType).alias("row"))
    return found.unionByName(none)


def stage_recall(known: DataFrame, found: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """For each stage the known entries that a row of it means: ``stage``, ``expected``, ``matched``, ``missing``.

    *found* has ``known`` and what the conditions of *stages* read."""
    reached = found.groupBy("known").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(s) for s, c in stages.items()])
    joined = known.select("known").distinct().join(reached, "known", "left")
    each = joined.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(s, F.lit(False)).alias("hit")) for s in stages])).alias("e")).select("e.*")
    return each.groupBy("stage").agg(F.count("*").alias("expected"), F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("missing"))


def control_rows(rows: DataFrame, key: str, name: str, synonyms: str, variants: int = 2) -> DataFrame:
    """Rows with at least *variants* distinct synonyms, each as its name (variant 0) and its first synonyms: *key*, ``variant``, ``text``."""
    own = F.array_distinct(F.filter(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != "") & (s != F.col(name))))
    held = rows.where(F.trim(name) != "").withColumn("_s", own).where(F.size("_s") >= variants)
    return held.select(key, F.posexplode(F.concat(F.array(name), F.slice("_s", 1, variants))).alias("variant", "text"))


def control_pairs(controls: DataFrame, key: str) -> DataFrame:
    """The pairs of variants of one row: *key*, ``a``, ``b``, ``kind``. A row has few variants, so pairs are made within it."""
    a, b = controls.alias("a"), controls.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.variant") < F.col("b.variant")))
    kind = F.when(F.col("a.variant") == 0, "canonical_synonym").otherwise("synonym_synonym")
    return met.select(f"a.{key}", F.col("a.text").alias("a"), F.col("b.text").alias("b"), kind.alias("kind"))


def absorbed_items(items: DataFrame, groups: DataFrame, canonical: DataFrame, key: str, category: str, order: list[Column], limit: int) -> DataFrame:
    """The first *limit* absorbed items of each category by *order* with the canonical item of their group and their ``category_rank``."""
    joined = items.join(groups, items[key] == groups["item"]).join(canonical.select("group", "canonical"), "group").where(F.col(key) != F.col("canonical"))
    return f.top_of_category(joined.select(*[items[c] for c in items.columns], "canonical"), category, order, limit)


def retain_unseen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """*rows* with ``unique_key``: the key, with _2, _3 ... behind it for later rows of the same key in the order of *position*."""
    from .running import running_total

    numbered = running_total(rows.withColumn("_one", F.lit(1)).withColumn("_b", F.floor(F.col(position) / 100_000)), [key], "_b", [position], "_one", "_n")
    return numbered.withColumn("unique_key", F.when(F.col("_n") == 0, F.col(key)).otherwise(F.concat(key, F.lit("_"), (F.col("_n") + 1).cast("string")))).drop("_one", "_b", "_n")
