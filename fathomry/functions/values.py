"""Values as column expressions: safe casts, first usable ones, ordered sets, identities, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(c: Column, default: int | None = 0) -> Column:
    """A value as a long, by way of a double; *default* if it is none."""
    n = c.cast("string").try_cast("double")
    n = F.when(F.isnan(n) | (F.abs(n) > 9e15), None).otherwise(n)
    return F.coalesce(n.cast("long"), F.lit(default).cast("long"))


def number(c: Column, default: float | None = 0.0) -> Column:
    """A value as a double; *default* if it is none or no number."""
    n = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(n), n), F.lit(default).cast("double"))


def first_text(*columns: Column) -> Column:
    """The first text that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def ordered_set(values: Column) -> Column:
    """An array's distinct texts in their order, without null and empty ones."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def folded_set(values: Column) -> Column:
    """An array's texts, trimmed, in their order; of those equal but for case the first."""
    trimmed = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, v: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(v)), seen).otherwise(F.array_append(seen, v)))


def feature_key(category: Column, name: Column) -> Column:
    return F.concat_ws("::", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit("")))


def short_hash(c: Column, digits: int = 16) -> Column:
    return F.left(F.sha1(F.coalesce(c, F.lit("")).cast("binary")), F.lit(digits))


def literature_support(papers: Column) -> Column:
    """Support of 0 to 5 by the number of papers."""
    n = whole_number(papers)
    return F.when(n >= 15, 5).when(n >= 10, 4).when(n >= 6, 3).when(n >= 3, 2).when(n >= 2, 1).otherwise(0)


def total_score(literature: Column, annotation: Column, distinct: Column) -> Column:
    return F.round(0.4 * literature + 0.3 * annotation + 0.3 * distinct, 2)


def clamped(c: Column, low: float = 0.0, high: float = 1.0, default: float = 0.5) -> Column:
    return F.round(F.least(F.greatest(number(c, default), F.lit(low)), F.lit(high)), 4)


def labelled_text(fields: list[tuple[str, Column]]) -> Column:
    """The arrays of texts as lines "label: a; b", without blank values and without lines of none."""
    held = [(label, F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))) for label, values in fields]
    return F.concat_ws("\n", *[F.when(F.size(v) > 0, F.concat(F.lit(f"{label}: "), F.array_join(v, "; "))) for label, v in held])
