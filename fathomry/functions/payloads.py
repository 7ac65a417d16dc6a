"""Decisions as nested values and as flat columns; canonical forms of enumerations; short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t


def canonical_of(value: Column, aliases: dict[str, str], default: str | None = None) -> Column:
    """The canonical form of a value by its normalized alias; *default* where none is known."""
    known = F.create_map(*[F.lit(x) for a, c in aliases.items() for x in (a, c)])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(t.normalize_name(value), " ", "_")), F.lit(default))


def criterion_score(value: Column, default: int = 0) -> Column:
    """A score rounded half to even and kept within 0 and 5; *default* for what is no number."""
    n = value.cast("string").try_cast("double")
    return F.coalesce(F.least(F.greatest(F.bround(F.when(~F.isnan(n), n), 0), F.lit(0.0)), F.lit(5.0)).cast("int"), F.lit(default))


def nested(rows: DataFrame, name: str, columns: list[str], prefix: str) -> DataFrame:
    """*rows* with the flat columns ``<prefix>_<column>`` as one struct *name*; blank texts become null."""
    fields = [F.when(F.trim(F.col(f"{prefix}_{c}").cast("string")) != "", F.col(f"{prefix}_{c}")).alias(c) for c in columns]
    return rows.withColumn(name, F.struct(*fields)).drop(*[f"{prefix}_{c}" for c in columns])


def flattened(rows: DataFrame, name: str, defaults: dict[str, Column], prefix: str) -> DataFrame:
    """*rows* with the fields of the struct *name* as columns ``<prefix>_<field>``, nulls replaced by the *defaults*."""
    return rows.select(*[c for c in rows.columns if c != name], *[F.coalesce(F.col(f"{name}.{c}"), d).alias(f"{prefix}_{c}") for c, d in defaults.items()])


def query_text(c: Column, words: int = 12, least: int = 3, letters: int = 160) -> Column:
    """The first content words of a text as a query; its first letters where it has fewer than *least* such words."""
    tokens = t.content_tokens(c)
    return F.when(F.size(tokens) >= least, F.array_join(F.slice(tokens, 1, words), " ")).otherwise(F.left(t.normalize_whitespace(c), F.lit(letters)))


def year_of_file(name: Column) -> Column:
    """The year that a file name begins with; null if none."""
    return F.nullif(F.regexp_extract(name, r"^((?:18|19|20)\d{2})_", 1), F.lit("")).try_cast("int")


def title_of_file(name: Column) -> Column:
    """The title in a file name, without year, hash and ending."""
    return F.replace(F.regexp_replace(F.regexp_replace(name, r"^(?:\d{4}|nd)_", ""), r"_?[0-9a-f]{10}\.pdf$", ""), F.lit("_"), F.lit(" "))


def is_cut(c: Column, most: int) -> tuple[Column, Column]:
    """At most *most* characters of a text, and whether any were cut."""
    return F.left(t.text_or_empty(c), F.lit(most)), F.length(t.text_or_empty(c)) > most


def with_note(notes: Column, addition: Column) -> Column:
    """*notes* with *addition* behind them, unless they hold it."""
    n, a = F.trim(t.text_or_empty(notes)), F.trim(t.text_or_empty(addition))
    return F.when((a == "") | F.contains(n, a), n).when(n == "", a).otherwise(F.concat(F.regexp_replace(n, r"[\s;.]+$", ""), F.lit("; "), a))
