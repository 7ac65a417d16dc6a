"""Cells of tables that hold lists, numbers or nested values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def listed(cell: Column) -> Column:
    """The texts of a cell: those of a JSON list, else the cell itself; none of a null or blank one."""
    t = F.trim(cell)
    parsed = F.from_json(t, F.lit("array<string>"), {"allowSingleQuotes": "false"})
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast(EMPTY)).when(t.startswith("[") & parsed.isNotNull(), F.filter(parsed, lambda x: x.isNotNull())).otherwise(F.array(t))


def compact(values: Column, most: int, letters: int) -> Column:
    """The first *most* texts, each of at most *letters* letters."""
    return F.transform(F.slice(values, 1, most), lambda x: F.left(x, F.lit(letters)))


def page_numbers(values: Column) -> Column:
    """The distinct whole numbers of an array of texts, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def first_usable(*columns: Column) -> Column:
    """The first text of the columns that isn't null or blank, arrays giving their first such text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def at_path(row: str, path: str, fields: set[str]) -> Column:
    """The value at a dotted *path* of a row, or of the flat column in which the dots are underscores; *fields* are the columns there are."""
    flat = path.replace(".", "_")
    held = [F.col(f"{row}.{path}" if row else path).cast("string")] if path.split(".")[0] in fields else []
    held += [F.col(flat).cast("string")] if flat in fields else []
    return first_usable(*held) if held else F.lit(None).cast("string")
