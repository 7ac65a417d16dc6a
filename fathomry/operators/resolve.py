"""Resolving records that share a key into one, with field-wise merging; relevance of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shared import Scratch
from .similarity import linked_groups

def keys_of(rows: DataFrame, position: str, keys: list[tuple[str, Column]]) -> DataFrame:
    """``item`` and ``key`` of each key a row has; a key is named by its kind."""
    made = F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{kind}:"), c)) for kind, c in keys]))
    return rows.select(F.col(position).alias("item"), F.explode(made).alias("key"))


#: A DOI with more distinct titles than this isn't that of a paper but of what holds the papers.
TITLES_OF_DOI = 20


def paper_keys(rows: DataFrame, position: str, doi: Column, addresses: list[Column], title: Column, year: Column, author: Column, most_titles: int = TITLES_OF_DOI) -> DataFrame:
    """``item`` and ``key`` of papers: DOI, arXiv number, title, and title with year and first author if all three are there.

    The arXiv number is taken from the DOI or else from the first of the *addresses* at arXiv. A DOI that rows with more
    than *most_titles* distinct titles share (over all rows) names a volume and is no key; the other keys of its rows stay.
    """
    at = [F.regexp_extract(F.lower(a), r"arxiv\.org/(?:abs|pdf)/\S+", 0) for a in addresses]
    older = [F.nullif(F.regexp_extract(F.lower(c), r"arxiv(?:\.org/(?:abs|pdf)/|[:.]\s*)([a-z][a-z.-]+/\d{7})", 1), F.lit("")) for c in (doi, *addresses)]
    arxiv = F.coalesce(text.arxiv_id(doi), *[text.arxiv_id(a) for a in at], *older)
    made = rows.select(F.col(position).alias("item"), text.normalize_doi(doi).alias("doi"), arxiv.alias("arxiv"), F.nullif(text.normalize_title(title), F.lit("")).alias("title"), year.cast("string").alias("year"), F.nullif(text.surname(author), F.lit("")).alias("author"))
    volumes = made.where("doi is not null").groupBy("doi").agg(F.count_distinct("title").alias("_n")).where(F.col("_n") > most_titles).select("doi", F.lit(True).alias("_volume"))
    marked = made.join(volumes, "doi", "left")
    keys = [("doi", F.when(F.col("_volume").isNull(), F.col("doi"))), ("arxiv", F.col("arxiv")), ("title", F.col("title")), ("hint", F.concat(F.col("title"), F.lit("|"), F.col("year"), F.lit("|"), F.col("author")))]
    return keys_of(marked, "item", keys)


def resolved_groups(rows: DataFrame, position: str, keys: list[tuple[str, Column]], scratch: Scratch | None = None) -> DataFrame:
    """``item`` and ``group`` (its least item) of all rows: rows that share any key, directly or through others, are one.

    Each key links its rows to the least of them, so a key held by very many rows costs a row each, not their pairs.
    """
    return groups_of_keys(rows, position, keys_of(rows, position, keys), scratch)


def groups_of_keys(rows: DataFrame, position: str, held: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The same from the ``item`` and ``key`` of the keys that rows hold."""
    least = held.groupBy("key").agg(F.min("item").alias("b"))
    links = held.join(least, "key").select(F.col("item").alias("a"), "b").where("a <> b")
    found = linked_groups(links, scratch)
    return rows.select(F.col(position).alias("item")).join(found, "item", "left").select("item", F.coalesce("group", "item").alias("group"))


def merged_records(rows: DataFrame, groups: DataFrame, position: str, first: list[str], longest: list[str], greatest: list[str], arrays: list[str]) -> DataFrame:
    """One row for each group: the first non-empty of some columns in the order of rows, the longest of others, the
    greatest of others, and the distinct values of array columns, sorted, made distinct before they are gathered."""
    joined = rows.join(groups, rows[position] == groups["item"])
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    found = joined.groupBy("group").agg(
        F.count("*").alias("records"),
        *[F.min_by(c, F.when(filled(c).isNotNull(), F.col(position))).alias(c) for c in first],
        *[F.max_by(c, F.struct(F.length(c), -F.col(position))).alias(c) for c in longest],
        *[F.max(c).alias(c) for c in greatest],
    )
    for c in arrays:
        union = joined.select("group", F.explode(c).alias("_v")).where("_v is not null and _v <> ''").distinct().groupBy("group").agg(F.array_sort(F.collect_list("_v")).alias(c))
        found = found.join(union, "group", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return found


def title_score(title: Column, weights: list[tuple[str, float]], penalties: list[tuple[str, float]]) -> Column:
    """How much a title is about a subject: the weights of the patterns it holds less those that speak against it, at least 0."""
    return F.greatest(text.weighted_matches(title, weights) - text.weighted_matches(title, penalties), F.lit(0.0))


def metadata_score(source_score: Column, citations: Column, year: Column, has_address: Column, has_doi: Column, this_year: int) -> Column:
    """The part of a paper's rank that its metadata give."""
    age = F.lit(this_year) - year
    return (
        F.least(F.log1p(F.greatest(F.coalesce(source_score, F.lit(0.0)), F.lit(0.0))) / 10, F.lit(0.2))
        + F.least(F.log10(F.coalesce(citations, F.lit(0)) + 1) / 20, F.lit(0.15))
        + F.coalesce(F.greatest(F.lit(0.0), 0.08 - 0.005 * F.greatest(age, F.lit(0))), F.lit(0.0))
        + F.when(has_address, 0.1).otherwise(0.0) + F.when(has_doi, 0.03).otherwise(0.0)
    )
