"""Best representative of each duplicate group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_side

#: What sources write in place of an abstract or a venue, in lower case and without marks around it.
STAND_INS = ("", "n/a", "na", "n.a", "-", "--", "none", "null", "nan", "unknown", "n.p", "untitled", "untitled venue", "no abstract", "no abstract available", "abstract not available", "abstract unavailable", "not available", "unavailable", "tba", "tbd")
#: The sources, the most trusted first. Others come after them.
SOURCE_ORDER = ("crossfile", "openindex", "scholargraph", "preprint_hub", "library_feed", "web_search")
#: A text that ends so was cut off.
CUT = r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:more|cont(?:inued)?|\.\.\.|…)\.?\s*\)|\b(?:read|see) more)[\s.]*$"
#: A text that ends so ended with a whole sentence.
SENTENCE_END = r"[.?!。][\"'”’»)\]]*$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x{a0}\x{200b}]+|[\s\x{a0}\x{200b}]+$", "")


def is_stand_in(c: Column) -> Column:
    """Null, blank, or a phrase that stands for a missing value."""
    return F.regexp_replace(F.lower(trimmed(c)), r"^[\[(<\"']+|[\])>\"'.]+$", "").isin(*STAND_INS)


def is_whole_text(c: Column) -> Column:
    """A real text that isn't cut off: it has a sentence's end and no mark of omission behind it."""
    t = trimmed(c)
    return ~is_stand_in(c) & ~t.rlike("(?i)" + CUT) & t.rlike(SENTENCE_END)


def whole_addresses(c: Column) -> Column:
    """The absolute http and https addresses of an array, without nulls and repeats."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trimmed), lambda x: x.rlike(r"(?i)^https?://[^\s/?#]+\.?[^\s]*$")))


def source_rank(apis: Column) -> Column:
    """Trust in the best of a record's sources; the higher the better."""
    order = F.array(*[F.lit(s) for s in SOURCE_ORDER])
    ranks = F.transform(F.coalesce(apis, F.array().cast("array<string>")), lambda s: F.when(F.array_position(order, s) > 0, F.lit(len(SOURCE_ORDER) + 1) - F.array_position(order, s)).otherwise(F.lit(0)).cast("int"))
    return F.coalesce(F.array_max(ranks), F.lit(0))


@dataclass(frozen=True)
class Field:
    """A field to survive. quality: int column, 2 for whole, 1 for present, 0 for missing; full: what counts among values of equal quality, source and time."""

    name: str
    quality: Column
    full: Column


def survivors(records: DataFrame, fields: list[Field], group: str, trust: Column, time: str, position: str) -> DataFrame:
    """One surviving row for each group, built field by field.

    For each field the value is that of the row with the greatest (quality, source trust, timestamp, fullness, lowest
    position), in one aggregation of the maximum of a composite struct. Results: the group, for each field its value,
    ``<field>_pos`` (the row it comes from; null if no row has a value) and ``<field>_whole`` (rows with a whole
    value; repeats count). Rows without group are no case. The maximum is combined before the shuffle, so a group that
    holds most of the rows costs one row for each task. Ties end at the position; nulls sort lowest.
    """
    def best(f: Field) -> Column:
        return F.max(F.struct(f.quality.alias("q"), trust.alias("s"), F.col(f"`{time}`").alias("t"), f.full.alias("l"), (-F.col(f"`{position}`")).alias("p"), F.col(f"`{f.name}`").alias("v")))

    rows = records.where(F.col(f"`{group}`").isNotNull())
    aggregates = [x for f in fields for x in (best(f).alias(f"_{f.name}"), F.count_if(f.quality == 2).alias(f"{f.name}_whole"))]
    found = rows.groupBy(F.col(f"`{group}`").alias(group)).agg(*aggregates)
    values = []
    for f in fields:
        b = F.col(f"_{f.name}")
        present = b["q"] > 0
        values += [F.when(present, b["v"]).alias(f.name), F.when(present, -b["p"]).alias(f"{f.name}_pos"), F.col(f"{f.name}_whole")]
    return found.select(group, *values)


def candidate_fields() -> list[Field]:
    """The fields of paper metadata. ``full_venue`` must be joined to the rows (see with_venues)."""
    urls = F.size(whole_addresses(F.col("candidate_pdf_urls")))
    quality = lambda c: F.when(is_whole_text(c), 2).when(~is_stand_in(c), 1).otherwise(0)
    return [
        Field("abstract", quality(F.col("abstract")), F.length(F.coalesce("abstract", F.lit("")))),
        Field("venue", F.when(F.col("full_venue").isNotNull(), 2).when(~is_stand_in(F.col("venue")), 1).otherwise(0), F.length(F.coalesce("venue", F.lit("")))),
        Field("candidate_pdf_urls", F.when(urls > 0, 2).otherwise(0), urls),
    ]


def venue_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(c), r"[\s\x{a0}]+", " "))


def with_venues(records: DataFrame, venues: DataFrame) -> DataFrame:
    """*records* with ``full_venue``, the name in the venue list that the row's venue is, but for case and blanks."""
    names = venues.select(venue_key(F.col("venue_name")).alias("_venue"), F.col("venue_name").alias("full_venue")).where("_venue != ''").groupBy("_venue").agg(F.min("full_venue").alias("full_venue"))
    return records.withColumn("_venue", venue_key(F.col("venue"))).join(small_side(names), "_venue", "left").drop("_venue")


def candidate_survivors(candidates: DataFrame, venues: DataFrame) -> DataFrame:
    """The surviving record of each ``dup_group`` of *candidates*.

    abstract, venue: the best value, with the row that it comes from. candidate_pdf_urls: the best row's count decides
    ``candidate_pdf_urls_pos``; the value holds all absolute addresses of the group, sorted. source_apis: all sources
    of the group, sorted. Missing arrays come
    out as empty ones. Values of the arrays are made distinct for each group before they are gathered, so that
    a hot group gathers its distinct addresses only.
    """
    rows = candidates.where("dup_group is not null").select("pos", "dup_group", "abstract", "venue", "candidate_pdf_urls", "source_apis", "loaded_at")
    rows = with_venues(rows, venues)
    best = survivors(rows, candidate_fields(), "dup_group", source_rank(F.col("source_apis")), "loaded_at", "pos")
    gathered = gather(rows.select("dup_group", F.explode(F.concat(
        F.transform(whole_addresses(F.col("candidate_pdf_urls")), lambda x: F.struct(F.lit("u").alias("k"), x.alias("v"))),
        F.transform(F.coalesce("source_apis", F.array().cast("array<string>")), lambda x: F.struct(F.lit("s").alias("k"), x.alias("v"))),
    )).alias("e")).select("dup_group", "e.k", "e.v"))
    empty = F.array().cast("array<string>")
    return best.drop("candidate_pdf_urls").join(gathered, "dup_group", "left").select(
        "dup_group", "abstract", "abstract_pos", "abstract_whole", "venue", "venue_pos", "venue_whole",
        F.coalesce("candidate_pdf_urls", empty).alias("candidate_pdf_urls"), "candidate_pdf_urls_pos", "candidate_pdf_urls_whole",
        F.coalesce("source_apis", empty).alias("source_apis"),
    )


def gather(values: DataFrame) -> DataFrame:
    """The distinct addresses (k = 'u') and sources (k = 's') of each group, sorted."""
    distinct = values.where("v is not null").distinct()
    return distinct.groupBy("dup_group").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") == "u", F.col("v")))).alias("candidate_pdf_urls"),
        F.array_sort(F.collect_list(F.when(F.col("k") == "s", F.col("v")))).alias("source_apis"),
    )


def sole_values(best: DataFrame, fields: list[str]) -> DataFrame:
    """``dup_group``, ``field`` and ``pos`` of the fields that exactly one row of a group has whole."""
    cases = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_whole").alias("n"), F.col(f"{f}_pos").alias("pos")) for f in fields])
    return best.select("dup_group", F.explode(cases).alias("c")).where("c.n = 1").select("dup_group", "c.field", "c.pos")
