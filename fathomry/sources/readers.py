"""Reading what the pipeline is fed with, as tables with explicit types and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Names under which a JSON document holds its rows.
ENVELOPES = ("features", "rows", "items", "data", "candidates", "papers", "records")

CANDIDATE = """candidate_id string, title string, authors array<string>, year int, doi string, abstract string, venue string,
landing_page_url string, source_apis array<string>, source_ids map<string,string>, candidate_pdf_urls array<string>,
candidate_landing_page_urls array<string>, relevance_score double, source_score double, citation_count long, matched_keywords array<string>"""
CHUNK = "chunk_id string, paper_id string, title string, year int, pages array<int>, text string, token_count int"
MENTION = """paper_id string, title string, authors array<string>, year int, doi string, venue string, category string, feature_name string,
normalized_feature_name string, parent_category string, definition string, synonyms array<string>, examples array<string>, evidence_type string,
chunk_id string, pages array<int>, snippet string, source_quote string, confidence double, notes string, model string, run_id string, extracted_at string"""


def positioned(df: DataFrame) -> DataFrame:
    """*df* with ``pos``, the place of a row in its files: file by file, in the order of lines.

    Places are increasing, not dense, so no task has to wait for another.
    """
    return df.withColumn("pos", F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, schema: str, bad: str | None = None) -> DataFrame:
    """Rows of JSON lines. Lines that don't parse have only nulls, and their text in the column *bad* if one is named."""
    full = f"{schema}, {bad} string" if bad else schema
    reader = spark.read.schema(full)
    if bad:
        reader = reader.option("columnNameOfCorruptRecord", bad)
    return positioned(reader.json(path))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of whole-file JSON documents: a list, or an object that holds a list under one of the known names.

    A document is read as one row in one task, so it should have no more than some hundred MB; larger tables belong in
    JSON lines.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    rows = f"array<struct<{', '.join(_typed(schema))}>>"
    lists = F.when(F.col("value").startswith("["), F.from_json("value", rows))
    held = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{name}"), rows) for name in ENVELOPES])
    return raw.select("file", F.posexplode(F.coalesce(lists, held)).alias("pos", "_row")).select("file", "pos", "_row.*")


def _typed(schema: str) -> list[str]:
    """The fields of a schema text as ``name: type``."""
    from pyspark.sql.types import StructType

    return [f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields]


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with header, all its columns as text; those of *columns* that it lacks are null, others are left out."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return positioned(found.select(*[F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns]))


def markdown_papers(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as pages: ``file``, ``title`` (the first heading), ``page`` (null without page headings), ``text``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), text.clean_text(F.col("value")).alias("value"))
    title = F.nullif(F.trim(F.regexp_extract(text.without_front_matter(F.col("value")), r"(?m)^#+[ \t]+(.+)$", 1)), F.lit(""))
    return raw.select("file", title.alias("title"), F.explode(text.pages_of(F.col("value"))).alias("p")).select("file", "title", "p.page", "p.text")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with what their first bytes say they are: ``path``, ``length``, ``kind`` (pdf, html or other), ``content``."""
    raw = spark.read.format("binaryFile").load(path)
    begin = F.lower(F.decode(F.substring("content", 1, 512), "ISO-8859-1"))
    kind = F.when(begin.startswith("%pdf-"), "pdf").when(begin.rlike(r"^\s*(?:<!doctype html|<html)"), "html").otherwise("other")
    return raw.select("path", "length", kind.alias("kind"), "content")


def inverted_abstract(index: str | object):
    """The text of an inverted index (word to positions), as a column expression: words in the order of their positions."""
    c = F.col(index) if isinstance(index, str) else index
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
