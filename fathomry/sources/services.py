"""What literature services answer, as JSON, projected to candidates. Nothing here reads from a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .readers import inverted_abstract

#: The parts of an answer that are read, by service.
WORK = """display_name string, title string, publication_year int, doi string, cited_by_count long, abstract_inverted_index map<string, array<int>>,
authorships array<struct<author: struct<display_name: string>>>, primary_location struct<landing_page_url: string, pdf_url: string, source: struct<display_name: string>>,
locations array<struct<landing_page_url: string, pdf_url: string>>"""
PAPER = """title string, year int, abstract string, venue string, url string, citationCount long, authors array<struct<name: string>>,
externalIds map<string, string>, openAccessPdf struct<url: string>"""
REGISTERED = """title array<string>, DOI string, abstract string, `container-title` array<string>, URL string, `is-referenced-by-count` long,
author array<struct<given: string, family: string>>, issued struct<`date-parts`: array<array<int>>>, link array<struct<URL: string, `content-type`: string>>"""
RESULT = """title string, pubYear string, doi string, abstractText string, journalTitle string, authorString string, citedByCount long, pmcid string,
fullTextUrlList struct<fullTextUrl: array<struct<url: string, documentStyle: string>>>"""

COLUMNS = ["title", "authors", "year", "doi", "abstract", "venue", "landing_page_url", "candidate_pdf_urls", "citation_count"]


def _none() -> Column:
    return F.lit(None).cast("string")


def urls(*given: Column) -> Column:
    """The http and https addresses given, in order, those equal but for case once."""
    held = F.filter(F.array(*[F.trim(g) for g in given]), lambda u: u.isNotNull() & u.rlike("(?i)^https?://"))
    return F.aggregate(held, F.array().cast("array<string>"), lambda seen, u: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(u)), seen).otherwise(F.array_append(seen, u)))


def first_date_year(parts: Column) -> Column:
    """The year in nested date parts."""
    return F.try_element_at(F.try_element_at(parts, F.lit(1)), F.lit(1)).try_cast("int")


def authors_of_line(line: Column) -> Column:
    """The authors in one text, separated by semicolons, or by commas if there are none."""
    parts = F.when(F.contains(line, F.lit(";")), F.split(line, ";")).otherwise(F.split(line, ","))
    return F.filter(F.transform(parts, lambda a: F.regexp_replace(F.trim(a), r"\.$", "")), lambda a: a != "")


def _named(**columns: Column) -> list[Column]:
    return [columns[c].alias(c) for c in COLUMNS]


def from_works(answers: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Works with locations and inverted abstracts."""
    w = answers.select(*keep, F.from_json(json, WORK).alias("w")).select(*keep, "w.*")
    pdfs = F.transform(F.coalesce("locations", F.array()), lambda x: x["pdf_url"])
    every = F.concat(F.array("primary_location.pdf_url"), pdfs)
    links = F.array_distinct(F.filter(every, lambda u: u.isNotNull() & u.rlike("(?i)^https?://")))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda a: a.isNotNull())
    return w.select(*keep, *_named(title=F.coalesce("display_name", "title"), authors=names, year=F.col("publication_year"), doi=t.normalize_doi(F.col("doi")), abstract=F.nullif(inverted_abstract("abstract_inverted_index"), F.lit("")), venue=F.col("primary_location.source.display_name"), landing_page_url=F.col("primary_location.landing_page_url"), candidate_pdf_urls=links, citation_count=F.col("cited_by_count")))


def from_papers(answers: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Papers with a map of identifiers."""
    p = answers.select(*keep, F.from_json(json, PAPER).alias("p")).select(*keep, "p.*")
    arxiv = F.try_element_at("externalIds", F.lit("ArXiv"))
    links = urls(F.col("openAccessPdf.url"), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")))
    return p.select(*keep, *_named(title=F.col("title"), authors=F.transform("authors", lambda a: a["name"]), year=F.col("year"), doi=t.normalize_doi(F.try_element_at("externalIds", F.lit("DOI"))), abstract=F.col("abstract"), venue=F.col("venue"), landing_page_url=F.col("url"), candidate_pdf_urls=links, citation_count=F.col("citationCount")))


def from_registered(answers: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Registered works: titles as lists, dates in parts, links with their content type, abstracts with tags."""
    r = answers.select(*keep, F.from_json(json, REGISTERED).alias("r")).select(*keep, "r.*")
    names = F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    links = F.transform(F.filter(F.coalesce("link", F.array()), lambda x: (x["content-type"] == "application/pdf") | t.looks_like_pdf(x["URL"])), lambda x: x["URL"])
    return r.select(*keep, *_named(title=F.try_element_at("title", F.lit(1)), authors=F.filter(names, lambda a: a != ""), year=first_date_year(F.col("issued.date-parts")), doi=t.normalize_doi(F.col("DOI")), abstract=t.strip_markup(F.col("abstract")), venue=F.try_element_at(F.col("container-title"), F.lit(1)), landing_page_url=F.col("URL"), candidate_pdf_urls=F.array_distinct(links), citation_count=F.col("is-referenced-by-count")))


def from_results(answers: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Results with authors in one line and full texts with their style."""
    r = answers.select(*keep, F.from_json(json, RESULT).alias("r")).select(*keep, "r.*")
    full = F.coalesce(F.col("fullTextUrlList.fullTextUrl"), F.array())
    links = F.transform(F.filter(full, lambda x: F.lower(x["documentStyle"]) == "pdf"), lambda x: x["url"])
    page = F.transform(F.filter(full, lambda x: F.lower(x["documentStyle"]) != "pdf"), lambda x: x["url"])
    return r.select(*keep, *_named(title=F.regexp_replace("title", r"\.$", ""), authors=F.coalesce(authors_of_line(F.col("authorString")), F.array().cast("array<string>")), year=F.col("pubYear").try_cast("int"), doi=t.normalize_doi(F.col("doi")), abstract=t.strip_markup(F.col("abstractText")), venue=F.col("journalTitle"), landing_page_url=F.try_element_at(page, F.lit(1)), candidate_pdf_urls=F.array_distinct(links), citation_count=F.col("citedByCount")))
