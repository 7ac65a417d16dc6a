"""Addresses in texts and pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as t

#: What the attributes of a tag that name a full text hold.
META_NAMES = ("citation_pdf_url", "bepress_citation_pdf_url", "eprints.document_url")
ATTRIBUTES = ("href", "src", "data", "content")


def clean_url(c: Column) -> Column:
    """An address without entities, escaped slashes, marks of quotation around it and punctuation behind it; null if nothing is left."""
    u = F.replace(F.replace(F.trim(c), F.lit("&amp;"), F.lit("&")), F.lit("\\u002f"), F.lit("/"))
    u = F.regexp_replace(F.replace(u, F.lit("\\/"), F.lit("/")), r"^[\"'<(]+|[\"'>).,;\]]+$", "")
    return F.nullif(u, F.lit(""))


def urls_in_text(c: Column) -> Column:
    """The http and https addresses of a text in order, without repeats."""
    found = F.regexp_extract_all(t.text_or_empty(c), F.lit(r"(?i)https?://[^\s\"'<>]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, clean_url), lambda u: u.isNotNull()))


class _Links(HTMLParser):
    """The addresses that a page's tags hold, in order; those of meta tags only if they name a full text."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k.lower(): v for k, v in attrs if v}
        if tag == "meta" and given.get("name", "").lower() not in META_NAMES:
            return
        self.found += [given[a] for a in ATTRIBUTES if a in given and (a != "content" or tag == "meta")]


def links_of(page: str | None, base: str | None) -> list[str]:
    """The absolute http and https addresses in a page, in order, those equal but for case once. Broken pages are read as far as they go."""
    parser = _Links()
    parser.feed(page or "")
    found: dict[str, str] = {}
    for link in parser.found:
        try:
            whole = urljoin(base or "", link.strip())
        except ValueError:
            continue
        if whole.lower().startswith(("http://", "https://")):
            found.setdefault(whole.lower(), whole)
    return list(found.values())


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([links_of(p, b) for p, b in zip(pages, bases, strict=True)], dtype=object)


def inferred_pdf(doi: Column, arxiv: Column) -> Column:
    """The address of the full text that an arXiv number, or a DOI of arXiv, tells."""
    number = F.coalesce(arxiv, F.nullif(F.regexp_extract(doi, r"^10\.48550/arxiv\.(.+)$", 1), F.lit("")))
    return F.concat(F.lit("https://arxiv.org/pdf/"), number, F.lit(".pdf"))
