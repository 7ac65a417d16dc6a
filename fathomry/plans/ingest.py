"""Queries over what comes in: answers of services, addresses, ledgers, cells, pages, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, links
from ..functions import text as t
from ..functions import values
from ..operators import curation as c
from ..operators import retrieval as ret
from ..sources import services as sv
from ..tables import table
from .papers import DOI, TITLE
from .registry import query

_LISTED = "list_filter(list_transform(coalesce(authors, []), lambda a: trim(a)), lambda a: a IS NOT NULL AND a <> '')"
_LINE = "array_to_string(list_filter(coalesce(authors, []), lambda a: a IS NOT NULL), '; ')"
_SPLIT = f"CASE WHEN contains({_LINE}, ';') THEN string_split({_LINE}, ';') ELSE string_split({_LINE}, ',') END"
_HTTP = "len(list_distinct(list_filter(coalesce(candidate_pdf_urls, []), lambda u: u IS NOT NULL AND regexp_matches(u, '(?i)^https?://'))))"


@query("service_candidates", f"""SELECT pos, 'works' AS service, title, array_to_string({_LISTED}, '|') AS authors, year, {DOI.format(c='doi')} AS doi, citation_count, {_HTTP} AS links FROM candidates
UNION ALL SELECT pos, 'papers', title, array_to_string({_LISTED}, '|'), year, {DOI.format(c='doi')}, citation_count, CASE WHEN regexp_matches(trim(candidate_pdf_urls[1]), '(?i)^https?://') THEN 1 ELSE 0 END FROM candidates
UNION ALL SELECT pos, 'registered', title, array_to_string({_LISTED}, '|'), year, {DOI.format(c='doi')}, citation_count, {_HTTP} FROM candidates
UNION ALL SELECT pos, 'results', regexp_replace(title, '\\.$', ''), array_to_string(list_filter(list_transform({_SPLIT}, lambda a: regexp_replace(trim(a), '\\.$', '')), lambda a: a <> ''), '|'), year, {DOI.format(c='doi')}, citation_count, {_HTTP} FROM candidates""")
def service_candidates(spark, folder):
    """The candidates written as each service answers, and read back."""
    rows = table(spark, folder, "candidates").select("pos", "title", "year", "doi", "citation_count", "landing_page_url", F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("authors"), F.coalesce("candidate_pdf_urls", F.array().cast("array<string>")).alias("urls"))
    work = F.struct(F.col("title").alias("display_name"), F.col("year").alias("publication_year"), "doi", F.col("citation_count").alias("cited_by_count"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct("landing_page_url").alias("primary_location"), F.transform("urls", lambda u: F.struct(u.alias("pdf_url"))).alias("locations"))
    paper = F.struct("title", "year", F.col("citation_count").alias("citationCount"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.create_map(F.lit("DOI"), "doi").alias("externalIds"), F.struct(F.get("urls", F.lit(0)).alias("url")).alias("openAccessPdf"), F.col("landing_page_url").alias("url"))
    registered = F.struct(F.array("title").alias("title"), F.col("doi").alias("DOI"), F.col("landing_page_url").alias("URL"), F.col("citation_count").alias("is-referenced-by-count"), F.transform("authors", lambda a: F.struct(a.alias("family"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.transform("urls", lambda u: F.struct(u.alias("URL"), F.lit("application/pdf").alias("content-type"))).alias("link"))
    result = F.struct("title", F.col("year").cast("string").alias("pubYear"), "doi", F.col("citation_count").alias("citedByCount"), F.array_join("authors", "; ").alias("authorString"), F.struct(F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit("pdf").alias("documentStyle"))).alias("fullTextUrl")).alias("fullTextUrlList"))
    found = None
    for name, made, read in (("works", work, sv.from_works), ("papers", paper, sv.from_papers), ("registered", registered, sv.from_registered), ("results", result, sv.from_results)):
        one = read(rows.select("pos", F.to_json(made).alias("answer")), "answer", ["pos"])
        http = F.array_distinct(F.filter("candidate_pdf_urls", lambda u: u.rlike("(?i)^https?://")))
        names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
        one = one.select("pos", F.lit(name).alias("service"), "title", F.array_join(names, "|").alias("authors"), "year", "doi", "citation_count", F.coalesce(F.size(http), F.lit(0)).alias("links"))
        found = one if found is None else found.unionByName(one)
    return found


@query("page_links", """WITH u AS (SELECT pos, landing_page_url AS base, unnest(candidate_pdf_urls) AS u FROM candidates), a AS (SELECT pos, CASE WHEN regexp_matches(trim(u), '(?i)^https?://') THEN trim(u) WHEN starts_with(trim(u), '/') AND base IS NOT NULL THEN regexp_extract(base, '^(?i)https?://[^/?#]+') || trim(u) END AS link FROM u)
SELECT DISTINCT pos, link FROM a WHERE regexp_matches(link, '(?i)^https?://') AND regexp_matches(lower(link), '^https?://[^?#]*(\\.pdf|/pdf)($|[/?#])|[?&][^#]*(pdf|download)[^#]*')""")
def page_links(spark, folder):
    """The addresses of full texts in pages that name the candidates' addresses."""
    rows = table(spark, folder, "candidates").select("pos", "landing_page_url", F.filter(F.coalesce("candidate_pdf_urls", F.array().cast("array<string>")), lambda u: u.isNotNull()).alias("urls"))
    page = F.concat(F.lit("<html><body><p>"), F.array_join(F.transform("urls", lambda u: F.concat(F.lit('<a href="'), u, F.lit('">full</a>'))), " "), F.lit("</body>"))
    found = rows.select("pos", F.explode(links.page_links(page, F.col("landing_page_url"))).alias("link"))
    return found.where(t.looks_like_pdf(F.col("link"))).distinct()


@query("text_links", """SELECT DISTINCT doc_id, link FROM (SELECT doc_id, regexp_replace(replace(unnest(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\\s"''<>]+')), '&amp;', '&'), '["''>).,;\\]]+$', '') AS link FROM documents) WHERE link <> ''""")
def text_links(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(links.urls_in_text(F.col("text"))).alias("link")).distinct()


_CELL = "trim(matching_aliases)"


@query("inventory_cells", f"""WITH i AS (SELECT DISTINCT feature_id, matching_aliases FROM inventory_rows), l AS (SELECT feature_id, CASE WHEN coalesce({_CELL}, '') = '' THEN [] WHEN starts_with({_CELL}, '[') AND json_valid({_CELL}) THEN list_filter(from_json({_CELL}, '["VARCHAR"]'), lambda x: x IS NOT NULL) ELSE [{_CELL}] END AS v FROM i)
SELECT feature_id, len(v) AS n, array_to_string(list_transform(v[1:6], lambda x: x[1:40]), '|') AS shown FROM l""")
def inventory_cells(spark, folder):
    rows = table(spark, folder, "inventory_rows").select("feature_id", "matching_aliases").distinct().withColumn("v", cells.listed(F.col("matching_aliases")))
    return rows.select("feature_id", F.size("v").alias("n"), F.array_join(cells.compact(F.col("v"), 6, 40), "|").alias("shown"))


_SLUG = "regexp_replace(substr(replace({t}, ' ', '_'), 1, {n}), '^_+|_+$', '', 'g')"


@query("paper_ids", f"""WITH p AS (SELECT pos, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title FROM candidates), i AS (SELECT pos, {_SLUG.format(t='title', n=48)} || '_' || substr(sha1(coalesce(doi, title)), 1, 8) AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS k FROM i) SELECT pos, base, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS unique_key FROM n""")
def paper_ids(spark, folder):
    p = table(spark, folder, "candidates").select("pos", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"))
    base = F.concat(t.slug(F.col("title"), 48), F.lit("_"), values.short_hash(F.coalesce("doi", "title"), 8))
    return c.retain_unseen(p.select("pos", base.alias("base")), "base", "pos").select("pos", "base", "unique_key")


@query("bibliography", f"""WITH p AS (SELECT pos, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title, regexp_replace(coalesce(title, ''), '[{{}}]', '', 'g') AS shown, year, regexp_replace(lower(coalesce(authors[1], '')), '[^a-z]+', '', 'g') AS who FROM candidates),
k AS (SELECT *, coalesce(nullif(who, ''), 'unknown') || coalesce(year::VARCHAR, 'nd') || split_part(title, ' ', 1) || substr(sha1(coalesce(doi, title)), 1, 6) AS key FROM p)
SELECT pos, '@article{{' || key || ',' || chr(10) || '  title = {{' || shown || '}}' || CASE WHEN year IS NULL THEN '' ELSE ',' || chr(10) || '  year = {{' || year || '}}' END || CASE WHEN doi IS NULL THEN '' ELSE ',' || chr(10) || '  doi = {{' || doi || '}}' END || chr(10) || '}}' AS entry FROM k""")
def bibliography(spark, folder):
    p = table(spark, folder, "candidates").select("pos", "year", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("key_title"), F.regexp_replace(F.coalesce("title", F.lit("")), "[{}]", "").alias("title"), F.regexp_replace(F.lower(F.coalesce(F.get("authors", F.lit(0)), F.lit(""))), "[^a-z]+", "").alias("who"))
    key = F.concat(F.coalesce(F.nullif("who", F.lit("")), F.lit("unknown")), F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.split_part("key_title", F.lit(" "), F.lit(1)), values.short_hash(F.coalesce("doi", "key_title"), 6))
    lines = [F.when(F.col(x).isNotNull(), F.concat(F.lit(f"  {x} = {{"), F.col(x).cast("string"), F.lit("}"))) for x in ("title", "year", "doi")]
    return p.select("pos", F.concat(F.lit("@article{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("entry"))


@query("ledger_rows", f"""WITH p AS (SELECT DISTINCT paper_id, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title, year, status, converted_at FROM papers), i AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN title <> '' THEN 'title:' || title || '|year:' || coalesce(year::VARCHAR, '') END AS identity FROM p),
l AS (SELECT identity, status, converted_at, paper_id FROM i WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identity ORDER BY converted_at DESC NULLS LAST, paper_id DESC, status DESC) = 1)
SELECT identity, paper_id, status, CASE WHEN status IN ('converted', 'already_exists') THEN 'saved' WHEN status = 'no_text' THEN 'failed' ELSE 'pending' END AS outcome, coalesce(status NOT IN ('converted', 'already_exists'), true) AS retry FROM l""")
def ledger_rows(spark, folder):
    from ..operators import features as f

    p = table(spark, folder, "papers").select("paper_id", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"), "year", "status", "converted_at").distinct()
    identity = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi")).when(F.col("title") != "", F.concat(F.lit("title:"), "title", F.lit("|year:"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    latest = f.last_rows(p.select(identity.alias("identity"), "status", "converted_at", "paper_id"), ["identity"], ["converted_at", "paper_id", "status"])
    saved = F.col("status").isin("converted", "already_exists")
    return latest.select("identity", "paper_id", "status", F.when(saved, "saved").when(F.col("status") == "no_text", "failed").otherwise("pending").alias("outcome"), F.coalesce(~saved, F.lit(True)).alias("retry"))


@query("page_chunks", """WITH w AS (SELECT paper_id, chunk_id, coalesce(pages[1], 0) AS page, list_filter(string_split_regex(trim(regexp_replace(coalesce(text,''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT paper_id, chunk_id, pages, text FROM chunks)), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 60 THEN 1 ELSE ceil((len(w)-60)/50.0)::INT + 1 END AS k FROM w),
c AS (SELECT paper_id, chunk_id, page, i, w[i*50+1 : i*50+60] AS c FROM (SELECT *, unnest(range(0, k)) AS i FROM n)) SELECT chunk_id, paper_id || ':p' || page || ':c' || i AS piece, page, len(c)::INT AS words FROM c WHERE len(c) >= 20""")
def page_chunks(spark, folder):
    d = table(spark, folder, "chunks").select("paper_id", "chunk_id", F.coalesce(F.get("pages", F.lit(0)), F.lit(0)).alias("page"), "text").distinct()
    return ret.page_chunks(d, "paper_id", "page", ["chunk_id"], "text", 60, 10, 20).select("chunk_id", "piece", "page", "words")
