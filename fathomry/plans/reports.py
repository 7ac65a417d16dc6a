"""Queries that reports are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import compare
from ..operators import reports as r
from ..tables import table
from .comparison import SERIES, SETS, sets
from .papers import CONTENT, DOI, TITLE
from .registry import query

_PEAKS = f"{SERIES}, m AS (SELECT category, max(jaccard) AS peak FROM series GROUP BY ALL), pk AS (SELECT s.category, min(k) AS k FROM series s JOIN m ON s.category = m.category AND s.jaccard = m.peak GROUP BY ALL)"
_FINAL = f"""WITH {SETS}{_PEAKS}, x AS (SELECT r1.* FROM r1 JOIN pk USING (category) WHERE rank <= k), y AS (SELECT r2.* FROM r2 JOIN pk USING (category) WHERE rank <= k),
u AS (SELECT coalesce(x.category, y.category) AS category, coalesce(x.name, y.name) AS name, CASE WHEN x.name IS NULL THEN 'set_2_only' WHEN y.name IS NULL THEN 'set_1_only' ELSE 'both' END AS membership, x.rank AS rank_1, y.rank AS rank_2, greatest(x.support, y.support) AS support FROM x FULL JOIN y ON x.category = y.category AND x.name = y.name),
f AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY support DESC NULLS LAST, CASE membership WHEN 'both' THEN 0 WHEN 'set_1_only' THEN 1 ELSE 2 END, name) AS final_rank FROM u)"""


@query("final_features", f"{_FINAL} SELECT * FROM f")
def final_features(spark, folder):
    a, b = sets(spark, folder)
    return r.final_set(a, b, compare.peaks(compare.jaccard_series(a, b, 1, 100)))


@query("features_of_one_set", f"{_FINAL} SELECT category, name, membership, support FROM f WHERE membership <> 'both' QUALIFY row_number() OVER (PARTITION BY membership ORDER BY support DESC NULLS LAST, category, name) <= 20")
def features_of_one_set(spark, folder):
    found = final_features(spark, folder).where("membership <> 'both'").select("category", "name", "membership", "support")
    order = [F.desc_nulls_last("support"), F.asc("category"), F.asc("name")]
    parts = [found.where(F.col("membership") == m).orderBy(*order).limit(20) for m in ("set_1_only", "set_2_only")]  # partial sorts, no window over all
    return parts[0].unionByName(parts[1])


@query("shared_supports", f"WITH {SETS} SELECT a.category, a.name, a.support AS support_1, b.support AS support_2 FROM r1 a JOIN r2 b ON a.category = b.category AND a.name = b.name WHERE a.rank <= 50 AND b.rank <= 50")
def shared_supports(spark, folder):
    a, b = sets(spark, folder)
    return r.shared_points(a, b, 50)


@query("similarity_ranks", """WITH p AS (SELECT similarity AS value FROM similarity_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity)), i AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM p),
g AS (SELECT value, count(*) AS rows, round(CASE WHEN min(n) > 1 THEN min(i) / (min(n) - 1)::DOUBLE * 100 ELSE 100 END, 6) AS percentile FROM i GROUP BY value) SELECT * FROM g WHERE percentile >= 50""")
def similarity_ranks(spark, folder):
    return r.percentile_series(table(spark, folder, "similarity_pairs").where("similarity is not null and not isnan(similarity)"), "similarity")


@query("statuses_of_year", "SELECT coalesce(year::VARCHAR, 'none') AS year, count(*) FILTER (WHERE status = 'converted') AS converted, count(*) FILTER (WHERE status = 'already_exists') AS already_exists, count(*) FILTER (WHERE status = 'no_text') AS no_text, count(*) FILTER (WHERE status IS NULL OR status NOT IN ('converted', 'already_exists', 'no_text')) AS other FROM papers GROUP BY ALL")
def statuses_of_year(spark, folder):
    return r.status_counts(table(spark, folder, "papers"), F.coalesce(F.col("year").cast("string"), F.lit("none")), "year", "status", ["converted", "already_exists", "no_text"])


@query("chunks_of_papers", "SELECT p.paper_id, count(c.chunk_id) AS chunks, coalesce(sum(c.token_count), 0)::BIGINT AS tokens FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL) p LEFT JOIN (SELECT DISTINCT paper_id, chunk_id, token_count FROM chunks) c USING (paper_id) GROUP BY ALL")
def chunks_of_papers(spark, folder):
    papers = table(spark, folder, "papers").select("paper_id").where("paper_id is not null").distinct()
    chunks = table(spark, folder, "chunks").select("paper_id", "chunk_id", "token_count").distinct()
    counted = chunks.groupBy("paper_id").agg(F.count("chunk_id").alias("chunks"), F.sum("token_count").alias("tokens"))
    return papers.join(counted, "paper_id", "left").fillna(0, ["chunks", "tokens"])


#: A citation of one author and a year, as "Name, 2016" in brackets.
CITED = r"\(([A-Z][a-z]+, [0-9]{4})\)"


@query("checked_citations", f"""WITH k AS (SELECT DISTINCT list_extract(string_split_regex(trim(authors[1]), '\\s+'), -1) || ', ' || year AS citation FROM papers WHERE authors[1] IS NOT NULL AND year IS NOT NULL), c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{CITED}', 1)) AS citation FROM documents),
n AS (SELECT doc_id, count(*) AS cited, count(*) FILTER (WHERE citation NOT IN (SELECT citation FROM k)) AS invalid FROM c GROUP BY ALL), u AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t\\n\\x0b\\f\\r]*\\n'), lambda p: length(p) > 280 AND NOT regexp_matches(p, '{CITED}'))) AS uncited FROM documents)
SELECT doc_id, uncited, coalesce(cited, 0) AS cited, coalesce(invalid, 0) AS invalid FROM u LEFT JOIN n USING (doc_id)""")
def checked_citations(spark, folder):
    first = F.trim(F.get("authors", F.lit(0)))
    known = table(spark, folder, "papers").where(first.isNotNull() & F.col("year").isNotNull()).select(F.concat(F.element_at(F.split(first, r"\s+"), -1), F.lit(", "), F.col("year").cast("string")).alias("citation"))
    return r.checked_citations(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", known, CITED)


@query("chunk_sections", """WITH l AS (SELECT pos, string_split(coalesce(text, ''), chr(10)) AS ls FROM chunks), e AS (SELECT pos, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), s AS (SELECT pos, line, sum(CASE WHEN regexp_matches(line, '^[ ]*[0-9]+\\. [A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY i) AS section FROM e)
SELECT pos, section::INT AS section, count(*) AS lines, sum(length(line))::BIGINT AS letters FROM s GROUP BY ALL""")
def chunk_sections(spark, folder):
    return r.grouped_lines(table(spark, folder, "chunks").select("pos", "text"), "pos", "text", r"^[ ]*[0-9]+\. [A-Z]")


STOPPED = ["PDF", "DOI", "URL", "HTTP", "ISBN"]


@query("domain_terms", """WITH t AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[^\\p{L}\\p{N}-]+') AS t FROM documents), w AS (SELECT doc_id, list_filter(t, lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]{1,9}') AND w NOT IN ('PDF', 'DOI', 'URL', 'HTTP', 'ISBN')) || list_filter(t, lambda w: regexp_full_match(w, '[a-z]+(-[a-z]+)+') AND length(w) > 5) AS ws FROM t),
e AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w) GROUP BY ALL), o AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM e GROUP BY ALL) SELECT doc_id, array_to_string(ws[1:30], '|') AS terms FROM o""")
def domain_terms(spark, folder):
    found = r.domain_terms(table(spark, folder, "documents"), "doc_id", "text", STOPPED)
    return found.where(F.size("terms") > 0).select("doc_id", F.array_join("terms", "|").alias("terms"))


_SURNAME = "nullif(list_extract(string_split({t}, ' '), -1), '')"
_SIDE = "SELECT DISTINCT {i} AS id, " + DOI + " AS doi, nullif(regexp_extract(lower(coalesce({c}, '')), '(^|arxiv[:.]?\\s*|abs/|pdf/)(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?', 2), '') AS arxiv, nullif({title}, '') AS title, {author} AS author, {year} AS year, list_distinct({words}) AS words FROM {table}"


@query("match_reasons", "WITH s AS (" + _SIDE.format(i="ref_id", c="cited_doi", title=TITLE.format(c="cited_title"), author=_SURNAME.format(t=TITLE.format(c="split_part(cited_authors, ',', 1)")), year="try_cast(cited_year AS INT)", words=CONTENT.format(c="cited_title"), table="cited_refs") + "), r AS (" + _SIDE.format(i="pos", c="doi", title=TITLE.format(c="title"), author=_SURNAME.format(t=TITLE.format(c="split_part(authors[1], ',', 1)")), year="year", words=CONTENT.format(c="title"), table="candidates") + """),
e AS (SELECT s.id AS seed, r.id AS result, 0 AS n FROM s JOIN r ON s.doi = r.doi UNION ALL SELECT s.id, r.id, 1 FROM s JOIN r ON s.arxiv = r.arxiv UNION ALL SELECT s.id, r.id, 2 FROM s JOIN r ON s.title = r.title
UNION ALL SELECT s.id, r.id, CASE WHEN s.year = r.year THEN 3 ELSE 4 END FROM s JOIN r ON s.author = r.author WHERE len(s.words) > 0 AND len(r.words) > 0 AND len(list_intersect(s.words, r.words)) / least(len(s.words), len(r.words))::DOUBLE >= 0.8),
m AS (SELECT seed, result, min(n) AS n FROM e GROUP BY ALL) SELECT seed, result, ['doi', 'arxiv', 'title', 'title_overlap_author_year', 'title_overlap_author'][n + 1] AS reason FROM m""")
def match_reasons(spark, folder):
    def side(rows, key, doi, title, authors, year):
        words = F.array_distinct(t.content_tokens(title))
        author = F.nullif(F.element_at(F.split(t.normalize_title(F.split_part(authors, F.lit(","), F.lit(1))), " "), -1), F.lit(""))
        return rows.select(F.col(key).alias("id"), t.normalize_doi(doi).alias("doi"), t.arxiv_id(doi).alias("arxiv"), F.nullif(t.normalize_title(title), F.lit("")).alias("title"), author.alias("author"), year.alias("year"), words.alias("words")).distinct()

    seeds = side(table(spark, folder, "cited_refs"), "ref_id", F.col("cited_doi"), F.col("cited_title"), F.col("cited_authors"), F.col("cited_year").try_cast("int"))
    results = side(table(spark, folder, "candidates"), "pos", F.col("doi"), F.col("title"), F.get("authors", F.lit(0)), F.col("year"))
    return r.match_reasons(seeds, results)


@query("relevant_papers", f"""WITH q AS (SELECT feature_id, list_distinct({CONTENT.format(c='canonical_feature_name')}) AS terms FROM expected_features), x AS (SELECT feature_id, len(terms) AS n, unnest(terms) AS w FROM q), c AS (SELECT DISTINCT pos, unnest({CONTENT.format(c="coalesce(title, '') || ' ' || coalesce(abstract, '')")}) AS w FROM candidates)
SELECT feature_id, pos FROM x JOIN c USING (w) GROUP BY feature_id, pos, n HAVING count(*) = n""")
def relevant_papers(spark, folder):
    """The papers whose words hold all content words of a feature's name: met by one word, counted, so no pair of all is made."""
    q = table(spark, folder, "expected_features").select("feature_id", F.array_distinct(t.content_tokens(F.col("canonical_feature_name"))).alias("terms"))
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    words = table(spark, folder, "candidates").select("pos", F.explode(F.array_distinct(t.content_tokens(body))).alias("w"))
    met = words.join(F.broadcast(q.select("feature_id", F.size("terms").alias("n"), F.explode("terms").alias("w"))), "w")  # the fixed reference list
    return met.groupBy("feature_id", "pos", "n").agg(F.count("*").alias("m")).where("m = n").select("feature_id", "pos")
