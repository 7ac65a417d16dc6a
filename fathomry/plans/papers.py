"""Queries over paper metadata, chunks, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values
from ..operators import features as f
from ..operators import ledger as led
from ..operators import resolve as res
from ..operators import retrieval as ret
from ..shared import small_side
from ..tables import table
from .registry import query

DOI = "nullif(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(coalesce({c},''))), '^(https?://)?(dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')), '\\.+$', ''), '')"
MARKUP = "regexp_replace(coalesce({c},''), '<[^>]+>', ' ', 'g')"
TITLE = "trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(" + MARKUP + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower(coalesce({c},'')), '[a-z][a-z0-9]*(?:[-''][a-z0-9]+)*')"
STOP = "[" + ",".join(f"'{w}'" for w in t.STOP_WORDS) + "]"
CONTENT = "list_filter(" + TOKENS + ", lambda w: length(w) > 2 AND NOT list_contains(" + STOP + ", w))"


@query("paper_identity", f"""WITH c AS (SELECT pos, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title, year FROM candidates), i AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'title:' || title || '|year:' || coalesce(year::VARCHAR, '') END AS identity FROM c)
SELECT pos, identity, 'paper_' || substr(sha1(identity), 1, 16) AS candidate_id, coalesce(year::VARCHAR, 'nd') || '_' || regexp_replace(substr(replace(title, ' ', '_'), 1, 48), '^_+|_+$', '', 'g') || '_' || substr(sha1(identity), 1, 10) || '.pdf' AS file_name FROM i""")
def paper_identity(spark, folder):
    c = table(spark, folder, "candidates").select("pos", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"), "year")
    identity = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi")).otherwise(F.concat(F.lit("title:"), "title", F.lit("|year:"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    named = c.withColumn("identity", identity)
    name = F.concat(F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("_"), t.slug(F.col("title"), 48), F.lit("_"), values.short_hash(F.col("identity"), 10), F.lit(".pdf"))
    return named.select("pos", "identity", F.concat(F.lit("paper_"), values.short_hash(F.col("identity"))).alias("candidate_id"), name.alias("file_name"))


@query("papers_in_years", "SELECT pos, year, year IS NULL AS undated FROM candidates WHERE year IS NULL OR year BETWEEN 2000 AND 2015")
def papers_in_years(spark, folder):
    return table(spark, folder, "candidates").where(F.col("year").isNull() | F.col("year").between(2000, 2015)).select("pos", "year", F.col("year").isNull().alias("undated"))


#: A subject to rank titles by, and what speaks against it.
SUBJECT = [(r"\bmoral\w*\b", 6), (r"\bpersuasi\w*\b", 5), (r"\bcorpus\b", 3), (r"\bpanel stud(?:y|ies)\b", 3), (r"\bfairness\b", 2), (r"\bwarnings?\b", 2)]
BESIDE = [(r"\bpreface\b", 4), (r"\berratum\b", 4)]


@query("paper_title_rank", "WITH s AS (SELECT pos, greatest(" + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(title,'')), '{p}') THEN {w} ELSE 0 END" for p, w in SUBJECT) + " - (" + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(title,'')), '{p}') THEN {w} ELSE 0 END" for p, w in BESIDE) + "), 0)::DOUBLE AS score FROM candidates) SELECT pos, score FROM s WHERE score > 0")
def paper_title_rank(spark, folder):
    return table(spark, folder, "candidates").select("pos", res.title_score(F.col("title"), SUBJECT, BESIDE).alias("score")).where("score > 0")


@query("paper_rank", f"""WITH v AS (SELECT list_distinct({CONTENT.format(c="'persuasion framing moral emotion audiences argument narrative authority warnings fairness'")}) AS terms),
w AS (SELECT pos, list_distinct({CONTENT.format(c='title')}) AS tt, list_distinct({CONTENT.format(c="coalesce(title,'') || ' ' || coalesce(abstract,'')")}) AS st, relevance_score, citation_count, year, doi, len(coalesce(candidate_pdf_urls, [])) > 0 AS url FROM candidates),
s AS (SELECT pos, 0.55*len(list_intersect(tt, terms))/greatest(1, least(len(terms), len(tt)))::DOUBLE + 0.35*len(list_intersect(st, terms))/greatest(1, least(len(terms), len(st)))::DOUBLE
 + least(ln(1+greatest(CASE WHEN isnan(relevance_score) THEN 0 ELSE coalesce(relevance_score,0) END,0))/10, 0.2) + least(log10(coalesce(citation_count,0)+1)/20, 0.15) + coalesce(greatest(0, 0.08-0.005*greatest(2025-year,0)), 0) + CASE WHEN url THEN 0.1 ELSE 0 END + CASE WHEN {DOI.format(c='doi')} IS NOT NULL THEN 0.03 ELSE 0 END AS score FROM w, v)
SELECT pos, round(score, 5) AS score FROM s""")
def paper_rank(spark, folder):
    terms = F.array_distinct(t.content_tokens(F.lit("persuasion framing moral emotion audiences argument narrative authority warnings fairness")))
    c = table(spark, folder, "candidates")
    w = c.select("pos", "citation_count", "year", terms.alias("terms"), F.array_distinct(t.content_tokens(F.col("title"))).alias("tt"), F.array_distinct(t.content_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))).alias("st"), values.number(F.col("relevance_score")).alias("own"), (F.coalesce(F.size("candidate_pdf_urls"), F.lit(0)) > 0).alias("url"), t.normalize_doi(F.col("doi")).isNotNull().alias("has_doi"))
    part = lambda c: F.size(F.array_intersect(c, "terms")) / F.greatest(F.lit(1), F.least(F.size("terms"), F.size(c)))
    score = 0.55 * part("tt") + 0.35 * part("st") + res.metadata_score(F.col("own"), F.col("citation_count"), F.col("year"), F.col("url"), F.col("has_doi"), 2025)
    return w.select("pos", F.round(score, 5).alias("score"))


@query("paper_statuses", f"""WITH p AS (SELECT paper_id, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title, status, converted_at FROM papers),
d AS (SELECT doi, status FROM p WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY converted_at DESC NULLS LAST, paper_id DESC) = 1), n AS (SELECT title, status FROM p WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY converted_at DESC NULLS LAST, paper_id DESC) = 1)
SELECT c.pos, coalesce(d.status, n.status, 'pending') AS status FROM (SELECT pos, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title FROM candidates) c LEFT JOIN d ON c.doi = d.doi LEFT JOIN n ON c.title = n.title""")
def paper_statuses(spark, folder):
    c = table(spark, folder, "candidates").select("pos", t.normalize_doi(F.col("doi")).alias("own_doi"), t.normalize_title(F.col("title")).alias("own_title"))
    p = table(spark, folder, "papers").select("paper_id", "status", "converted_at", t.normalize_doi(F.col("doi")).alias("doi"), F.nullif(t.normalize_title(F.col("title")), F.lit("")).alias("title"))
    keys = [(F.col("own_doi"), F.col("doi")), (F.col("own_title"), F.col("title"))]
    return led.overlay(c, p, keys, "status", F.struct("converted_at", "paper_id"), "pending").select("pos", "status")


@query("papers_remaining", f"""WITH p AS (SELECT {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title FROM papers WHERE status IN ('converted', 'already_exists'))
SELECT pos FROM (SELECT pos, {DOI.format(c='doi')} AS doi, {TITLE.format(c='title')} AS title FROM candidates) c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doi = c.doi) AND NOT EXISTS (SELECT 1 FROM p WHERE p.title = c.title)""")
def papers_remaining(spark, folder):
    c = table(spark, folder, "candidates").select("pos", t.normalize_doi(F.col("doi")).alias("own_doi"), t.normalize_title(F.col("title")).alias("own_title"))
    p = table(spark, folder, "papers").where(F.col("status").isin("converted", "already_exists")).select(t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"))
    return led.remaining(c, p, [(F.col("own_doi"), F.col("doi")), (F.col("own_title"), F.col("title"))]).select("pos")


SERVICES = "CASE WHEN len(list_filter(coalesce(source_apis, []), lambda s: s IS NOT NULL AND s <> '')) = 0 THEN ['unknown'] ELSE list_sort(list_distinct(list_filter(source_apis, lambda s: s IS NOT NULL AND s <> ''))) END"


@query("service_summary", f"""WITH e AS (SELECT unnest({SERVICES}) AS service, abstract IS NOT NULL AND trim(abstract) <> '' AS has_abstract, {DOI.format(c='doi')} IS NOT NULL AS has_doi, coalesce(citation_count, 0) > 0 AS cited FROM candidates)
SELECT service, count(*) AS total, count(*) FILTER (WHERE has_abstract) AS with_abstract, count(*) FILTER (WHERE has_doi) AS with_doi, count(*) FILTER (WHERE cited) AS cited FROM e GROUP BY ALL""")
def service_summary(spark, folder):
    outcomes = {"with_abstract": F.coalesce(F.trim("abstract") != "", F.lit(False)), "with_doi": t.normalize_doi(F.col("doi")).isNotNull(), "cited": F.coalesce("citation_count", F.lit(0)) > 0}
    return led.service_summary(table(spark, folder, "candidates"), F.col("source_apis"), outcomes)


@query("service_combinations", f"SELECT array_to_string({SERVICES}, '+') AS combination, count(*) AS total FROM candidates GROUP BY ALL")
def service_combinations(spark, folder):
    return led.service_combinations(table(spark, folder, "candidates"), F.col("source_apis"))


@query("status_of_venue", "SELECT coalesce(v.venue_name, 'none') AS venue, count(*) FILTER (WHERE status = 'converted') AS converted, count(*) FILTER (WHERE status = 'already_exists') AS already_exists, count(*) FILTER (WHERE status = 'no_text') AS no_text FROM papers p LEFT JOIN venues v USING (venue_id) GROUP BY ALL")
def status_of_venue(spark, folder):
    p = table(spark, folder, "papers").join(small_side(table(spark, folder, "venues").select("venue_id", "venue_name")), "venue_id", "left")
    return p.groupBy(F.coalesce("venue_name", F.lit("none")).alias("venue")).pivot("status", ["converted", "already_exists", "no_text"]).count().fillna(0)


@query("resolved_papers")
def resolved_papers(spark, folder):
    c = table(spark, folder, "candidates")
    held = res.paper_keys(c, "pos", F.col("doi"), [F.col("landing_page_url"), F.array_join("candidate_pdf_urls", " ")], F.col("title"), F.col("year"), F.get("authors", F.lit(0)))
    groups = res.groups_of_keys(c, "pos", held)
    return res.merged_records(c.select("pos", "title", "doi", "year", "venue", "abstract", "citation_count", "source_apis"), groups, "pos", ["title", "doi", "year", "venue"], ["abstract"], ["citation_count"], ["source_apis"])


@query("top_terms_of_language", f"""WITH w AS (SELECT lang, doc_id, unnest({CONTENT.format(c='text')}) AS term FROM documents WHERE lang IS NOT NULL), d AS (SELECT lang, doc_id, term, count(*) AS m FROM w GROUP BY ALL), c AS (SELECT lang, term, count(*) AS documents, sum(m)::BIGINT AS mentions FROM d GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY documents DESC, mentions DESC, term) AS rank FROM c QUALIFY rank <= 20""")
def top_terms_of_language(spark, folder):
    return ret.top_terms(table(spark, folder, "documents"), "lang", "doc_id", "text", 20)


@query("keyword_ngrams", f"""WITH d AS (SELECT {CONTENT.format(c='text')} AS w FROM documents), g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS phrase FROM d, (SELECT unnest([1,2,3,4]) AS n) WHERE len(w) >= n),
c AS (SELECT n, phrase, count(*) AS occurrences FROM g GROUP BY ALL), s AS (SELECT CASE WHEN n = 1 THEN 'keyword' ELSE 'phrase' END AS kind, phrase, occurrences, round(occurrences * (1.0 + (n-1)*0.35) + CASE WHEN n > 1 THEN 0.5 ELSE 0 END, 4)::DOUBLE AS score FROM c WHERE n = 1 OR len(list_distinct(string_split(phrase, ' '))) > 1)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY score DESC, phrase) AS rank, phrase, occurrences, score FROM s QUALIFY rank <= 30""")
def keyword_ngrams(spark, folder):
    return ret.keyword_ngrams(table(spark, folder, "documents"), "text", 4, 30)


@query("document_windows", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(coalesce(text,''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 60 THEN 1 ELSE ceil((len(w)-60)/50.0)::INT + 1 END AS k FROM w),
c AS (SELECT doc_id, i AS chunk_index, w[i*50+1 : i*50+60] AS c FROM (SELECT *, unnest(range(0, k)) AS i FROM n)) SELECT doc_id, chunk_index::INT AS chunk_index, len(c)::INT AS words, md5(array_to_string(c, ' ')) AS digest FROM c WHERE len(c) >= 20""")
def document_windows(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return ret.chunk_words(d, "doc_id", "text", 60, 10, 20).select("doc_id", "chunk_index", "words", F.md5("text").alias("digest"))


SEARCH = f"""q AS (SELECT feature_id AS q, list_distinct({TOKENS.format(c='canonical_feature_name')})[1:14] AS terms FROM expected_features), qt AS (SELECT q, unnest(terms) AS term FROM q),
c AS (SELECT pos, {TOKENS.format(c="coalesce(title,'') || ' ' || coalesce(text,'')")} AS w FROM chunks), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM c), p AS (SELECT pos, len(w) AS length, unnest(w) AS term FROM c), tf AS (SELECT pos, length, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), sc AS (SELECT qt.q, tf.pos, round(sum(greatest(ln((n-df+0.5)/(df+0.5)), 1e-6) * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*length/mean))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY ALL)"""


@query("search_chunks", f"WITH {SEARCH} SELECT q AS feature_id, pos, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM sc QUALIFY rank <= 10")
def search_chunks(spark, folder):
    c = table(spark, folder, "chunks").select("pos", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    return ret.bm25(c, table(spark, folder, "expected_features"), "pos", "text", "feature_id", "canonical_feature_name", 10)


@query("search_evidence", f"WITH {SEARCH}, r AS (SELECT q, pos, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM sc QUALIFY rank <= 6), w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pos ORDER BY q, rank) = 1) SELECT q AS feature_id, pos, rank, score FROM w ORDER BY q, rank, pos LIMIT 30")
def search_evidence(spark, folder):
    c = table(spark, folder, "chunks").select("pos", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    found = ret.bm25(c, table(spark, folder, "expected_features"), "pos", "text", "feature_id", "canonical_feature_name", 6)
    return ret.evidence(found, "feature_id", "pos", 30).select("feature_id", "pos", "rank", "score")


@query("search_by_counts", f"""WITH qt AS (SELECT feature_id, unnest(list_distinct({CONTENT.format(c='canonical_feature_name')})) AS term FROM expected_features), p AS (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT feature_id, doc_id, sum(tf)::BIGINT AS score FROM c JOIN qt USING (term) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def search_by_counts(spark, folder):
    return ret.term_counts(table(spark, folder, "documents"), table(spark, folder, "expected_features"), "doc_id", "text", "feature_id", "canonical_feature_name", 10)


@query("keywords_in_papers", "WITH k AS (SELECT pos, unnest(matched_keywords) AS keyword, lower(coalesce(title,'') || ' ' || coalesce(abstract,'') || ' ' || coalesce(venue,'')) AS body FROM candidates) SELECT pos, keyword, count(*) AS times, contains(' ' || any_value(body) || ' ', lower(keyword)) AS held FROM k WHERE keyword IS NOT NULL AND keyword <> '' GROUP BY pos, keyword")
def keywords_in_papers(spark, folder):
    body = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("venue", F.lit(""))))
    k = table(spark, folder, "candidates").select("pos", F.explode("matched_keywords").alias("keyword"), body.alias("body")).where("keyword is not null and keyword <> ''")
    return k.groupBy("pos", "keyword").agg(F.count("*").alias("times"), F.first(F.contains("body", F.lower("keyword"))).alias("held"))


@query("papers_page", "SELECT pos, title, year FROM candidates WHERE contains(lower(coalesce(title,'')), 'moral') ORDER BY year DESC NULLS FIRST, pos LIMIT 50 OFFSET 20")
def papers_page(spark, folder):
    c = table(spark, folder, "candidates").where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("moral")))
    return c.orderBy(F.desc_nulls_first("year"), "pos").offset(20).limit(50).select("pos", "title", "year")


@query("late_rows_of_source", "SELECT coalesce(source,'none') AS source, count(*) AS rows, count(*) FILTER (WHERE loaded_at > published_at + INTERVAL 30 DAY) AS late, min(published_at) AS earliest FROM documents GROUP BY ALL")
def late_rows_of_source(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("rows"), F.count_if(F.col("loaded_at") > F.col("published_at") + F.expr("INTERVAL 30 DAY")).alias("late"), F.min("published_at").alias("earliest"))


@query("ledger_latest", "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ledger_latest(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return f.last_rows(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")
