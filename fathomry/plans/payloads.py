"""Queries over decisions, references, names and short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as p
from ..functions import text as t
from ..operators import features as f
from ..operators.running import running_total
from ..tables import table
from .comparison import SETS, sets
from .curation import groups_at, linked_sql
from .features import NAME, RECORDS, records
from .papers import CONTENT, DOI, TITLE, paper_identity
from .registry import ORACLES, query

#: Aliases of the categories.
CATEGORIES = {"persuasion": "persuasion", "persuasive_technique": "persuasion", "rhetoric": "persuasion", "moral_framing": "moral_framing", "moral": "moral_framing", "sentiment_affect": "sentiment_affect", "sentiment": "sentiment_affect", "affect": "sentiment_affect"}
_CASES = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in CATEGORIES.items())


@query("annotation_payloads", f"""WITH {RECORDS}, r AS (SELECT row_index, CASE replace({NAME.format(c='category')}, ' ', '_') {_CASES} ELSE 'unknown' END AS category, trim(coalesce(display_name, '')) AS label, paper_count, mention_count FROM records)
SELECT row_index, category AS annotation_category, CASE WHEN paper_count >= 3 THEN 'kept' ELSE 'pending' END AS annotation_status, coalesce(least(greatest(round_even(mention_count / 2.0, 0), 0), 5), 0)::INT AS score_value FROM r""")
def annotation_payloads(spark, folder):
    """Flat decisions nested to one value each, and written flat again with defaults."""
    r = records(spark, folder).select("row_index", p.canonical_of(F.col("category"), CATEGORIES).alias("a_category"), F.when(F.col("paper_count") >= 3, "kept").otherwise("").alias("a_status"), p.criterion_score(F.col("mention_count") / 2).alias("score_value"))
    held = p.nested(r, "annotation", ["category", "status"], "a")
    return p.flattened(held, "annotation", {"category": F.lit("unknown"), "status": F.lit("pending")}, "annotation")


@query("reference_candidates", f"""SELECT DISTINCT ref_id, paper_id, coalesce(nullif(trim(cited_title), ''), trim(coalesce(cited_authors, ''))) AS title, {DOI.format(c='cited_doi')} AS doi, try_cast(nullif(regexp_extract(coalesce(cited_year, ''), '(18|19|20)[0-9]{{2}}'), '') AS INT) AS year, trim(coalesce(cited_title, '')) = '' AS raw FROM cited_refs""")
def reference_candidates(spark, folder):
    own = F.nullif(F.trim("cited_title"), F.lit(""))
    year = F.nullif(F.regexp_extract(F.coalesce("cited_year", F.lit("")), "(?:18|19|20)[0-9]{2}", 0), F.lit("")).try_cast("int")
    return table(spark, folder, "cited_refs").select("ref_id", "paper_id", F.coalesce(own, F.trim(F.coalesce("cited_authors", F.lit("")))).alias("title"), t.normalize_doi(F.col("cited_doi")).alias("doi"), year.alias("year"), own.isNull().alias("raw")).distinct()


@query("merge_group_names", f"""WITH RECURSIVE {linked_sql('0.95')}, g AS (SELECT comp, count(*) AS members FROM cc GROUP BY ALL) SELECT comp AS "group", members, 'merge_group_' || lpad((row_number() OVER (ORDER BY comp))::VARCHAR, 6, '0') AS name FROM g""")
def merge_group_names(spark, folder):
    """The groups numbered in the order of their least items: counted by ranges of those, so no task orders all groups."""
    g = groups_at(spark, folder, 0.95).groupBy("group").agg(F.count("*").alias("members"))
    placed = running_total(g.withColumn("_b", F.floor(F.col("group") / 1_000)).withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), ["_all"], "_b", ["group"], "_one", "_n")
    return placed.select("group", "members", F.concat(F.lit("merge_group_"), F.lpad((F.col("_n") + 1).cast("string"), 6, "0")).alias("name"))


_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 2))"


@query("near_names_of_sets", f"""WITH {SETS}, x AS (SELECT category, name, {_WORDS.format(c='name')} AS w FROM r1), y AS (SELECT category, name, {_WORDS.format(c='name')} AS w FROM r2 WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.category = r2.category AND r1.name = r2.name)),
m AS (SELECT DISTINCT y.category, y.name, x.name AS near FROM (SELECT category, name, unnest(w) AS t FROM y) y JOIN (SELECT category, name, unnest(w) AS t FROM x) x USING (category, t)),
s AS (SELECT m.*, round(len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::DOUBLE + CASE WHEN len(list_intersect(x.w, y.w)) = least(len(x.w), len(y.w)) THEN 0.12 ELSE 0 END, 6) AS score FROM m JOIN x ON x.category = m.category AND x.name = m.near JOIN y ON y.category = m.category AND y.name = m.name)
SELECT category, name, near, score, row_number() OVER (PARTITION BY category, name ORDER BY score DESC, near) AS rank FROM s WHERE score >= 0.4 QUALIFY rank <= 3""")
def near_names_of_sets(spark, folder):
    """For each name of the second set alone the nearest names of the first: they meet by a word, and are scored once."""
    a, b = sets(spark, folder)
    words = F.array_distinct(F.filter(F.split("name", " "), lambda w: F.length(w) > 2))
    x = a.select("category", F.col("name").alias("near"), words.alias("v"))
    y = b.join(a.select("category", "name"), ["category", "name"], "left_anti").select("category", "name", words.alias("w"))
    met = y.withColumn("t", F.explode("w")).join(x.withColumn("t", F.explode("v")), ["category", "t"]).dropDuplicates(["category", "name", "near"])
    shared = F.size(F.array_intersect("v", "w"))
    score = F.round(shared / F.size(F.array_union("v", "w")) + F.when(shared == F.least(F.size("v"), F.size("w")), 0.12).otherwise(0.0), 6)
    scored = met.select("category", "name", "near", score.alias("score")).where("score >= 0.4")
    ranked = scored.withColumn("rank", F.row_number().over(f.Window.partitionBy("category", "name").orderBy(F.desc("score"), "near")))
    return ranked.where("rank <= 3")


_QUERY = f"CASE WHEN len({CONTENT.format(c='title')}) >= 3 THEN array_to_string(({CONTENT.format(c='title')})[1:12], ' ') ELSE substr(trim(regexp_replace(coalesce(title, ''), '[\\s\\x{{a0}}]+', ' ', 'g')), 1, 160) END"


@query("query_texts", f"""WITH q AS (SELECT pos, {_QUERY} AS query FROM candidates) SELECT query, min(pos) AS first_position, count(*) AS times FROM q WHERE query <> '' GROUP BY ALL""")
def query_texts(spark, folder):
    """The queries that titles give, each once with the place where it was first."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\s\x{a0}]+", " ")
    q = table(spark, folder, "candidates").select("pos", p.query_text(title).alias("query")).where("query <> ''")
    return q.groupBy("query").agg(F.min("pos").alias("first_position"), F.count("*").alias("times"))


@query("file_parts", f"WITH i AS ({ORACLES['paper_identity']}) SELECT pos, try_cast(nullif(regexp_extract(file_name, '^((18|19|20)[0-9]{{2}})_', 1), '') AS INT) AS year, replace(regexp_replace(regexp_replace(file_name, '^([0-9]{{4}}|nd)_', ''), '_?[0-9a-f]{{10}}\\.pdf$', ''), '_', ' ') AS title FROM i")
def file_parts(spark, folder):
    named = paper_identity(spark, folder)
    return named.select("pos", p.year_of_file(F.col("file_name")).alias("year"), p.title_of_file(F.col("file_name")).alias("title"))


@query("selected_papers", f"""WITH s AS (SELECT DISTINCT {TITLE.format(c='title')} AS title FROM papers WHERE status = 'converted'), c AS (SELECT pos, {TITLE.format(c='title')} AS title FROM candidates) SELECT pos, title <> '' AND title IN (SELECT title FROM s WHERE title IS NOT NULL) AS selected, CASE WHEN title <> '' AND title IN (SELECT title FROM s WHERE title IS NOT NULL) THEN 'pending' ELSE 'not_selected' END AS status FROM c""")
def selected_papers(spark, folder):
    """The candidates split by a list of selected ones, those left out marked."""
    chosen = table(spark, folder, "papers").where("status = 'converted'").select(t.normalize_title(F.col("title")).alias("title")).where("title <> ''").distinct().withColumn("_s", F.lit(True))
    c = table(spark, folder, "candidates").select("pos", t.normalize_title(F.col("title")).alias("title")).join(chosen, "title", "left")
    selected = F.col("_s").isNotNull()
    return c.select("pos", selected.alias("selected"), F.when(selected, "pending").otherwise("not_selected").alias("status"))


@query("chunk_headings", """WITH l AS (SELECT pos, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM chunks) SELECT pos, CASE WHEN length(ls[1]) <= 180 THEN ls[1] END AS first_line, len(list_filter(ls, lambda x: regexp_matches(x, '^[0-9]+\\.? [A-Z]'))) AS headings FROM l""")
def chunk_headings(spark, folder):
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    c = table(spark, folder, "chunks").select("pos", lines.alias("ls"))
    first = F.get("ls", F.lit(0))
    return c.select("pos", F.when(F.length(first) <= 180, first).alias("first_line"), F.size(F.filter("ls", lambda x: x.rlike(r"^[0-9]+\.? [A-Z]"))).cast("long").alias("headings"))
