"""Queries over feature records: identities, aggregates, ranks, scores, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import features as f
from ..operators.quantiles import exact_percentiles
from ..tables import table
from .registry import query

#: The normalized name in DuckDB's SQL.
NAME = "trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce({c},'')),'&',' and '),'/',' '),'[''’]','','g'),'[^a-z0-9]+',' ','g'))"
RECORDS = f"records AS (SELECT *, {NAME.format(c='display_name')} AS name FROM (SELECT DISTINCT row_index, feature_key, display_name, category, category_key, paper_count, mention_count FROM feature_records))"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The feature records without repeats, with their normalized ``name``."""
    rows = table(spark, folder, "feature_records").dropDuplicates(["row_index"])
    return rows.withColumn("name", text.normalize_name(F.col("display_name")))


@query("feature_identity", f"""
WITH {RECORDS} SELECT row_index, name, coalesce(category_key,'') || '::' || name AS identity, substr(sha1(coalesce(category_key,'') || '::' || name), 1, 16) AS short_id FROM records""")
def feature_identity(spark, folder):
    rows = f.with_identity(records(spark, folder), "category_key", "display_name")
    return rows.select("row_index", "name", "identity", values.short_hash(F.col("identity")).alias("short_id"))


@query("feature_aggregate", f"""
WITH {RECORDS}, n AS (SELECT category_key, name, count(*) AS records, sum(mention_count) AS mention_count, max(paper_count) AS paper_count, min(row_index) AS first_position, count(DISTINCT display_name) AS spellings FROM records GROUP BY ALL)
SELECT * FROM n WHERE name <> ''""")
def feature_aggregate(spark, folder):
    rows = records(spark, folder).where("name <> ''")
    return rows.groupBy("category_key", "name").agg(F.count("*").alias("records"), F.sum("mention_count").alias("mention_count"), F.max("paper_count").alias("paper_count"), F.min("row_index").alias("first_position"), F.count_distinct("display_name").alias("spellings"))


@query("feature_synonym_union", f"""
WITH {RECORDS}, s AS (SELECT DISTINCT row_index, unnest(synonyms) AS v, generate_subscripts(synonyms, 1) AS i FROM feature_records),
j AS (SELECT r.category_key, r.name, s.v, min(r.row_index * 10000 + s.i) AS place FROM records r JOIN s USING (row_index) WHERE s.v <> '' AND r.category_key IS NOT NULL AND r.name <> '' GROUP BY ALL)
SELECT category_key, name, string_agg(v, '|' ORDER BY place) AS synonyms, count(*) AS n FROM j GROUP BY ALL""")
def feature_synonym_union(spark, folder):
    rows = records(spark, folder).where("category_key is not null and name <> ''")
    found = f.aggregate_features(rows, ["category_key", "name"], "row_index", [], ["synonyms"]).where(F.size("synonyms") > 0)
    return found.select("category_key", "name", F.array_join("synonyms", "|").alias("synonyms"), F.size("synonyms").cast("long").alias("n"))


@query("feature_best_row", f"""
WITH {RECORDS} SELECT category_key, name, row_index, paper_count, mention_count FROM records WHERE name <> '' AND category_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY category_key, name ORDER BY paper_count DESC NULLS LAST, mention_count DESC NULLS LAST, row_index) = 1""")
def feature_best_row(spark, folder):
    rows = records(spark, folder).where("name <> '' and category_key is not null")
    best = f.best_row([F.col("paper_count"), F.col("mention_count")], F.struct("row_index", "paper_count", "mention_count"), F.col("row_index"))
    return rows.groupBy("category_key", "name").agg(best.alias("b")).select("category_key", "name", "b.*")


@query("feature_modal_name", f"""
WITH {RECORDS}, c AS (SELECT category_key, name, display_name, count(*) AS n, min(row_index) AS p FROM records WHERE name <> '' AND trim(display_name) <> '' AND category_key IS NOT NULL GROUP BY ALL)
SELECT category_key, name, display_name AS modal_name FROM c QUALIFY row_number() OVER (PARTITION BY category_key, name ORDER BY n DESC, p) = 1""")
def feature_modal_name(spark, folder):
    rows = records(spark, folder).where("name <> '' and category_key is not null")
    return f.modal_names(rows, ["category_key", "name"], "display_name", "row_index")


@query("feature_first_rows", f"""
WITH {RECORDS} SELECT row_index, coalesce(category_key,'') AS category_key, name FROM records QUALIFY row_number() OVER (PARTITION BY coalesce(category_key,''), name ORDER BY row_index) = 1""")
def feature_first_rows(spark, folder):
    rows = records(spark, folder).select("row_index", F.coalesce("category_key", F.lit("")).alias("category_key"), "name")
    return f.first_rows(rows, ["category_key", "name"], "row_index")


@query("feature_top_of_category", f"""
WITH {RECORDS}, g AS (SELECT category_key, name, sum(mention_count) AS mentions, max(paper_count) AS papers FROM records WHERE name <> '' AND category_key IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY papers DESC NULLS LAST, mentions DESC NULLS LAST, name) AS category_rank,
 CASE category_key WHEN 'persuasion' THEN 1 WHEN 'moral_framing' THEN 2 WHEN 'sentiment_affect' THEN 3 ELSE 4 END AS priority FROM g QUALIFY category_rank <= 100""")
def feature_top_of_category(spark, folder):
    rows = records(spark, folder).where("name <> '' and category_key is not null")
    grouped = rows.groupBy("category_key", "name").agg(F.sum("mention_count").alias("mentions"), F.max("paper_count").alias("papers"))
    top = f.top_of_category(grouped, "category_key", [F.desc_nulls_last("papers"), F.desc_nulls_last("mentions"), F.asc("name")], 100)
    return top.withColumn("priority", f.category_priority(F.col("category_key")).cast("int"))


@query("feature_scores", f"""
WITH {RECORDS}, s AS (SELECT row_index, category_key, CASE WHEN coalesce(paper_count,0)>=15 THEN 5 WHEN paper_count>=10 THEN 4 WHEN paper_count>=6 THEN 3 WHEN paper_count>=3 THEN 2 WHEN paper_count>=2 THEN 1 ELSE 0 END AS literature,
 least(5, coalesce(mention_count,0)) AS annotation, least(5, length(name) // 5) AS distinctness FROM records)
SELECT *, round((0.4*literature + 0.3*annotation + 0.3*distinctness)::DOUBLE, 2) AS total FROM s""")
def feature_scores(spark, folder):
    rows = records(spark, folder)
    s = rows.select("row_index", "category_key", values.literature_support(F.col("paper_count")).alias("literature"), F.least(F.lit(5), F.coalesce("mention_count", F.lit(0))).alias("annotation"), F.least(F.lit(5), F.floor(F.length("name") / 5)).cast("int").alias("distinctness"))
    return s.withColumn("total", values.total_score(F.col("literature"), F.col("annotation"), F.col("distinctness")))


@query("score_summary_of_category", f"""
WITH {RECORDS} SELECT category_key, count(*) AS n, round(avg(paper_count),4) AS mean_papers, round(avg(mention_count),4) AS mean_mentions, max(paper_count) AS most_papers FROM records GROUP BY category_key""")
def score_summary_of_category(spark, folder):
    return records(spark, folder).groupBy("category_key").agg(F.count("*").alias("n"), F.round(F.avg("paper_count"), 4).alias("mean_papers"), F.round(F.avg("mention_count"), 4).alias("mean_mentions"), F.max("paper_count").alias("most_papers"))


@query("score_percentiles", f"""
WITH {RECORDS}, p AS (SELECT unnest([0.05,0.1,0.25,0.5,0.75,0.9,0.95]) AS share), m AS (SELECT category_key, 'paper_count' AS metric, paper_count::DOUBLE AS v FROM records UNION ALL SELECT category_key, 'mention_count', mention_count::DOUBLE FROM records),
r AS (SELECT category_key, metric, v, row_number() OVER (PARTITION BY category_key, metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY category_key, metric) AS n FROM m WHERE v IS NOT NULL AND category_key IS NOT NULL),
q AS (SELECT r.category_key, r.metric, p.share::DOUBLE AS share, (r.n-1)*p.share::DOUBLE AS h, max(CASE WHEN i = floor((r.n-1)*p.share::DOUBLE) THEN v END) AS a, max(CASE WHEN i = least(floor((r.n-1)*p.share::DOUBLE)+1, r.n-1) THEN v END) AS b FROM r, p GROUP BY ALL)
SELECT category_key, metric, share, round(a + (b-a)*(h-floor(h)), 4) AS value FROM q""")
def score_percentiles(spark, folder):
    rows = records(spark, folder).where("category_key is not null")
    each = rows.select("category_key", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("paper_count", "mention_count")])).alias("m")).select("category_key", "m.*")
    found = exact_percentiles(each, ["category_key", "metric"], "v", list(f.PERCENTILES))
    return found.select("category_key", "metric", "share", F.round("value", 4).alias("value"))


@query("feature_decisions", f"""
WITH {RECORDS}, d AS (SELECT {NAME.format(c='canonical_feature_name')} AS name, category, submitted_at, feature_id FROM inventory_rows),
l AS (SELECT category || '::' || name AS key, category AS decided_category, feature_id AS decision_id FROM d WHERE name <> '' AND category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category || '::' || name ORDER BY submitted_at DESC NULLS LAST, feature_id DESC) = 1)
SELECT r.row_index, coalesce(l.decision_id, 'keep') AS decision_id, (CASE WHEN l.key IS NULL THEN 0.2 ELSE 1.0 END)::DOUBLE AS confidence, l.key IS NOT NULL AS decided FROM records r LEFT JOIN l ON l.key = coalesce(r.category_key,'') || '::' || r.name""")
def feature_decisions(spark, folder):
    rows = f.with_identity(records(spark, folder), "category_key", "display_name")
    raw = f.with_identity(table(spark, folder, "inventory_rows"), "category", "canonical_feature_name").where("normalized_name <> '' and category is not null")
    latest = f.last_rows(raw.select("identity", "submitted_at", F.col("feature_id").alias("decision_id"), F.lit(1.0).alias("confidence")), ["identity"], ["submitted_at", "decision_id"])
    found = f.with_decisions(rows.select("row_index", "identity"), latest, "identity", {"decision_id": F.lit("keep"), "confidence": F.lit(0.2)})
    return found.select("row_index", "decision_id", "confidence", "decided")


@query("feature_batches", f"""
WITH {RECORDS}, k AS (SELECT DISTINCT category_key, name FROM records WHERE name <> '' AND category_key IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY name) AS i FROM k),
b AS (SELECT category_key, (i-1)//40 + 1 AS batch, count(*) AS keys, string_agg(name, chr(10) ORDER BY name) AS joined FROM n GROUP BY ALL)
SELECT category_key, batch, keys, category_key || ':' || batch || ':' || substr(sha1(joined), 1, 10) AS batch_id FROM b""")
def feature_batches(spark, folder):
    return f.batches(records(spark, folder).where("name <> '' and category_key is not null"), "category_key", "name", 40)


@query("expected_coverage", f"""
WITH {RECORDS}, e AS (SELECT feature_id, category, {NAME.format(c='canonical_feature_name')} AS name FROM expected_features),
m AS (SELECT e.feature_id, min(r.row_index) AS first_row, count(r.row_index) AS matches FROM e LEFT JOIN records r ON r.category_key = e.category AND r.name = e.name GROUP BY ALL)
SELECT feature_id, first_row, matches, matches > 0 AS found FROM m""")
def expected_coverage(spark, folder):
    expected = table(spark, folder, "expected_features").select("feature_id", "category", text.normalize_name(F.col("canonical_feature_name")).alias("name"))
    counted = records(spark, folder).groupBy(F.col("category_key").alias("category"), "name").agg(F.min("row_index").alias("first_row"), F.count("*").alias("matches"))
    found = expected.join(counted, ["category", "name"], "left")
    return found.select("feature_id", "first_row", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.col("matches") > 0, F.lit(False)).alias("found"))


@query("neighbours_of_expected", f"""
WITH {RECORDS}, a AS (SELECT DISTINCT feature_id, category, unnest(list_distinct(string_split({NAME.format(c='canonical_feature_name')}, ' '))) AS t FROM expected_features),
n AS (SELECT category_key, name, max(paper_count) AS papers FROM records WHERE name <> '' AND category_key IS NOT NULL GROUP BY ALL), b AS (SELECT category_key, name, papers, unnest(list_distinct(string_split(name, ' '))) AS t FROM n),
sa AS (SELECT feature_id, count(*) AS na FROM a WHERE length(t) > 2 GROUP BY ALL), sb AS (SELECT category_key, name, count(*) AS nb FROM b WHERE length(t) > 2 GROUP BY ALL),
j AS (SELECT a.feature_id, b.category_key, b.name, max(b.papers) AS papers, count(*) AS shared FROM a JOIN b ON a.t = b.t AND a.category = b.category_key WHERE length(a.t) > 2 GROUP BY ALL),
s AS (SELECT feature_id, name, papers, round(shared / least(na, nb)::DOUBLE, 6) AS overlap FROM j JOIN sa USING (feature_id) JOIN sb USING (category_key, name))
SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY overlap DESC, papers DESC NULLS LAST, name) AS rank FROM s WHERE overlap >= 0.5 QUALIFY rank <= 8""")
def neighbours_of_expected(spark, folder):
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: F.length(w) > 2)
    expected = table(spark, folder, "expected_features").select("feature_id", F.col("category").alias("category_key"), words(text.normalize_name(F.col("canonical_feature_name"))).alias("a"))
    named = records(spark, folder).where("name <> '' and category_key is not null").groupBy("category_key", "name").agg(F.max("paper_count").alias("papers")).withColumn("b", words(F.col("name")))
    met = expected.withColumn("t", F.explode("a")).join(named.withColumn("t", F.explode("b")), ["category_key", "t"]).dropDuplicates(["feature_id", "name"])
    scored = met.select("feature_id", "name", "papers", F.round(text.overlap(F.col("a"), F.col("b")), 6).alias("overlap")).where("overlap >= 0.5")
    return f.top_of_category(scored, "feature_id", [F.desc("overlap"), F.desc_nulls_last("papers"), F.asc("name")], 8).withColumnRenamed("category_rank", "rank")
