"""Queries over compared pairs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantiles as q
from ..operators import similarity as s
from ..tables import table
from .curation import linked_sql
from .registry import query

CLEAN = "pairs AS (SELECT similarity FROM similarity_pairs WHERE similarity IS NOT NULL AND NOT isnan(similarity))"


@query("similarity_summary", f"WITH {CLEAN} SELECT count(*) AS n, round(min(similarity),6) AS least, round(max(similarity),6) AS greatest, round(avg(similarity),6) AS mean, round(stddev_pop(similarity),6) AS deviation FROM pairs")
def similarity_summary(spark, folder):
    return q.summary(table(spark, folder, "similarity_pairs"), "similarity")


@query("similarity_percentiles", f"""WITH {CLEAN}, p AS (SELECT unnest([0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99])::DOUBLE AS share), r AS (SELECT similarity AS v, row_number() OVER (ORDER BY similarity) - 1 AS i, count(*) OVER () AS n FROM pairs),
q AS (SELECT share, (n-1)*share AS h, max(CASE WHEN i = floor((n-1)*share) THEN v END) AS a, max(CASE WHEN i = least(floor((n-1)*share)+1, n-1) THEN v END) AS b FROM r, p GROUP BY ALL) SELECT share, round(a + (b-a)*(h-floor(h)), 6) AS value FROM q""")
def similarity_percentiles(spark, folder):
    found = q.exact_percentiles(table(spark, folder, "similarity_pairs"), [], "similarity", [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    return found.select("share", F.round("value", 6).alias("value"))


@query("similarity_histogram", f"WITH {CLEAN} SELECT least(greatest(floor((similarity + 1) * 80 / 2.0), 0), 79)::INT AS bin, count(*) AS n FROM pairs GROUP BY ALL")
def similarity_histogram(spark, folder):
    return q.histogram(table(spark, folder, "similarity_pairs"), [], "similarity", -1.0, 1.0, 80)


def linked_pairs(spark, folder):
    return table(spark, folder, "similarity_pairs").select(F.col("left_index").alias("l"), F.col("right_index").alias("r"), "similarity")


THRESHOLDS = [0.80, 0.85, 0.90, 0.92, 0.94, 0.96, 0.98]


@query("threshold_pairs", """WITH t AS (SELECT unnest([0.8,0.85,0.9,0.92,0.94,0.96,0.98])::DOUBLE AS threshold), e AS (SELECT least(left_index,right_index) AS a, greatest(left_index,right_index) AS b, max(similarity) AS similarity FROM similarity_pairs WHERE left_index <> right_index AND similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL)
SELECT threshold, count(*) AS pairs FROM t JOIN e ON similarity >= threshold GROUP BY ALL""")
def threshold_pairs(spark, folder):
    p = linked_pairs(spark, folder).where("l <> r and similarity is not null and not isnan(similarity)")
    best = p.groupBy(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).agg(F.max("similarity").alias("similarity"))
    reached = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: t <= F.col("similarity"))
    return best.select(F.explode(reached).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("pairs"))


@query("threshold_sweep", """WITH RECURSIVE b AS (SELECT least(left_index, right_index) AS a, greatest(left_index, right_index) AS b, max(similarity) AS similarity FROM similarity_pairs WHERE left_index <> right_index AND NOT isnan(similarity) GROUP BY ALL), p AS (SELECT t, a, b FROM b, (SELECT unnest([0.8,0.85,0.9,0.92,0.94,0.96,0.98])::DOUBLE AS t) WHERE similarity >= t),
e AS (SELECT t, a, b FROM p UNION SELECT t, b, a FROM p), cc(t, id, comp) USING KEY (t, id) AS (SELECT t, a AS id, min(least(a, b)) AS comp FROM e GROUP BY t, a UNION SELECT e.t, e.b AS id, min(cc.comp) AS comp FROM cc JOIN e ON e.a = cc.id AND e.t = cc.t JOIN recurring.cc AS r ON r.id = e.b AND r.t = e.t WHERE cc.comp < r.comp GROUP BY e.t, e.b),
n AS (SELECT t, count(*) AS pairs FROM p GROUP BY ALL) SELECT cc.t AS threshold, any_value(pairs) AS pairs, count(DISTINCT comp) AS groups, count(*) AS grouped, count(*) - count(DISTINCT comp) AS absorbed FROM cc JOIN n ON n.t = cc.t GROUP BY cc.t""")
def threshold_sweep(spark, folder):
    return s.threshold_sweep(linked_pairs(spark, folder), THRESHOLDS)


def groups(spark, folder):
    p = linked_pairs(spark, folder).where("l <> r and similarity >= 0.95 and not isnan(similarity)")
    return s.linked_groups(p.select(F.col("l").alias("a"), F.col("r").alias("b")))


@query("single_link_groups", f'WITH RECURSIVE {linked_sql("0.95")} SELECT id AS item, comp AS "group" FROM cc')
def single_link_groups(spark, folder):
    return groups(spark, folder)


CANONICAL = f"""WITH RECURSIVE {linked_sql('0.95')}, f AS (SELECT DISTINCT row_index, category_key, display_name, paper_count, mention_count FROM feature_records), j AS (SELECT f.*, comp FROM f JOIN cc ON id = row_index),
b AS (SELECT comp, row_index FROM j QUALIFY row_number() OVER (PARTITION BY comp ORDER BY coalesce(paper_count, 0) DESC, coalesce(mention_count, 0) DESC, length(coalesce(display_name, '')), row_index) = 1)"""


@query("group_canonicals", f'{CANONICAL} SELECT j.comp AS "group", any_value(b.row_index) AS canonical, count(*) AS members FROM j JOIN b ON b.comp = j.comp GROUP BY j.comp')
def group_canonicals(spark, folder):
    items = table(spark, folder, "feature_records").dropDuplicates(["row_index"])
    rank = [F.coalesce("paper_count", F.lit(0)), F.coalesce("mention_count", F.lit(0)), -F.length(F.coalesce("display_name", F.lit("")))]
    return s.canonical_items(groups(spark, folder), items, "row_index", rank)


@query("merge_retention", f"""{CANONICAL} SELECT f.category_key, count(*) AS items, count(*) FILTER (WHERE cc.id IS NULL OR b.row_index IS NOT NULL) AS kept, count(*) FILTER (WHERE cc.id IS NOT NULL AND b.row_index IS NULL) AS absorbed
FROM f LEFT JOIN cc ON cc.id = f.row_index LEFT JOIN b ON b.row_index = f.row_index GROUP BY ALL""")
def merge_retention(spark, folder):
    items = table(spark, folder, "feature_records").dropDuplicates(["row_index"])
    g = groups(spark, folder)
    rank = [F.coalesce("paper_count", F.lit(0)), F.coalesce("mention_count", F.lit(0)), -F.length(F.coalesce("display_name", F.lit("")))]
    return s.merge_retention(items.select("row_index", "category_key"), g, s.canonical_items(g, items, "row_index", rank), "row_index", "category_key")


@query("separation", """WITH f AS (SELECT DISTINCT row_index, category_key FROM feature_records), p AS (SELECT s.similarity AS v, a.category_key = b.category_key AS pos FROM similarity_pairs s JOIN f a ON a.row_index = s.left_index JOIN f b ON b.row_index = s.right_index WHERE similarity IS NOT NULL AND NOT isnan(similarity)),
c AS (SELECT v, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM p WHERE pos IS NOT NULL GROUP BY ALL), w AS (SELECT *, coalesce(sum(nn) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
s AS (SELECT sum(np)::BIGINT AS n_positive, sum(nn)::BIGINT AS n_negative, sum(np * (below + nn / 2.0)) AS won, sum(v * np) AS sp, sum(v * nn) AS sn FROM w)
SELECT n_positive, n_negative, round((won / (n_positive::DOUBLE * n_negative))::DOUBLE, 6) AS auc, round((2 * won / (n_positive::DOUBLE * n_negative) - 1)::DOUBLE, 6) AS delta, round(sp / n_positive - sn / n_negative, 6) AS mean_gap FROM s""")
def separation(spark, folder):
    f = table(spark, folder, "feature_records").select("row_index", "category_key").distinct()
    p = linked_pairs(spark, folder).where("similarity is not null and not isnan(similarity)")
    both = p.join(f.select(F.col("row_index").alias("l"), F.col("category_key").alias("c")), "l").join(f.select(F.col("row_index").alias("r"), F.col("category_key").alias("d")), "r")
    return q.rank_areas(both.select("similarity", (F.col("c") == F.col("d")).alias("same")), "similarity", "same")


COSINE = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label = b.label AS same, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)"


@query("cosine_pairs", f"WITH {COSINE} SELECT l, r, round(c, 6) AS similarity FROM p WHERE c >= 0.35")
def cosine_pairs(spark, folder):
    return s.cosine_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.35)


@query("cosine_pairs_of_label", f"WITH {COSINE} SELECT l, r, round(c, 6) AS similarity FROM p WHERE c >= 0.25 AND same")
def cosine_pairs_of_label(spark, folder):
    return s.cosine_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.25, scope="label")
