"""Queries that compare the feature records with the inventories sent in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare as c
from ..shared import Scratch
from ..tables import table
from .features import NAME, RECORDS, records
from .registry import query

SETS = f"""{RECORDS}, s1 AS (SELECT category_key AS category, name, max(paper_count) AS support FROM records WHERE name <> '' AND category_key IS NOT NULL GROUP BY ALL),
d AS (SELECT category, {NAME.format(c='canonical_feature_name')} AS name, count(DISTINCT feature_id) AS n FROM inventory_rows GROUP BY ALL), s2 AS (SELECT category, name, n AS support FROM d WHERE name <> '' AND category IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY support DESC NULLS LAST, name) AS rank FROM s1), r2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY support DESC, name) AS rank FROM s2)"""


def sets(spark, folder):
    scratch = Scratch(spark)  # each set is ranked once, however often it is read
    a = scratch.keep(c.ranked_set(records(spark, folder), "category_key", "name", "paper_count"), "set1")
    sent = table(spark, folder, "inventory_rows").select("category", "feature_id", text.normalize_name(F.col("canonical_feature_name")).alias("name"))
    b = c.ranked_set(sent.groupBy("category", "name").agg(F.count_distinct("feature_id").alias("n")), "category", "name", "n")
    return a, scratch.keep(b, "set2")


@query("feature_union", f"""WITH {SETS} SELECT coalesce(a.category, b.category) AS category, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'set_2_only' WHEN b.name IS NULL THEN 'set_1_only' ELSE 'both' END AS membership,
 a.support AS support_1, b.support AS support_2, a.rank AS rank_1, b.rank AS rank_2 FROM r1 a FULL JOIN r2 b ON a.category = b.category AND a.name = b.name""")
def feature_union(spark, folder):
    return c.feature_union(*sets(spark, folder))


SERIES = """, k AS (SELECT unnest(range(1, 101)) AS k), j AS (SELECT coalesce(a.category, b.category) AS category, a.rank AS ra, b.rank AS rb FROM (SELECT * FROM r1 WHERE rank <= 100) a FULL JOIN (SELECT * FROM r2 WHERE rank <= 100) b ON a.category = b.category AND a.name = b.name),
s AS (SELECT category, k::INT AS k, count(*) FILTER (WHERE least(coalesce(ra, 999999), coalesce(rb, 999999)) <= k) AS union_size, count(*) FILTER (WHERE ra <= k AND rb <= k) AS shared FROM j, k GROUP BY ALL),
series AS (SELECT *, round(CASE WHEN union_size > 0 THEN shared / union_size::DOUBLE ELSE 0 END, 6) AS jaccard FROM s)"""


@query("jaccard_series", f"WITH {SETS}{SERIES} SELECT * FROM series")
def jaccard_series(spark, folder):
    return c.jaccard_series(*sets(spark, folder), 1, 100)


@query("jaccard_peaks", f"WITH {SETS}{SERIES}, m AS (SELECT category, max(jaccard) AS peak_jaccard FROM series GROUP BY ALL) SELECT s.category, peak_jaccard, min(k) AS peak_k, count(*) AS tied FROM series s JOIN m ON s.category = m.category AND s.jaccard = m.peak_jaccard GROUP BY ALL")
def jaccard_peaks(spark, folder):
    return c.peaks(c.jaccard_series(*sets(spark, folder), 1, 100))


@query("venn_counts", f"""WITH {SETS}, j AS (SELECT coalesce(a.category, b.category) AS category, a.name AS an, b.name AS bn FROM (SELECT * FROM r1 WHERE rank <= 50) a FULL JOIN (SELECT * FROM r2 WHERE rank <= 50) b ON a.category = b.category AND a.name = b.name)
SELECT category, count(*) FILTER (WHERE bn IS NULL) AS set_1_only, count(*) FILTER (WHERE an IS NOT NULL AND bn IS NOT NULL) AS both, count(*) FILTER (WHERE an IS NULL) AS set_2_only FROM j GROUP BY ALL""")
def venn_counts(spark, folder):
    return c.venn(*sets(spark, folder), 50)


@query("support_fit", f"""WITH {RECORDS}, v AS (SELECT category_key, paper_count::DOUBLE AS x, mention_count::DOUBLE AS y FROM records WHERE paper_count IS NOT NULL AND mention_count IS NOT NULL AND category_key IS NOT NULL),
s AS (SELECT category_key, count(*) AS n, covar_pop(x, y) AS c, var_pop(x) AS vx, var_pop(y) AS vy, avg(x) AS mx, avg(y) AS my FROM v GROUP BY ALL)
SELECT category_key, n, round(CASE WHEN vx > 0 THEN c / vx END, 6) AS slope, round(CASE WHEN vx > 0 THEN my - c / vx * mx END, 6) AS intercept, round(CASE WHEN vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END, 6) AS r FROM s""")
def support_fit(spark, folder):
    return c.linear_fit(records(spark, folder).where("category_key is not null"), "category_key", "paper_count", "mention_count")
