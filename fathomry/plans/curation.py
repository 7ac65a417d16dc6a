"""Queries that fold, curate and match feature records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import curation as c
from ..operators import features as f
from ..operators import similarity as s
from ..tables import table
from .features import NAME, RECORDS, records
from .papers import TITLE
from .registry import query


@query("mention_features", f"""WITH {RECORDS}, r AS (SELECT records.*, coalesce(d.definitions, []) AS definitions FROM records JOIN (SELECT DISTINCT row_index, definitions FROM feature_records) d USING (row_index) WHERE name <> '' AND category_key IS NOT NULL),
g AS (SELECT category_key, name, count(*) AS rows, min(row_index) AS first_position, round(avg(coalesce(paper_count, 0)::DOUBLE), 4) AS mean FROM r GROUP BY ALL),
b AS (SELECT category_key, name, row_index AS best_row_index, mention_count AS best_mention_count FROM r QUALIFY row_number() OVER (PARTITION BY category_key, name ORDER BY len(definitions) DESC, length(coalesce(definitions[1], '')) DESC, mention_count DESC NULLS LAST, row_index) = 1),
n AS (SELECT category_key, name, display_name AS modal_name FROM (SELECT category_key, name, display_name, count(*) AS n, min(row_index) AS p FROM r WHERE trim(display_name) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category_key, name ORDER BY n DESC, p) = 1),
e AS (SELECT row_index, category_key, name, unnest(definitions) AS v, generate_subscripts(definitions, 1) AS i FROM r), u AS (SELECT category_key, name, v, min(row_index * 10000 + i) AS place FROM e WHERE v IS NOT NULL AND v <> '' GROUP BY ALL), d AS (SELECT category_key, name, string_agg(v, '|' ORDER BY place) AS definitions FROM u GROUP BY ALL)
SELECT category_key, name, rows, first_position, mean, best_row_index, best_mention_count, modal_name, coalesce(d.definitions, '') AS definitions FROM g JOIN b USING (category_key, name) LEFT JOIN n USING (category_key, name) LEFT JOIN d USING (category_key, name)""")
def mention_features(spark, folder):
    rows = records(spark, folder).where("name <> '' and category_key is not null")
    held = F.coalesce("definitions", F.array().cast("array<string>"))
    rank = [F.size(held), F.length(F.coalesce(F.get(held, F.lit(0)), F.lit(""))), F.col("mention_count")]
    found = c.aggregate_mentions(rows, ["category_key", "name"], "display_name", "row_index", rank, ["row_index", "mention_count"], "paper_count", ["definitions"])
    return found.withColumn("definitions", F.array_join("definitions", "|"))


@query("paper_mentions", f"""WITH c AS (SELECT DISTINCT paper_id, ref_no, cited_title, cited_doi, cited_venue FROM cited_refs), t AS (SELECT *, {TITLE.format(c='cited_title')} AS title FROM c)
SELECT paper_id, title, count(*) AS mentions, count(DISTINCT cited_venue) AS venues, array_to_string(list_sort(list(DISTINCT ref_no)), ',') AS places, min(ref_no) AS first_place, count(*) FILTER (WHERE cited_doi IS NOT NULL AND cited_doi <> '') AS with_doi FROM t WHERE title <> '' AND paper_id IS NOT NULL GROUP BY ALL""")
def paper_mentions(spark, folder):
    rows = table(spark, folder, "cited_refs").select("paper_id", "ref_no", "cited_title", "cited_doi", "cited_venue").distinct()
    rows = rows.withColumn("title", text.normalize_title(F.col("cited_title"))).where("title <> '' and paper_id is not null")
    places = rows.where("ref_no is not null").select("paper_id", "title", "ref_no").distinct().groupBy("paper_id", "title").agg(F.array_join(F.array_sort(F.collect_list("ref_no")).cast("array<string>"), ",").alias("places"))
    counted = rows.groupBy("paper_id", "title").agg(F.count("*").alias("mentions"), F.count_distinct("cited_venue").alias("venues"), F.min("ref_no").alias("first_place"), F.count_if(F.coalesce(F.col("cited_doi"), F.lit("")) != "").alias("with_doi"))
    return counted.join(places, ["paper_id", "title"], "left")


DECIDED = f"""d AS (SELECT category || '::' || {NAME.format(c='canonical_feature_name')} AS key, category, submitted_at, feature_id, {NAME.format(c="regexp_extract(coalesce(matching_aliases,''), '^[^|;,]*')")} AS alias, trim(coalesce(matching_aliases, '')) = '' AS reject FROM inventory_rows WHERE {NAME.format(c='canonical_feature_name')} <> '' AND category IS NOT NULL),
l AS (SELECT key, reject, CASE WHEN alias <> '' THEN category || '::' || alias END AS target FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY submitted_at DESC NULLS LAST, feature_id DESC) = 1)"""


@query("curated_features", f"""WITH {RECORDS}, {DECIDED}, j AS (SELECT r.*, r.key AS own, coalesce(l.target, r.key) AS canonical, coalesce(l.reject, false) AS rejected FROM (SELECT *, coalesce(category_key, '') || '::' || name AS key FROM records) r LEFT JOIN l ON l.key = r.key)
SELECT canonical, rejected, count(*) AS members, count(DISTINCT own) AS keys, sum(mention_count)::BIGINT AS mention_count, max(paper_count) AS paper_count FROM j GROUP BY ALL""")
def curated_features(spark, folder):
    rows = f.with_identity(records(spark, folder), "category_key", "display_name")
    raw = f.with_identity(table(spark, folder, "inventory_rows"), "category", "canonical_feature_name").where("normalized_name <> '' and category is not null")
    alias = text.normalize_name(F.regexp_extract(F.coalesce("matching_aliases", F.lit("")), "^[^|;,]*", 0))
    decided = raw.select("identity", "submitted_at", "feature_id", F.when(alias != "", F.concat("category", F.lit("::"), alias)).alias("target"), (F.trim(F.coalesce("matching_aliases", F.lit(""))) == "").alias("reject"))
    latest = f.last_rows(decided, ["identity"], ["submitted_at", "feature_id"])
    return c.curate(rows.select("identity", "mention_count", "paper_count"), latest, "identity", ["mention_count"], ["paper_count"])


def linked_sql(threshold: str, more: str = "") -> str:
    """The groups linked by pairs at or above a threshold, as the SQL table cc (id, comp)."""
    return f"""m AS (SELECT DISTINCT left_index AS a, right_index AS b FROM similarity_pairs {more} WHERE left_index <> right_index AND NOT isnan(similarity) AND similarity >= {threshold}),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), cc(id, comp) USING KEY (id) AS (SELECT a AS id, min(least(a, b)) AS comp FROM e GROUP BY a UNION
SELECT e.b AS id, min(cc.comp) AS comp FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS r ON r.id = e.b WHERE cc.comp < r.comp GROUP BY e.b)"""


def groups_at(spark, folder, threshold: float):
    p = table(spark, folder, "similarity_pairs").where(F.col("left_index") != F.col("right_index")).where(f"similarity >= {threshold} and not isnan(similarity)")
    return s.linked_groups(p.select(F.col("left_index").alias("a"), F.col("right_index").alias("b")))




def rank():
    return [F.coalesce("paper_count", F.lit(0)), F.coalesce("mention_count", F.lit(0)), -F.length(F.coalesce("display_name", F.lit("")))]


@query("merged_features", f"""WITH RECURSIVE {linked_sql('0.95')}, {RECORDS}, j AS (SELECT r.*, CASE WHEN cc.comp IS NULL THEN 'i' || r.row_index ELSE 'g' || cc.comp END AS g FROM records r LEFT JOIN cc ON cc.id = r.row_index),
b AS (SELECT g, row_index, category_key, display_name FROM j QUALIFY row_number() OVER (PARTITION BY g ORDER BY coalesce(paper_count, 0) DESC, coalesce(mention_count, 0) DESC, length(coalesce(display_name, '')), row_index) = 1)
SELECT b.row_index, b.category_key, b.display_name, count(*) AS members, sum(mention_count)::BIGINT AS mention_count, max(paper_count) AS paper_count FROM j JOIN b USING (g) GROUP BY ALL""")
def merged_features(spark, folder):
    items = records(spark, folder).select("row_index", "category_key", "display_name", "paper_count", "mention_count")
    return c.merge_groups_of(items, groups_at(spark, folder, 0.95), "row_index", rank(), ["mention_count"], ["paper_count"], ["category_key", "display_name"])


@query("absorbed_features", f"""WITH RECURSIVE {linked_sql('0.95')}, {RECORDS}, j AS (SELECT r.*, cc.comp AS g FROM records r JOIN cc ON cc.id = r.row_index),
b AS (SELECT g, row_index AS canonical FROM j QUALIFY row_number() OVER (PARTITION BY g ORDER BY coalesce(paper_count, 0) DESC, coalesce(mention_count, 0) DESC, length(coalesce(display_name, '')), row_index) = 1)
SELECT row_index, category_key, mention_count, canonical, row_number() OVER (PARTITION BY category_key ORDER BY mention_count DESC NULLS LAST, row_index) AS category_rank FROM j JOIN b USING (g) WHERE row_index <> canonical QUALIFY category_rank <= 25""")
def absorbed_features(spark, folder):
    items = records(spark, folder).select("row_index", "category_key", "display_name", "paper_count", "mention_count")
    groups = groups_at(spark, folder, 0.95)
    canonical = s.canonical_items(groups, items, "row_index", rank())
    return c.absorbed_items(items.select("row_index", "category_key", "mention_count"), groups, canonical, "row_index", "category_key", [F.desc_nulls_last("mention_count"), F.asc("row_index")], 25)


@query("sweep_of_category", f"""WITH RECURSIVE {RECORDS}, p AS (SELECT t, a.category_key, left_index AS a, right_index AS b FROM similarity_pairs JOIN records a ON a.row_index = left_index JOIN records b ON b.row_index = right_index, (SELECT unnest([0.85, 0.9, 0.95])::DOUBLE AS t)
 WHERE left_index <> right_index AND NOT isnan(similarity) AND similarity >= t AND a.category_key = b.category_key), e AS (SELECT t, a, b FROM p UNION SELECT t, b, a FROM p),
cc(t, id, comp) USING KEY (t, id) AS (SELECT t, a AS id, min(least(a, b)) AS comp FROM e GROUP BY t, a UNION SELECT e.t, e.b AS id, min(cc.comp) AS comp FROM cc JOIN e ON e.a = cc.id AND e.t = cc.t JOIN recurring.cc AS r ON r.id = e.b AND r.t = e.t WHERE cc.comp < r.comp GROUP BY e.t, e.b)
SELECT cc.t AS threshold, category_key, count(*) AS grouped, count(DISTINCT comp) AS groups, count(*) - count(DISTINCT comp) AS absorbed FROM cc JOIN records ON row_index = id GROUP BY ALL""")
def sweep_of_category(spark, folder):
    own = records(spark, folder).select("row_index", "category_key")
    p = table(spark, folder, "similarity_pairs").select(F.col("left_index").alias("l"), F.col("right_index").alias("r"), "similarity").where("l <> r and not isnan(similarity)")
    both = p.join(own.select(F.col("row_index").alias("l"), "category_key"), "l").join(own.select(F.col("row_index").alias("r"), F.col("category_key").alias("other")), "r").where("category_key = other")
    return s.sweep_by(both.select("l", "r", "similarity"), [0.85, 0.9, 0.95], own, "row_index", "category_key")


KNOWN = f"""k AS (SELECT feature_id AS known, coalesce(category, '') AS category, {NAME.format(c='canonical_feature_name')} AS label, string_split_regex(coalesce(matching_aliases, ''), '[|;,]') AS aliases FROM expected_features),
a AS (SELECT DISTINCT known, category, {NAME.format(c='alias')} AS alias FROM (SELECT known, category, unnest(aliases) AS alias FROM k) UNION SELECT known, category, label FROM k),
x AS (SELECT known, row_index AS row FROM k JOIN records r ON r.name = k.label AND (k.category = '' OR k.category = r.category_key) WHERE k.label <> ''),
n AS (SELECT row_index AS row, category_key, name AS alias FROM records UNION SELECT row_index, category_key, {NAME.format(c='v')} FROM (SELECT row_index, category_key, unnest(aliases) AS v FROM feature_records)),
y AS (SELECT DISTINCT known, row FROM a JOIN n ON a.alias = n.alias AND (a.category = '' OR a.category = n.category_key) WHERE a.alias <> '' AND known NOT IN (SELECT known FROM x)),
f AS (SELECT known, 'name' AS tier, row FROM x UNION ALL SELECT known, 'alias', row FROM y UNION ALL SELECT known, 'none', NULL FROM k WHERE known NOT IN (SELECT known FROM x) AND known NOT IN (SELECT known FROM y))"""


def known_found(spark, folder):
    names = lambda a: F.transform(a, text.normalize_name)
    label = text.normalize_name(F.col("canonical_feature_name"))
    aliases = F.concat(F.array(label), names(F.split(F.coalesce("matching_aliases", F.lit("")), "[|;,]")))
    known = table(spark, folder, "expected_features").select(F.col("feature_id").alias("known"), F.coalesce("category", F.lit("")).alias("category"), label.alias("label"), F.array_distinct(aliases).alias("aliases"))
    own = records(spark, folder)
    rows = own.select(F.col("row_index").alias("row"), F.col("category_key").alias("category"), "name", F.concat(F.array("name"), names(F.coalesce("aliases", F.array().cast("array<string>")))).alias("names"))
    found = c.known_matches(known, rows)
    return known, found.join(own.select(F.col("row_index").alias("row"), "mention_count", "paper_count"), "row", "left")


@query("known_features", f"""WITH {RECORDS}, {KNOWN} SELECT known, tier, count(row) AS matches, coalesce(sum(mention_count), 0)::BIGINT AS mention_count, max(paper_count) AS paper_count, min(row) AS first_row FROM f LEFT JOIN records ON row_index = row GROUP BY ALL""")
def known_features(spark, folder):
    _, found = known_found(spark, folder)
    return found.groupBy("known", "tier").agg(F.count("row").alias("matches"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mention_count"), F.max("paper_count").alias("paper_count"), F.min("row").alias("first_row"))


@query("recall_of_stages", f"""WITH {RECORDS}, {KNOWN}, j AS (SELECT known, row, mention_count, paper_count FROM f LEFT JOIN records ON row_index = row), s AS (SELECT unnest(['extracted', 'supported', 'frequent']) AS stage),
h AS (SELECT stage, known, coalesce(bool_or(CASE stage WHEN 'extracted' THEN row IS NOT NULL WHEN 'supported' THEN paper_count >= 3 ELSE mention_count >= 10 END), false) AS hit FROM j, s GROUP BY ALL)
SELECT stage, count(*) AS expected, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit) AS missing FROM h GROUP BY ALL""")
def recall_of_stages(spark, folder):
    known, found = known_found(spark, folder)
    return c.stage_recall(known, found, {"extracted": F.col("row").isNotNull(), "supported": F.col("paper_count") >= 3, "frequent": F.col("mention_count") >= 10})


#: The least similarity of a pair by category.
LEAST = {"persuasion": 0.97, "moral_framing": 0.95, "sentiment_affect": 0.93}


@query("pairs_of_category", f"""WITH {RECORDS} SELECT left_index, right_index, a.category_key, round(similarity, 6) AS similarity FROM (SELECT DISTINCT left_index, right_index, similarity FROM similarity_pairs) JOIN records a ON a.row_index = left_index JOIN records b ON b.row_index = right_index
WHERE a.category_key = b.category_key AND NOT isnan(similarity) AND round(similarity, 6) >= CASE a.category_key {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items())} END""")
def pairs_of_category(spark, folder):
    own = records(spark, folder).select("row_index", "category_key")
    p = table(spark, folder, "similarity_pairs").select("left_index", "right_index", "similarity").distinct().where("not isnan(similarity)").withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= min(LEAST.values()))
    least = F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])
    both = p.join(own.withColumnRenamed("row_index", "left_index"), "left_index").join(own.select(F.col("row_index").alias("right_index"), F.col("category_key").alias("other")), "right_index").where("category_key = other")
    return both.where(F.col("similarity") >= F.try_element_at(least, F.col("category_key"))).drop("other")


CONTROLS = f"""s AS (SELECT DISTINCT row_index, display_name, synonyms FROM feature_records WHERE trim(display_name) <> ''), o AS (SELECT row_index, display_name, v, min(i) AS i FROM (SELECT row_index, display_name, unnest(synonyms) AS v, generate_subscripts(synonyms, 1) AS i FROM s) WHERE v IS NOT NULL AND trim(v) <> '' AND v <> display_name GROUP BY ALL),
v AS (SELECT row_index, display_name, list(v ORDER BY i) AS vs FROM o GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT row_index, 0 AS variant, display_name AS text FROM v UNION ALL SELECT row_index, 1, vs[1] FROM v UNION ALL SELECT row_index, 2, vs[2] FROM v)"""


@query("control_rows", f"WITH {CONTROLS} SELECT * FROM c")
def control_rows(spark, folder):
    return c.control_rows(records(spark, folder), "row_index", "display_name", "synonyms")


@query("control_pairs", f"WITH {CONTROLS} SELECT a.row_index, a.text AS a, b.text AS b, CASE WHEN a.variant = 0 THEN 'canonical_synonym' ELSE 'synonym_synonym' END AS kind FROM c a JOIN c b ON a.row_index = b.row_index AND a.variant < b.variant")
def control_pairs(spark, folder):
    return c.control_pairs(c.control_rows(records(spark, folder), "row_index", "display_name", "synonyms"), "row_index")


#: A display name without white space at its ends, in DuckDB's SQL.
SHOWN = "regexp_replace(coalesce(display_name, ''), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')"


@query("feature_sections", f"""WITH t AS (SELECT DISTINCT row_index, {SHOWN} AS shown, synonyms FROM feature_records),
u AS (SELECT row_index, 'display name: ' || shown AS head, array_to_string(list_filter(coalesce(synonyms, []), lambda x: x IS NOT NULL AND x <> ''), '; ') AS s FROM t WHERE shown <> ''), x AS (SELECT row_index, CASE WHEN s <> '' THEN head || chr(10) || 'synonyms: ' || s ELSE head END AS body FROM u)
SELECT row_index, sha256('v1' || chr(10) || body) AS cache_key, length(body) AS letters FROM x""")
def feature_sections(spark, folder):
    shown = F.regexp_replace(F.coalesce("display_name", F.lit("")), r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")
    rows = records(spark, folder).withColumn("shown", shown).where("shown <> ''")
    body = values.labelled_text([("display name", F.array("shown")), ("synonyms", F.col("synonyms"))])
    return rows.select("row_index", F.sha2(F.concat(F.lit("v1\n"), body), 256).alias("cache_key"), F.length(body).cast("long").alias("letters"))
