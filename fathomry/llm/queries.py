"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..tables import table
from . import canonical, components, encoding, langid, matching, mixing, scans, survivors


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.merge_groups(table(spark, folder, "similarity_pairs"), 0.9).select("group_id", "row_index")


def expected_names(expected: DataFrame) -> DataFrame:
    """``group``, ``name`` and ``entry`` of the canonical names and aliases of the reference list."""
    aliases = split_packed(expected, ["feature_id", "category"], ["matching_aliases"]).select("category", "feature_id", "value")
    names = expected.select("category", "feature_id", F.col("canonical_feature_name").alias("value")).unionByName(aliases)
    return names.select(F.col("category").alias("group"), F.col("value").alias("name"), F.col("feature_id").alias("entry"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "feature_records")
    group = canonical.group_of(F.col("category_key"), F.col("feature_key"), F.col("category"))
    found = canonical.map_records(records, expected_names(table(spark, folder, "expected_features")), "row_index", "display_name", group)
    return found.select("row_index", F.col("entry").alias("feature_id")).distinct()


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_references(table(spark, folder, "cited_refs"), table(spark, folder, "candidates"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_matches(spark, folder).select("pos", "ref_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = survivors.with_venues(table(spark, folder, "candidates"), table(spark, folder, "venues"))
    fields = survivors.candidate_fields()
    best = survivors.survivors(rows, fields, "dup_group", survivors.source_rank(F.col("source_apis")), "loaded_at", "pos")
    return survivors.sole_values(best, [f.name for f in fields])


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.candidate_survivors(table(spark, folder, "candidates"), table(spark, folder, "venues"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repairs(table(spark, folder, "chunks"), table(spark, folder, "papers"), table(spark, folder, "venues")).select("chunk_id", "line_no", "kind", "word").distinct()


def p6_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.paragraphs(table(spark, folder, "chunks"), table(spark, folder, "papers"), table(spark, folder, "venues"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_documents(table(spark, folder, "documents")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of each text that comes back from its ids: an exact round trip over all documents."""
    return encoding.decode_documents(p7_ids(spark, folder)).select("doc_id", F.md5("text").alias("digest"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def language_model(spark: SparkSession, folder: str) -> langid.Model:
    return langid.train(table(spark, folder, "lang_samples"), table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.unstated_languages(table(spark, folder, "documents"), language_model(spark, folder)).distinct()


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.passages(table(spark, folder, "documents"), language_model(spark, folder))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(langid.passages(table(spark, folder, "documents"), language_model(spark, folder), with_text=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_found": p6_found,
    "p6_paragraphs": p6_paragraphs,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p9_documents": p9_documents,
}

_TRIMMED = r"regexp_replace(coalesce({c}, ''), '^[\s\x{{a0}}\x{{200b}}]+|[\s\x{{a0}}\x{{200b}}]+$', '', 'g')"
_STAND_INS = ", ".join(f"'{x}'" for x in survivors.STAND_INS)
_PLAIN = "regexp_replace(lower(" + _TRIMMED + "), '^[\\[(<\"'']+|[\\])>\"''.]+$', '', 'g')"

#: SQL for DuckDB where it can express the operator over whole tables.
ORACLES: dict[str, str] = {
    "p1_found": """WITH RECURSIVE m AS (SELECT DISTINCT left_index AS a, right_index AS b FROM similarity_pairs WHERE left_index <> right_index AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.9),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), cc(id, comp) USING KEY (id) AS (
SELECT a AS id, min(least(a, b)) AS comp FROM e GROUP BY a UNION
SELECT e.b AS id, min(cc.comp) AS comp FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS r ON r.id = e.b WHERE cc.comp < r.comp GROUP BY e.b)
SELECT comp AS group_id, id AS row_index FROM cc""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p5_found": f"""WITH c AS (SELECT pos, dup_group, {_TRIMMED.format(c='abstract')} AS a, {_PLAIN.format(c='abstract')} AS p, lower(regexp_replace({_TRIMMED.format(c='venue')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS v,
 len(list_filter(coalesce(candidate_pdf_urls, []), lambda x: x IS NOT NULL AND regexp_matches({_TRIMMED.format(c='x')}, '(?i)^https?://[^\\s/?#]+\\.?[^\\s]*$'))) AS n FROM candidates WHERE dup_group IS NOT NULL),
w AS (SELECT dup_group, 'abstract' AS field, pos FROM c WHERE p NOT IN ({_STAND_INS}) AND NOT regexp_matches(a, '(?i){survivors.CUT}') AND regexp_matches(a, '{survivors.SENTENCE_END.replace("'", "''")}')
UNION ALL SELECT dup_group, 'venue', pos FROM c WHERE v IN (SELECT lower(venue_name) FROM venues) UNION ALL SELECT dup_group, 'candidate_pdf_urls', pos FROM c WHERE n > 0)
SELECT dup_group, field, min(pos) AS pos FROM w GROUP BY ALL HAVING count(*) = 1""",
}
