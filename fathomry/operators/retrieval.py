"""Word windows, postings, ranked search and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import Scratch, rows_if_small, small_side

#: The constants of the BM25 formula.
K1, B = 1.2, 0.75
#: Terms of a query, at most; and terms of all queries up to which the words of a text are compared with each of them at once.
QUERY_TERMS, FEW_TERMS = 14, 2_000


def chunk_words(documents: DataFrame, key: str, text: str, size: int = 700, step_back: int = 80, least: int = 40) -> DataFrame:
    """The word windows of each text: *key*, ``chunk_index`` (given before short ones are dropped), ``text``, ``words``."""
    made = documents.select(key, F.posexplode(t.word_windows(F.col(text), size, step_back)).alias("chunk_index", "text"))
    return made.withColumn("words", F.size(F.split("text", " "))).where(F.col("words") >= least)


def page_chunks(pages: DataFrame, paper: str, page: str, keep: list[str], text: str, size: int = 700, step_back: int = 80, least: int = 40) -> DataFrame:
    """The word windows of each page: *keep*, *paper*, *page*, ``piece`` (paper:pP:cI, counted before short ones are dropped), ``text``, ``words``."""
    made = pages.select(*keep, paper, page, F.posexplode(t.word_windows(F.col(text), size, step_back)).alias("_i", "text"))
    piece = F.concat(F.col(paper), F.lit(":p"), F.col(page).cast("string"), F.lit(":c"), F.col("_i").cast("string"))
    return made.select(*keep, paper, page, piece.alias("piece"), "text", F.size(F.split("text", " ")).alias("words")).where(F.col("words") >= least)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """The first distinct words of each query: *key*, ``term``."""
    return queries.select(key, F.explode(F.slice(F.array_distinct(t.tokens(F.col(text))), 1, QUERY_TERMS)).alias("term"))


def bm25(documents: DataFrame, queries: DataFrame, document: str, text: str, query: str, query_text: str, limit: int) -> DataFrame:
    """The *limit* best documents of each query: *query*, *document*, ``score``, ``rank``.

    Texts are read once: what is kept of each are its length and its words that are a query's. Document lengths and
    frequencies count all documents. Queries are a set checked for its size and broadcast, or joined by shuffle beyond
    it. Ties go to the lower document.
    """
    scratch = Scratch(documents.sparkSession)
    terms = query_terms(queries, query, query_text)
    words = documents.select(document, t.tokens(F.col(text)).alias("_w"))
    wanted = terms.select("term").distinct()
    few = rows_if_small(wanted, FEW_TERMS)
    hits = F.filter("_w", lambda w: w.isin(*[r.term for r in few])) if few is not None else F.col("_w")
    held = scratch.keep(words.select(document, F.size("_w").alias("length"), hits.alias("_w")), "hits")
    sizes = held.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    each = held.select(document, "length", F.explode("_w").alias("term"))
    each = each if few is not None else each.join(small_side(wanted), "term")
    postings = scratch.keep(each.groupBy(document, "term").agg(F.max("length").alias("length"), F.count("*").alias("tf")), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = frequency.join(F.broadcast(sizes), F.lit(True)).select("term", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"), "mean")
    tf = F.col("tf")
    score = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = postings.join(small_side(weights), "term").select(document, "term", score.alias("s")).join(small_side(terms), "term").groupBy(query, document).agg(F.round(F.sum("s"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), document)))
    return ranked.where(F.col("rank") <= limit)


def term_counts(documents: DataFrame, queries: DataFrame, document: str, text: str, query: str, query_text: str, limit: int) -> DataFrame:
    """The *limit* documents in which a query's distinct content words occur most often; none without any."""
    terms = queries.select(query, F.explode(F.array_distinct(t.content_tokens(F.col(query_text)))).alias("term"))
    wanted = small_side(terms.select("term").distinct())
    counted = documents.select(document, F.explode(t.tokens(F.col(text))).alias("term")).join(wanted, "term").groupBy(document, "term").agg(F.count("*").alias("tf"))
    scored = counted.join(small_side(terms), "term").groupBy(query, document).agg(F.sum("tf").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), document))).where(F.col("rank") <= limit)


def evidence(results: DataFrame, query: str, document: str, most: int) -> DataFrame:
    """The first *most* documents over all queries in their order; the first query wins a document."""
    first = results.groupBy(document).agg(F.min(F.struct(query, "rank", "score")).alias("w")).select(F.col(f"w.{query}").alias(query), document, "w.rank", "w.score")
    return first.orderBy(query, "rank", document).limit(most)


def keyword_ngrams(documents: DataFrame, text: str, longest: int, limit: int) -> DataFrame:
    """The best-scored n-grams of content words over all texts, single words and phrases apart.

    score = count * (1 + 0.35 (n - 1)), plus 0.5 for phrases. N-grams of one repeated word count only for n = 1.
    """
    words = documents.select(t.content_tokens(F.col(text)).alias("w"))
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), t.ngrams(F.col("w"), n).alias("g")) for n in range(1, longest + 1)]))
    made = words.select(sizes.alias("s")).select("s.n", F.explode("s.g").alias("phrase"))
    counted = made.groupBy("n", "phrase").agg(F.count("*").alias("occurrences"))
    counted = counted.where((F.col("n") == 1) | (F.size(F.array_distinct(F.split("phrase", " "))) > 1))
    score = F.round(F.col("occurrences") * (1.0 + (F.col("n") - 1) * 0.35) + F.when(F.col("n") > 1, 0.5).otherwise(0.0), 4)
    scored = counted.withColumn("score", score).withColumn("kind", F.when(F.col("n") == 1, "keyword").otherwise("phrase"))
    # a limit on the rank, so that each task hands on its own best only
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "phrase"))).where(F.col("rank") <= limit).select("kind", "rank", "phrase", "occurrences", "score")


def top_terms(documents: DataFrame, group: str, document: str, text: str, limit: int) -> DataFrame:
    """The terms in most documents of each group: *group*, ``term``, ``documents``, ``mentions``, ``rank``."""
    per_document = documents.where(F.col(group).isNotNull()).select(group, document, F.explode(t.content_tokens(F.col(text))).alias("term")).groupBy(group, document, "term").agg(F.count("*").alias("m"))
    counted = per_document.groupBy(group, "term").agg(F.count("*").alias("documents"), F.sum("m").alias("mentions"))
    order = Window.partitionBy(group).orderBy(F.desc("documents"), F.desc("mentions"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
