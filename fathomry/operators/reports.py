"""What reports are made of: final sets, citations, sections, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .running import running_total


def final_set(a: DataFrame, b: DataFrame, peaks: DataFrame) -> DataFrame:
    """The union of the two sets' first k features of each category, k being where they agree most: ``category``, ``name``,
    ``membership``, ``rank_1``, ``rank_2``, ``support`` (the greater), ``final_rank``."""
    tops = [s.join(F.broadcast(peaks.select("category", "peak_k")), "category").where("rank <= peak_k").drop("peak_k") for s in (a, b)]  # a row for each category
    x, y = tops[0].alias("x"), tops[1].alias("y")
    both = x.join(y, (F.col("x.category") == F.col("y.category")) & (F.col("x.name") == F.col("y.name")), "full_outer")
    member = F.when(F.col("x.name").isNotNull() & F.col("y.name").isNotNull(), "both").when(F.col("x.name").isNotNull(), "set_1_only").otherwise("set_2_only")
    found = both.select(F.coalesce("x.category", "y.category").alias("category"), F.coalesce("x.name", "y.name").alias("name"), member.alias("membership"), F.col("x.rank").alias("rank_1"), F.col("y.rank").alias("rank_2"), F.greatest("x.support", "y.support").alias("support"))
    order = F.when(F.col("membership") == "both", 0).when(F.col("membership") == "set_1_only", 1).otherwise(2)
    return found.withColumn("final_rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("support"), order, "name")))


def shared_points(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The features in both sets' first k with both supports."""
    x, y = a.where(F.col("rank") <= k).alias("x"), b.where(F.col("rank") <= k).alias("y")
    return x.join(y, (F.col("x.category") == F.col("y.category")) & (F.col("x.name") == F.col("y.name"))).select("x.category", "x.name", F.col("x.support").alias("support_1"), F.col("y.support").alias("support_2"))


def percentile_series(rows: DataFrame, value: str, least: float = 50.0, parts: int = 1_000) -> DataFrame:
    """The distinct values in order with the percentile that the first of them has among all rows, (i / (n - 1)) * 100, from *least* on.

    Equal values are counted first, and counts run over parts of the range, so no task orders all rows.
    """
    counted = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    span = counted.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.sum("_n").alias("_all"))
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width * parts), F.lit(parts - 1))).otherwise(0).cast("long")
    placed = running_total(counted.join(F.broadcast(span), F.lit(True)).withColumn("_part", part).withColumn("_g", F.lit(0)), ["_g"], "_part", ["value"], "_n", "_before")
    at = F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1) * 100).otherwise(100.0)
    return placed.select("value", F.col("_n").alias("rows"), F.round(at, 6).alias("percentile")).where(F.col("percentile") >= least)


def status_counts(rows: DataFrame, group: Column, name: str, status: str, statuses: list[str]) -> DataFrame:
    """The rows of each group and status; statuses without rows are 0."""
    return rows.groupBy(group.alias(name)).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count_if(F.col(status).isNull() | ~F.col(status).isin(*statuses)).alias("other"))


def checked_citations(reports: DataFrame, key: str, text: str, known: DataFrame, pattern: str, paragraph: int = 280) -> DataFrame:
    """For each report: ``cited`` (distinct citations), ``invalid`` (those not in *known*, column ``citation``), and ``uncited`` (paragraphs
    longer than *paragraph* characters without any). Citations are what *pattern* finds, within its first group."""
    cited = reports.select(key, F.explode(F.array_distinct(F.regexp_extract_all(t.text_or_empty(F.col(text)), F.lit(pattern), F.lit(1)))).alias("citation"))
    marked = cited.join(known.select("citation", F.lit(True).alias("_known")).distinct(), "citation", "left")
    counted = marked.groupBy(key).agg(F.count("*").alias("cited"), F.count_if(F.col("_known").isNull()).alias("invalid"))
    paragraphs = F.split(t.text_or_empty(F.col(text)), r"\n\s*\n")
    bare = F.size(F.filter(paragraphs, lambda p: (F.length(p) > paragraph) & ~p.rlike(pattern)))
    return reports.select(key, bare.alias("uncited")).join(counted, key, "left").fillna(0, ["cited", "invalid"])


def grouped_lines(texts: DataFrame, key: str, text: str, begins: str) -> DataFrame:
    """The lines of each text in sections: *key*, ``section`` (0 before the first), ``lines``, ``letters``. A line that *begins* matches begins one."""
    lines = F.split(t.text_or_empty(F.col(text)), "\n")
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(begins), i)), lambda i: i.isNotNull())
    each = texts.select(key, starts.alias("_s"), F.posexplode(lines).alias("_i", "line"))
    section = F.size(F.filter("_s", lambda s: s <= F.col("_i")))
    return each.groupBy(key, section.alias("section")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("letters"))


def domain_terms(texts: DataFrame, key: str, text: str, stop: list[str], most: int = 30) -> DataFrame:
    """The special terms of each text in order: capital abbreviations that aren't in *stop*, then words with hyphens longer than five letters; at most *most*."""
    words = F.split(t.text_or_empty(F.col(text)), r"[^\p{L}\p{N}-]+")
    short = F.filter(words, lambda w: w.rlike("^[A-Z][A-Z0-9]{1,9}$") & ~w.isin(*stop))
    long = F.filter(words, lambda w: w.rlike("^[a-z]+(?:-[a-z]+)+$") & (F.length(w) > 5))
    return texts.select(key, F.slice(F.array_distinct(F.concat(short, long)), 1, most).alias("terms"))


def match_reasons(seeds: DataFrame, results: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of a seed and a result that mean one paper, with the first reason that holds: ``seed``, ``result``, ``reason``.

    Both have ``id``, ``doi``, ``arxiv``, ``title``, ``author``, ``year`` and ``words`` (distinct content words), normalized. Reasons: doi, arxiv, title;
    else words that overlap by *least* with the same author and year, or the same author. Each reason is an equi-join. That
    titles overlap in the same year without the same author is no reason here: it would compare all papers of a year.
    """
    s, r = seeds.alias("s"), results.alias("r")
    exact = [s.join(r, F.col(f"s.{k}") == F.col(f"r.{k}")).select(F.col("s.id").alias("seed"), F.col("r.id").alias("result"), F.lit(n).alias("n")) for n, k in enumerate(("doi", "arxiv", "title"))]
    alike = t.overlap(F.col("s.words"), F.col("r.words")) >= least
    year = F.coalesce(F.col("s.year") == F.col("r.year"), F.lit(False))
    signed = s.join(r, F.col("s.author") == F.col("r.author")).where(alike).select(F.col("s.id").alias("seed"), F.col("r.id").alias("result"), F.when(year, 3).otherwise(4).alias("n"))
    every = exact[0].unionByName(exact[1]).unionByName(exact[2]).unionByName(signed)
    names = F.array(*[F.lit(x) for x in ("doi", "arxiv", "title", "title_overlap_author_year", "title_overlap_author")])
    return every.groupBy("seed", "result").agg(F.min("n").alias("n")).select("seed", "result", F.get(names, F.col("n")).alias("reason"))
