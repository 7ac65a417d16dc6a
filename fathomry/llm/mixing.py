"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_total
from ..shared import Scratch, small_side
from .encoding import token_counts

#: Tokens of a block, the unit that the schedule places; and rows that a bucket of the shuffled order holds, about.
BLOCK_TOKENS, BUCKET_ROWS = 2_048, 20_000
GOLDEN = 0.6180339887498949


def quotas(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source contributes to each mix: the target's columns, ``have`` (tokens of the source), ``wanted`` and ``quota``.

    wanted is the share of the mix's wanted size (size factor times the tokens of all documents); the quota is that, or
    the source's tokens times the repeats allowed if that is less. A source that falls short isn't made up for by
    others, so that none exceeds its own target. A target named twice counts with the sum of its shares.
    """
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    have = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("have"))
    once = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.when(F.count_if(F.col("max_repeats").isNull()) == 0, F.max("max_repeats")).alias("max_repeats"), F.max("size_factor").alias("size_factor")
    )
    found = once.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    wanted = F.round(F.lit(total) * F.col("size_factor") * F.col("target_share")).cast("long")
    most = F.when(F.col("max_repeats").isNull(), F.when(F.col("have") > 0, F.lit(2**62)).otherwise(0)).otherwise(F.col("have") * F.greatest(F.col("max_repeats"), F.lit(0)))
    return found.withColumn("wanted", wanted).withColumn("quota", F.greatest(F.least("wanted", most), F.lit(0)))


def choose(sized: DataFrame, quota: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The copies chosen for each mix: ``mix_id``, ``source``, ``doc_id``, ``copy`` (from 1), ``tokens``, ``at``.

    A quota takes the documents of its source as many whole times as it holds, each time shuffled anew, and then the
    beginning of one more order that comes nearest to the rest, to half a document; ``at`` is where a copy begins, in
    tokens. Orders are placed by buckets, so that a source with most documents costs no large task.
    """
    rows = sized.where("source is not null and tokens > 0").select("doc_id", "source", "tokens")
    buckets = max(1, rows.count() // bucket_rows)
    targets = small_side(quota.where("quota > 0").select("mix_id", "source", "have", "quota"))
    times = F.floor(F.col("quota") / F.col("have")).cast("long")
    rest = F.col("quota") - times * F.col("have")
    each = rows.join(targets, "source").withColumn("_times", times).withColumn("_rest", rest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times") + 1))).where("copy <= _times or _rest > 0")
    shuffled = each.withColumn("_h", F.xxhash64(F.lit(seed), F.when(F.col("copy") <= F.col("_times"), F.col("copy")).otherwise(0), "doc_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    placed = running_total(shuffled, ["mix_id", "source", "copy"], "_b", ["_h", "doc_id"], "tokens", "start")
    taken = placed.where((F.col("copy") <= F.col("_times")) | (F.col("start") + F.col("tokens") / 2 <= F.col("_rest")))
    return taken.select("mix_id", "source", "doc_id", F.col("copy").cast("int").alias("copy"), "tokens", (F.col("start") + (F.col("copy") - 1) * F.col("have")).alias("at"))


def schedule(blocks: DataFrame) -> DataFrame:
    """The slots of each mix: ``mix_id``, ``source``, ``block``, ``slot``. *blocks* has the number of blocks (``n``) of each source.

    Slot i takes the point frac(i * golden ratio) through the cumulative weights of the sources to one of them; the
    k-th slot of a source holds its block k. The points spread evenly, so every stretch of the mix has the shares of
    the whole. Some more slots are made than there are blocks, so that each block finds one.
    """
    spark = blocks.sparkSession
    ordered = Window.partitionBy("mix_id").orderBy("source")
    whole = Window.partitionBy("mix_id")
    weights = blocks.where("n > 0").withColumn("all", F.sum("n").over(whole)).withColumn("upper", F.sum("n").over(ordered) / F.col("all"))
    lines = weights.groupBy("mix_id").agg(F.max("all").alias("all"), F.count("*").alias("sources"), F.array_sort(F.collect_list(F.struct("upper", "source"))).alias("line"))
    slots = F.col("all") + F.col("sources") * (F.ceil(F.log2(F.col("all") + 1)) * 2 + 4)
    parts = lines.select("mix_id", "line", F.explode(F.sequence(F.lit(0), F.floor((slots - 1) / 65_536))).alias("_b"), slots.alias("_n"))
    each = parts.repartition(max(1, spark.sparkContext.defaultParallelism), "mix_id", "_b").withColumn("slot", F.explode(F.sequence(F.col("_b") * 65_536, F.least((F.col("_b") + 1) * 65_536, F.col("_n")) - 1)))
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0))
    source = F.coalesce(F.get(F.filter("line", lambda x: x["upper"] > F.col("_x")), F.lit(0))["source"], F.element_at("line", -1)["source"])
    taken = each.withColumn("_x", point).withColumn("source", source).select("mix_id", "source", "_b", "slot", F.lit(1).cast("long").alias("_one"))
    return running_total(taken, ["mix_id", "source"], "_b", ["slot"], "_one", "block").select("mix_id", "source", "block", "slot")


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixes and the shares reached.

    The first result has a row for each copy: ``mix_id``, ``slot``, ``at`` (its order within the slot), ``source``,
    ``doc_id``, ``copy``, ``tokens``. The second has for each target ``wanted_tokens``, ``reached_tokens``,
    ``target_share``, ``share_of_wanted`` (of the mix's wanted size), ``share_of_mix`` (of what the mix came to),
    ``documents`` and ``most_copies``; sources without documents report 0.

    Method: low-discrepancy source schedule over blocks of equal tokens (see schedule). Sizes are tokens of a public
    tokenizer, counted once. No document occurs more often than its target allows. Running totals are taken by
    buckets of a shuffled order, so that a source with most documents costs no large task. Null and empty texts have
    no tokens and are in no mix, as are documents of no source or of one without target.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    sized = scratch.keep(token_counts(documents.select("doc_id", "source", "text")).select("doc_id", "source", "tokens"), "sized")
    quota = scratch.keep(quotas(sized, targets), "quota")
    chosen = scratch.keep(choose(sized, quota, seed), "chosen")
    blocked = chosen.withColumn("block", F.floor(F.col("at") / block_tokens))
    blocks = blocked.groupBy("mix_id", "source").agg((F.max("block") + 1).alias("n"))
    slots = schedule(blocks)
    placed = blocked.join(slots, ["mix_id", "source", "block"], "left")
    last = F.lit(2**40) + F.col("block")  # never needed while the points spread as they are proven to
    mixed = placed.select("mix_id", F.coalesce("slot", last).alias("slot"), "at", "source", "doc_id", "copy", "tokens")
    reached = chosen.groupBy("mix_id", "source").agg(F.sum("tokens").alias("reached"), F.count_if(F.col("copy") == 1).alias("documents"), F.max("copy").alias("most_copies"))
    report = quota.join(reached, ["mix_id", "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    of_mix = Window.partitionBy("mix_id")
    size = F.sum(F.col("wanted") / F.col("target_share")).over(of_mix) / F.count("*").over(of_mix)
    shares = report.select(
        "mix_id", "source", "target_share", F.col("wanted").alias("wanted_tokens"), F.col("reached").alias("reached_tokens"),
        F.round(F.try_divide("reached", size), 6).alias("share_of_wanted"), F.round(F.try_divide(F.col("reached"), F.sum("reached").over(of_mix)), 6).alias("share_of_mix"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return mixed, shares
