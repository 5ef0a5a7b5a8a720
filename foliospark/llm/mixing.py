"""Problem 9: mix sources to target shares of the total token count.

Every record gets a hash-random key; records of a source are ordered by it.  The
order is never established in one task: the key's leading bits cut each source
into buckets, bucket sums are prefix-summed on a table whose size is the number
of listed sources times the number of buckets, and only within a bucket rows
are ordered.  A source's budget then falls into whole repeats of the source and
one partial pass that ends at the row where the prefix sum passes the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: Leading bits of the key that make a bucket: 4,096 buckets a source.
BUCKET_BITS = 12


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(mix_name, source, weight, max_repeats, target_share, available, budget, wanted) for each listed source.

    ``sizes``: (source, n_tokens) of the sources.  Without ``total`` a mix is as
    large as its scarcest source with any tokens allows, so that all such
    sources reach their shares; a source without tokens gets budget 0, and the
    others keep their shares relative to one another.  ``wanted`` is the share of
    the requested total, or without one of the mix, whether or not it can be had.
    """
    mix = Window.partitionBy("mix_name")
    t = (
        targets.where((F.col("weight") > 0) & F.col("source").isNotNull())
        .groupBy("mix_name", "source")
        .agg(F.sum("weight").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
        .join(sizes.select("source", F.col("n_tokens").alias("available")), "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("target_share", F.col("weight") / F.sum("weight").over(mix))
        .withColumn("_usable", F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("weight")))
        .withColumn("_share", F.col("_usable") / F.sum("_usable").over(mix))
    )
    most = F.min(F.floor(F.col("available") * F.col("max_repeats") / F.col("_share"))).over(mix)
    size = most if total is None else F.least(most, F.lit(total))
    return t.withColumn("_total", size).select(
        "mix_name", "source", "weight", "max_repeats", "target_share", "available",
        F.coalesce(F.round(F.col("_total") * F.col("_share")), F.lit(0)).cast("long").alias("budget"),
        F.round((F.col("_total") if total is None else F.lit(total)) * F.col("target_share")).cast("long").alias("wanted"),
    )


def mix(records: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``records``: (doc_id, source, n_tokens).  selection: mix_name, doc_id,
    source, n_tokens, repeats (1 to max_repeats).  report: a row for each listed
    source with its target and actual share and the tokens it falls short by; sources without records stay in it.
    Records of 0 or null tokens are never selected.
    """
    wanted = targets.select("source").distinct()
    keyed = (
        records.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
        .join(wanted, "source", "left_semi")
        .select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "source", "doc_id").alias("_key"))
        .withColumn("_bucket", F.shiftrightunsigned("_key", 64 - BUCKET_BITS))
    )
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    # bounded: listed sources x 2**BUCKET_BITS rows
    order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.withColumn("_inside", F.sum("n_tokens").over(inside))
        .join(before, ["source", "_bucket"])
        .withColumn("_end", F.col("_before") + F.col("_inside"))
        .select("doc_id", "source", "n_tokens", "_end")
    )
    planned = plan(sums.groupBy("source").agg(F.sum("_n").alias("n_tokens")), targets, total).withColumn(
        "_full", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    ).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("available"))
    # the record that crosses the budget is taken when more than half of it fits
    extra = ((F.col("_end") - F.col("n_tokens") / 2 < F.col("_rest")) & (F.col("_full") < F.col("max_repeats"))).cast("int")
    selection = (
        placed.join(planned, "source")
        .withColumn("repeats", (F.col("_full") + extra).cast("int"))
        .where("repeats > 0")
        .select("mix_name", "doc_id", "source", "n_tokens", "repeats")
    )
    used = selection.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats")
    )
    report = (
        planned.join(used, ["mix_name", "source"], "left")
        .withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
        .withColumn("actual_share", F.col("actual_tokens") / F.sum("actual_tokens").over(Window.partitionBy("mix_name")))
        .select(
            "mix_name", "source", "weight", "max_repeats", "target_share", "available", "budget", "actual_tokens", "actual_share",
            F.greatest(F.coalesce("wanted", F.lit(0)) - F.col("actual_tokens"), F.lit(0)).alias("shortfall"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
    return selection, report
