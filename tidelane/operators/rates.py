"""Bucketed sliding windows, sightings, histograms and quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_sum(packets: DataFrame, key: str, value: Column, width_us: int, buckets: int, name: str) -> DataFrame:
    """`packets` with the sum of `value` over the live buckets of its key at its own time, itself included.

    A bucket is live while its start is at most `buckets` widths ago. The whole buckets come from a range frame over
    bucket numbers, the packet's own bucket from a running sum; the oldest one is live only on a bucket's edge.
    """
    packets = packets.withColumn("__b", F.floor(F.col("us") / width_us)).withColumn("__v", value)
    by_bucket = Window.partitionBy(key).orderBy("__b")
    own = Window.partitionBy(key, "__b").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.coalesce(F.sum("__v").over(by_bucket.rangeBetween(1 - buckets, -1)), F.lit(0))
    edge = F.when(F.col("us") % width_us == 0, F.coalesce(F.sum("__v").over(by_bucket.rangeBetween(-buckets, -buckets)), F.lit(0))).otherwise(0)
    return packets.withColumn(name, whole + edge + F.sum("__v").over(own)).drop("__b", "__v")


def live_distinct(packets: DataFrame, key: str, value: str, width_us: int, buckets: int) -> DataFrame:
    """key, bucket, distinct values of the buckets that are live at the end of each bucket with packets.

    No sets are gathered: a value is live from a bucket that has it until `buckets` later, or until its next sighting
    takes over. These beginnings and ends are counted up in order.
    """
    seen = packets.groupBy(key, F.floor(F.col("us") / width_us).alias("bucket"), value).agg(F.lit(1).alias("x"))
    later = F.lead("bucket").over(Window.partitionBy(key, value).orderBy("bucket"))
    spans = seen.select(key, F.col("bucket").alias("at"), F.least(later, F.col("bucket") + buckets).alias("until"))
    spans = spans.withColumn("until", F.coalesce("until", F.col("at") + buckets))
    steps = spans.select(key, F.col("at").alias("bucket"), F.lit(1).alias("d"), F.lit(1).alias("own")).unionByName(spans.select(key, F.col("until").alias("bucket"), F.lit(-1).alias("d"), F.lit(0).alias("own")))
    each = steps.groupBy(key, "bucket").agg(F.sum("d").alias("d"), F.max("own").alias("own"))
    return each.withColumn("n_distinct", F.sum("d").over(Window.partitionBy(key).orderBy("bucket"))).filter("own = 1").select(key, "bucket", "n_distinct")


def live_distinct_at(rows: DataFrame, keys: list[str], value: str, width_us: int, buckets: int) -> DataFrame:
    """`rows` (us, seq) with live: distinct values of the buckets that are live at each row, itself included.

    A value leaves when the bucket of its last sighting does, `buckets` widths after that bucket's start.
    """
    start = F.floor(F.col("us") / width_us) * width_us
    rows = rows.withColumn("__until", start + buckets * width_us)
    w = Window.partitionBy(*keys, value).orderBy("us", "seq")
    rows = rows.withColumn("__over", F.lag("__until").over(w)).withColumn("__next", F.lead("us").over(w))
    new = F.col("__over").isNull() | (F.col("us") > F.col("__over"))
    gone = F.col("__next").isNull() | (F.col("__next") > F.col("__until"))
    come = rows.withColumn("__d", new.cast("long")).withColumn("__at", F.col("us")).withColumn("__own", F.lit(1))
    # Just after its last moment a value is gone: such steps come after all rows of that moment.
    go = rows.filter(gone).withColumn("__d", F.lit(-1).cast("long")).withColumn("__at", F.col("__until")).withColumn("__own", F.lit(2))
    both = come.unionByName(go)
    live = F.sum("__d").over(Window.partitionBy(*keys).orderBy("__at", "__own", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("live", live).filter("__own = 1").drop("__until", "__over", "__next", "__d", "__at", "__own")


def live_quantiles(packets: DataFrame, key: str, value: str, q: float, alpha: float, width_us: int, buckets: int) -> DataFrame:
    """key, bucket, quantile of the values in the buckets that are live at the end of each bucket with packets.

    Each bucket's sketch has bins of relative error `alpha`; a window merges those of its buckets by adding the bins up.
    """
    gamma = (1 + alpha) / (1 - alpha)
    bucket = F.floor(F.col("us") / width_us)
    bins = packets.groupBy(key, bucket.alias("of"), F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / math.log(gamma))).alias("bin")).agg(F.count("*").alias("n"))
    there = bins.select(key, F.col("of").alias("bucket")).distinct()
    into = bins.withColumn("bucket", F.explode(F.sequence(F.col("of"), F.col("of") + buckets - 1))).join(there, [key, "bucket"], "left_semi")
    merged = into.groupBy(key, "bucket", "bin").agg(F.sum("n").alias("n"))
    return sketch_quantile(merged, [key, "bucket"], q, alpha)


def first_seen(packets: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """Packets whose keys are new: never seen, or last seen more than `ttl_us` before."""
    gap = F.col("us") - F.lag("us").over(Window.partitionBy(*keys).orderBy("us", "seq"))
    return packets.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") > ttl_us)).drop("__gap")


def histogram(frame: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """bucket, n: values by half-open buckets; a value on a boundary goes up, and what isn't finite is left out."""
    bucket = sum((F.col(value) >= b).cast("int") for b in bounds)
    return frame.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def log_bounds(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def sketch_bins(frame: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, bin, n of a sketch with relative error `alpha`: bins of the logarithm; values up to 0 are in bin null."""
    gamma = (1 + alpha) / (1 - alpha)
    return frame.groupBy(key, F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / math.log(gamma))).alias("bin")).agg(F.count("*").alias("n"))


def collapsed(bins: DataFrame, key: str, most: int) -> DataFrame:
    """The sketch with at most `most` bins for each key: the lowest ones are added up into the lowest that stays."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("bin").desc_nulls_last()))
    kept = bins.withColumn("__r", rank).withColumn("__floor", F.min(F.when(F.col("__r") <= most, F.col("bin"))).over(Window.partitionBy(key)))
    return kept.withColumn("bin", F.when(F.col("bin").isNotNull(), F.greatest("bin", "__floor"))).groupBy(key, "bin").agg(F.sum("n").alias("n"))


def sketch_quantile(bins: DataFrame, key: str | list[str], q: float, alpha: float) -> DataFrame:
    """Value of the bin that holds rank round(q * (n - 1)) of each key."""
    gamma = (1 + alpha) / (1 - alpha)
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first()))
    ranked = bins.withColumn("upto", upto).withColumn("rank", F.round(q * (F.sum("n").over(w) - 1)))
    hit = ranked.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return hit.select(*keys, F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bin")) / (gamma + 1)).alias("quantile"))


def welford(frame: DataFrame, key: str, value: str) -> DataFrame:
    return frame.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"), F.var_samp(value).alias("var_samp"), F.min(value).alias("least"), F.max(value).alias("most"))


def top_n(frame: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    return frame.groupBy(key).agg(value.alias("total")).orderBy(F.desc("total"), key).limit(n)
