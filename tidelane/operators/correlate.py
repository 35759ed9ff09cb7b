"""Rows that belong together: pairs of requests and responses, names, bindings, indicators, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_fifo(rows: DataFrame, key: str, order: str, requests: Column, responses: Column) -> DataFrame:
    """key, n, request, response: the n-th request of a key with its n-th response, which may be missing."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda side: rows.filter(side).select(key, F.row_number().over(w).alias("n"), F.col(order).alias("at"))
    return number(requests).withColumnRenamed("at", "request").join(number(responses).withColumnRenamed("at", "response"), [key, "n"], "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, ttl_us: int) -> DataFrame:
    """`left` (us, seq) with the last `value` of `right` at or before it, unless that is more than `ttl_us` old.

    Both sides are put in one order and the last value is carried on, so there is one shuffle and no join by ranges.
    """
    both = left.withColumn("__v", F.lit(None).cast("struct<us:long,v:string>")).withColumn("__left", F.lit(1)).unionByName(right.select(*keys, "us", "seq", F.struct(F.col("us"), F.col(value).cast("string").alias("v")).alias("__v"), F.lit(0).alias("__left")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("us", "__left", "seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__left = 1")
    return carried.withColumn("name", F.when(F.col("us") - F.col("__last.us") <= ttl_us, F.col("__last.v"))).drop("__v", "__left", "__last")


def bindings(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`rows` with change: new, refresh or changed, and the prior value."""
    prior = F.lag(value).over(Window.partitionBy(key).orderBy("us", "seq"))
    return rows.withColumn("prior", prior).withColumn("change", F.when(F.col("prior").isNull(), "new").when(F.col("prior") == F.col(value), "refresh").otherwise("changed"))


def flag_is_set(events: DataFrame, flags: DataFrame, key: str, ttl_us: int) -> DataFrame:
    """`events` with is_set: whether the last flag of the key is less than `ttl_us` old."""
    found = as_of(events, flags.withColumn("__one", F.lit("1")), [key], "__one", ttl_us - 1)
    return found.withColumn("is_set", F.col("name").isNotNull()).drop("name")


def suffixes(domain: Column) -> Column:
    """The domain and what is left of it without its first label, first two labels, ..."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def indicator_match(names: DataFrame, column: str, indicators: DataFrame) -> DataFrame:
    """`names` with the most specific indicator (a domain) that `column` is or lies under; others are left out."""
    each = names.select("*", F.posexplode(suffixes(F.lower(F.col(column)))).alias("__depth", "indicator"))
    hit = each.join(indicators.select(F.lower("indicator").alias("indicator")).distinct(), "indicator")
    return hit.groupBy(*names.columns).agg(F.min_by("indicator", "__depth").alias("indicator"))


def merge_assets(facts: DataFrame, key: str, scalars: list[str], lists: dict[str, int]) -> DataFrame:
    """One row for each key: last known scalars, the latest distinct values of each list, first and last sighting."""
    stamp = F.struct("us", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in scalars]
    each = facts.groupBy(key).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), *last)
    for c, most in lists.items():
        values = facts.filter(F.col(c).isNotNull()).groupBy(key, c).agg(F.min(stamp).alias("at")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", c))).alias("v"))
        newest = F.slice(F.col("v"), F.greatest(F.size("v") - most + 1, F.lit(1)), most)
        each = each.join(values.select(key, newest[c].alias(c)), key, "left")
    return each
