"""Behaviour detectors over flows and names, and the relation that they share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.scalars import let
from tidelane.operators.folds import cooled, ordered_fold
from tidelane.operators.rates import live_distinct_at, live_sum

#: Technique numbers of the kinds of detection.
TECHNIQUES = {"beacon": "T1071", "port_scan": "T1046", "dga": "T1568.002", "dns_tunnel": "T1071.004", "new_domain": "T1568", "conn_flood": "T1498", "data_exfil": "T1048"}


def port_scan(attempts: DataFrame, key: str, success: str, theta0: float = 0.8, theta1: float = 0.2, alpha: float = 0.01, beta: float = 0.01) -> DataFrame:
    """key, n_scanner, n_benign: verdicts of a sequential test over a key's attempts in order; each starts it anew."""
    up, down = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    good, bad = math.log(theta1 / theta0), math.log((1 - theta1) / (1 - theta0))

    def step(s, us, seq, ok):
        total = s[0] + (good if ok else bad)
        scan, benign = total >= up, total <= down
        s[:] = [0.0 if scan or benign else total, s[1] + scan, s[2] + benign]
        return ()

    return ordered_fold(attempts, key, [success], lambda: [0.0, 0, 0], step, "n_scanner long, n_benign long", lambda s: [(s[1], s[2])])


def beacon_scores(contacts: DataFrame, key: list[str], least_gap_s: float, most_gap_s: float, samples: int = 20) -> DataFrame:
    """key, n, mean_gap_s, score of the last `samples` contacts: steady gaps, steady sizes and a long span score high."""
    newest = Window.partitionBy(*key).orderBy(F.desc("us"), F.desc("seq"))
    last = contacts.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= samples)
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*key).orderBy("us", "seq"))) / 1e6
    stats = last.withColumn("gap", gap).groupBy(*key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap_s"), F.stddev_pop("gap").alias("sd"), F.avg("bytes").alias("mb"), F.stddev_pop("bytes").alias("sb"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    steady = lambda sd, mean: 1 - F.least(F.lit(1.0), F.when(mean > 0, sd / mean).otherwise(1.0))
    score = 0.5 * steady(F.col("sd"), F.col("mean_gap_s")) + 0.3 * steady(F.col("sb"), F.col("mb")) + 0.2 * F.least(F.col("span") / 1800, F.lit(1.0))
    return stats.filter((F.col("n") >= 10) & F.col("mean_gap_s").between(least_gap_s, most_gap_s)).select(*key, "n", "mean_gap_s", score.alias("score"))


def connection_flood(starts: DataFrame, key: str, threshold: int, width_us: int, buckets: int, cooldown_us: int) -> DataFrame:
    """key, us, seq of starts at which the live buckets hold `threshold` starts or more, at most one in a cooldown."""
    return cooled(live_sum(starts, key, F.lit(1), width_us, buckets, "live").filter(F.col("live") >= threshold), key, cooldown_us)


def data_exfil(flows: DataFrame, key: str, value: str, alpha: float, least_n: int, least: float, z: float, cooldown_us: int = 0) -> DataFrame:
    """key, n_alarms: values that lie `z` deviations over the smoothed mean of the values before them.

    With a cooldown, alarms count only if they come more than that after the last one that counted.
    """

    def step(s, us, seq, x):
        n, mean, var, alarms, last = s
        d, sd = x - mean, math.sqrt(var)
        fired = n >= least_n and x >= least and sd > 1e-9 and d >= z * sd and (not cooldown_us or last is None or us - last > cooldown_us)
        s[:] = [n + 1, x if n == 0 else mean + alpha * d, 0.0 if n == 0 else (1 - alpha) * (var + d * alpha * d), alarms + fired, us if fired else last]
        return ()

    return ordered_fold(flows.filter(F.col(value).isNotNull()), key, [value], lambda: [0, 0.0, 0.0, 0, None], step, "n_alarms long", lambda s: [(s[3],)])


def rita_scores(contacts: DataFrame, key: list[str], least_gap_s: float, most_gap_s: float, samples: int = 20) -> DataFrame:
    """key, n, ts_score, ds_score, dur_score, score of the last `samples` contacts, ten at least.

    Gaps and sizes score by how symmetric their quartiles are (Bowley's skewness) and by how small their median absolute
    deviation is against the median. At most `samples` values of a key are gathered.
    """
    newest = Window.partitionBy(*key).orderBy(F.desc("us"), F.desc("seq"))
    last = contacts.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= samples)
    last = last.withColumn("__gap", (F.col("us") - F.lag("us").over(Window.partitionBy(*key).orderBy("us", "seq"))) / 1e6)
    each = last.groupBy(*key).agg(F.count("*").alias("n"), F.avg("__gap").alias("mean_gap_s"), F.array_sort(F.collect_list("__gap")).alias("gaps"), F.array_sort(F.collect_list(F.col("bytes").cast("double"))).alias("sizes"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    each = each.filter((F.col("n") >= 10) & F.col("mean_gap_s").between(least_gap_s, most_gap_s))

    def median(xs: Column) -> Column:
        n = F.size(xs)
        return F.when(n == 0, 0.0).when(n % 2 == 0, (F.get(xs, (n / 2).cast("int") - 1) + F.get(xs, (n / 2).cast("int"))) / 2).otherwise(F.get(xs, F.floor(n / 2).cast("int")))

    def score(xs: Column, without: float) -> Column:
        half = F.floor(F.size(xs) / 2).cast("int")
        low, high = F.slice(xs, 1, half), F.slice(xs, F.size(xs) - half + 1, half)
        skew = let(F.struct(median(low).alias("a"), median(xs).alias("b"), median(high).alias("c")), lambda q: F.when((q["c"] - q["a"] >= 10) & (q["b"] != q["a"]) & (q["b"] != q["c"]), (q["a"] + q["c"] - 2 * q["b"]) / (q["c"] - q["a"])).otherwise(0.0))
        mad = let(median(xs), lambda m: F.when(m >= 1, F.greatest((m - median(F.array_sort(F.transform(xs, lambda x: F.abs(x - m))))) / m, F.lit(0.0))).otherwise(without))
        return (1 - F.abs(skew) + mad) / 2

    out = each.select(*key, "n", score(F.col("gaps"), 1.0).alias("ts_score"), score(F.col("sizes"), 0.0).alias("ds_score"), F.least(F.col("span") / 1800, F.lit(1.0)).alias("dur_score"))
    return out.withColumn("score", 0.45 * F.col("ts_score") + 0.35 * F.col("ds_score") + 0.2 * F.col("dur_score"))


def dns_tunnel(names: DataFrame, key: str, domain: str, name: str, least_length: int, least_names: int, width_us: int, buckets: int, cooldown_us: int) -> DataFrame:
    """key, domain, us, seq: queries at which the live buckets hold `least_names` distinct long names under one domain.

    A name counts once while it is live: at its first sighting, and again when it had left the window before.
    """
    long_ones = names.filter(F.octet_length(name) >= least_length)
    keys = [key, domain]
    live = live_distinct_at(long_ones, keys, name, width_us, buckets)
    return cooled(live.filter(F.col("live") >= least_names), keys, cooldown_us)


def new_domains(names: DataFrame, domain: str, ttl_us: int, warm_up_us: int) -> DataFrame:
    """`names` (us, seq) whose domain is new or was last seen more than `ttl_us` before, once the warm-up is over.

    The warm-up begins with the first row of all.
    """
    gap = F.col("us") - F.lag("us").over(Window.partitionBy(domain).orderBy("us", "seq"))
    begun = names.agg(F.min("us").alias("__begun"))  # one row
    fresh = names.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") > ttl_us)).drop("__gap")
    return fresh.join(F.broadcast(begun), F.col("us") - F.col("__begun") >= warm_up_us).drop("__begun")


def bigram_scores(names: DataFrame, column: str, model: DataFrame) -> DataFrame:
    """`names` with score: mean log-likelihood of the name's bigrams under `model` (bigram, n), one added to each count.

    There are 37 symbols, so a first letter has 37 followers.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, 2))
    known = model.withColumn("of", F.sum("n").over(Window.partitionBy(F.substring("bigram", 1, 1))))
    firsts = known.groupBy(F.substring("bigram", 1, 1).alias("first")).agg(F.max("of").alias("of"))
    each = names.filter(F.length(column) >= 2).select(column).distinct().select(column, F.explode(pairs).alias("bigram"))
    each = each.join(known.select("bigram", "n"), "bigram", "left").join(firsts, F.substring("bigram", 1, 1) == F.col("first"), "left")
    return each.groupBy(column).agg(F.avg(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("of", F.lit(0)) + 37))).alias("score"))


def anomalies(*found: tuple[str, str, DataFrame, str]) -> DataFrame:
    """kind, severity, technique, src of what detectors have found: (kind, severity, frame, key column)."""
    out = None
    for kind, severity, frame, key in found:
        one = frame.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(TECHNIQUES[kind]).alias("technique"), F.col(key).alias("src"))
        out = one if out is None else out.unionByName(one)
    return out
