"""Sketches as relations of cells: built by grouping, merged by adding or taking the larger, asked by a join.

A sketch of one key is a bounded number of rows, so partial results of shards are merged by the same grouping.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.wire import hexed
from tidelane.operators.folds import ordered_fold
from tidelane.operators.keys import fnv1a


def places(value: Column, depth: int, width: int) -> Column:
    """array<struct<row, cell>>: a cell in each of `depth` rows, by two hashes."""
    h1, h2 = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.pmod(h1, F.lit(width)) + i * F.pmod(h2, F.lit(width)), F.lit(width)).alias("cell")))


def count_min(frame: DataFrame, key: str, value: str, depth: int = 4, width: int = 2048) -> DataFrame:
    """key, row, cell, n of a count-min sketch."""
    values = frame.groupBy(key, value).agg(F.count("*").alias("n"))
    return values.select(key, F.explode(places(F.col(value), depth, width)).alias("p"), "n").groupBy(key, "p.row", "p.cell").agg(F.sum("n").alias("n"))


def merge_cells(*sketches: DataFrame) -> DataFrame:
    """The sketch of all: cells of the same place add up. Their parameters must agree."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def estimates(sketch: DataFrame, asked: DataFrame, key: str, value: str, depth: int = 4, width: int = 2048) -> DataFrame:
    """`asked` (key, value) with estimate: the least of a value's cells; never less than its count."""
    each = asked.select(key, value, F.explode(places(F.col(value), depth, width)).alias("p")).select(key, value, "p.row", "p.cell")
    got = each.join(sketch, [key, "row", "cell"], "left")
    return got.groupBy(key, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom(frame: DataFrame, key: str, value: str, hashes: int = 4, width: int = 8192) -> DataFrame:
    """key, cell of the bits that are set."""
    return frame.select(key, F.explode(places(F.col(value), hashes, width)).alias("p")).select(key, F.col("p.cell").alias("cell")).distinct()


def maybe_in(bits: DataFrame, asked: DataFrame, key: str, value: str, hashes: int = 4, width: int = 8192) -> DataFrame:
    """`asked` (key, value) with maybe: whether all of a value's bits are set; true for all that were put in."""
    each = asked.select(key, value, F.explode(places(F.col(value), hashes, width)).alias("p")).select(key, value, F.col("p.cell").alias("cell")).distinct()
    got = each.join(bits.withColumn("set", F.lit(True)), [key, "cell"], "left")
    return got.groupBy(key, value).agg(F.every(F.coalesce("set", F.lit(False))).alias("maybe"))


def bloom_width(frame: DataFrame, key: str, hashes: int = 4, error: float = 1e-12) -> int:
    """Cells for a filter of each key's rows (different values): another value's bits are all set with a chance of `error`.

    It grows with the most values that a key has, which are counted first. Cells that aren't set take no room.
    """
    most = frame.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1
    return math.ceil(hashes * most / error ** (1 / hashes)) | 1  # odd, so that halves of the width are no steps


def counting_bloom(frame: DataFrame, key: str, value: str, sign: Column, hashes: int = 4, width: int = 8192, most: int = 15) -> DataFrame:
    """key, cell, n: insertions (sign 1) less removals (sign -1) of each cell, between 0 and `most`."""
    each = frame.select(key, F.explode(places(F.col(value), hashes, width)).alias("p"), sign.alias("d"))
    return each.groupBy(key, F.col("p.cell").alias("cell")).agg(F.least(F.greatest(F.sum("d"), F.lit(0)), F.lit(most)).cast("long").alias("n")).filter("n > 0")


def hll_registers(frame: DataFrame, key: str, value: str, precision: int = 10) -> DataFrame:
    """key, cell, rank of a HyperLogLog with 2 ** precision registers: the most leading zeros, plus one, of the rest of a hash."""
    h = F.xxhash64(value)
    cell = F.shiftrightunsigned(h, 64 - precision)
    bits = F.lpad(F.bin(h), 64, "0")
    rank = F.locate("1", F.concat(F.substring(bits, precision + 1, 64 - precision), F.lit("1")))
    return frame.filter(F.col(value).isNotNull()).groupBy(key, cell.cast("int").alias("cell")).agg(F.max(rank).alias("rank"))


def hll_counts(registers: DataFrame, key: str, precision: int = 10) -> DataFrame:
    """key, estimate; linear counting below 2.5 times the number of registers."""
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    each = registers.groupBy(key).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("used")))
    empty = m - F.col("used")
    return each.select(key, F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("estimate"))


def top_k(frame: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, value, n of the `k` most frequent values of each key; ties go to the smaller value. Exact, with partial counts."""
    counts = frame.groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def frequent_state(frame: DataFrame, key: str, value: str, tracked: int = 1024) -> DataFrame:
    """key, state: a bounded summary of a key's frequent values, `tracked` of them at most, built in parts and merged by Spark."""
    return frame.groupBy(key).agg(F.expr(f"approx_top_k_accumulate({value}, {tracked})").alias("state"))


def merge_frequent(*states: DataFrame, tracked: int = 1024) -> DataFrame:
    """The summary of all shards."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "state"]).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))


def frequent(states: DataFrame, value: str, k: int) -> DataFrame:
    """key, value, n: the `k` most frequent values of each summary, the most frequent first.

    n is never over 3.5 / tracked of all rows away from the true count, and exact while no key has more than three quarters of
    `tracked` different values.
    """
    got = states.select(*[c for c in states.columns if c != "state"], F.inline(F.expr(f"approx_top_k_estimate(state, {k})")))
    return got.withColumnsRenamed({"item": value, "count": "n"})


#: Keys that a task holds digests of before it gives them out, and values of a key that wait to be merged.
DIGESTS, UNMERGED = 4096, 2000


def compressed(means: np.ndarray, weights: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of centroids: by rank, those of one step of the scale become one; steps are small near both ends."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    middle = (np.cumsum(weights) - weights / 2) / weights.sum()
    step = np.floor(compression / 2 * (np.arcsin(2 * middle - 1) / math.pi + 0.5))
    first = np.flatnonzero(np.diff(step, prepend=-1))
    total = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / total, total


def digest(frame: DataFrame, key: str, value: str, compression: int = 200) -> DataFrame:
    """key, centroid, mean, n: a t-digest of each key, built in each partition and merged by key.

    A partition holds compression / 2 centroids of DIGESTS keys and UNMERGED values of each at most; only centroids are shuffled.
    Null values and those that aren't finite are left out.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    finite = frame.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")))
    chosen = finite.select(key, F.col(value).cast("double").alias("mean"), F.lit(1).cast("long").alias("n"))
    kind = StructType([chosen.schema[key], *_parse_datatype_string("centroid int, mean double, n long").fields])

    def rows(name, means, weights):
        n = len(means)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, form.field(0).type), pa.array(np.arange(n, dtype=np.int32)), pa.array(means), pa.array(weights.astype(np.int64))], schema=form)

    form = to_arrow_schema(kind)

    def run(batches):
        held: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, which = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            names.append(None)
            means, weights = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            for i in np.unique(which).tolist():
                mine = held.setdefault(names[i], [[], [], 0])
                at = which == i
                mine[0].append(means[at])
                mine[1].append(weights[at])
                mine[2] += int(at.sum())
                if mine[2] > UNMERGED:
                    m, w = compressed(np.concatenate(mine[0]), np.concatenate(mine[1]), compression)
                    mine[:] = [[m], [w], 0]
            if len(held) > DIGESTS:
                for name, (m, w, _) in held.items():
                    yield rows(name, *compressed(np.concatenate(m), np.concatenate(w), compression))
                held.clear()
        for name, (m, w, _) in held.items():
            yield rows(name, *compressed(np.concatenate(m), np.concatenate(w), compression))

    parts = chosen.mapInArrow(run, kind)
    return merge_digests(parts, key=key, compression=compression)


def merge_digests(*digests: DataFrame, key: str, compression: int = 200) -> DataFrame:
    """The digest of all rows that went into some digests."""
    out = digests[0]
    for d in digests[1:]:
        out = out.unionByName(d)

    def merged(state: list) -> list[tuple]:
        m, w = compressed(np.asarray(state[0]), np.asarray(state[1], dtype=float), compression)
        return [(i, x, int(n)) for i, (x, n) in enumerate(zip(m.tolist(), w.tolist(), strict=True))]

    def step(state, _, mean, n):
        state[0].append(mean)
        state[1].append(n)
        if len(state[0]) > UNMERGED:  # so that the shards of a key aren't held together
            m, w = compressed(np.asarray(state[0]), np.asarray(state[1], dtype=float), compression)
            state[:] = [m.tolist(), w.tolist()]
        return ()

    return ordered_fold(out, key, ["mean", "n"], lambda: [[], []], step, "centroid int, mean double, n long", merged, ("centroid",))


def distinct_counts(frame: DataFrame, key: str, value: str, precision: int = 12) -> DataFrame:
    """key, sketch: distinct values of each key in 2 ** precision registers; hll_union_agg merges, hll_sketch_estimate counts."""
    return frame.groupBy(key).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def centroids(frame: DataFrame, key: str, value: str, compression: int = 100) -> DataFrame:
    """key, centroid, mean, n: a t-digest in one pass over ranks; centroids are small near both ends.

    The scale is k(q) = compression / 2 * (asin(2q - 1) / pi + 1 / 2); values of equal k make a centroid. Values that
    aren't finite are left out.
    """
    finite = frame.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    w = Window.partitionBy(key)
    q = (F.row_number().over(w.orderBy(value)) - 0.5) / F.count("*").over(w)
    k = F.floor(compression / 2 * (F.asin(2 * q - 1) / math.pi + 0.5))
    return finite.select(key, value, k.alias("centroid")).groupBy(key, "centroid").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def digest_quantile(digest: DataFrame, key: str, q: float) -> DataFrame:
    """key, quantile: the mean of the centroid that holds rank q * n, drawn towards its neighbour's in between."""
    w = Window.partitionBy(key)
    upto = F.sum("n").over(w.orderBy("centroid"))
    each = digest.withColumn("mid", upto - F.col("n") / 2).withColumn("rank", q * F.sum("n").over(w))
    each = each.withColumn("next_mid", F.lead("mid").over(w.orderBy("centroid"))).withColumn("next_mean", F.lead("mean").over(w.orderBy("centroid"))).withColumn("first", F.lag("mid").over(w.orderBy("centroid")).isNull())
    inside = (F.col("mid") <= F.col("rank")) & ((F.col("rank") < F.col("next_mid")) | F.col("next_mid").isNull())
    hit = each.filter(inside | (F.col("first") & (F.col("rank") < F.col("mid"))))
    share = (F.col("rank") - F.col("mid")) / (F.col("next_mid") - F.col("mid"))
    value = F.when((F.col("rank") < F.col("mid")) | F.col("next_mid").isNull(), F.col("mean")).otherwise(F.col("mean") + share * (F.col("next_mean") - F.col("mean")))
    return hit.select(key, value.alias("quantile"))


def gram_entropy(grams: DataFrame, keys: list[str], gram: str) -> DataFrame:
    """keys, n, distinct, mode, entropy (bits) of the n-grams of each key."""
    counts = grams.groupBy(*keys, gram).agg(F.count("*").alias("n"))
    of = counts.withColumn("of", F.sum("n").over(Window.partitionBy(*keys)))
    p = F.col("n") / F.col("of")
    return of.groupBy(*keys).agg(F.max("of").alias("n"), F.count("*").alias("n_distinct"), F.max_by(gram, F.struct("n", gram)).alias("mode"), (-F.sum(p * F.log2(p))).alias("entropy"))


def flow_fingerprint(tracked: DataFrame, key: str, first: int = 32) -> DataFrame:
    """key, flow_no, lengths and gaps of a flow's first packets, totals, and their hash.

    Only the first `first` packets of a flow are gathered.
    """
    w = Window.partitionBy(key, "flow_no").orderBy("us", "seq")
    each = tracked.withColumn("__n", F.row_number().over(w)).withColumn("__gap", F.col("us") - F.lag("us").over(w))
    early = F.when(F.col("__n") <= first, F.struct(F.col("__n").alias("n"), F.least("bytes", F.lit(65535)).alias("len"), F.coalesce("__gap", F.lit(0)).alias("gap")))
    out = each.groupBy(key, "flow_no").agg(F.array_sort(F.collect_list(early)).alias("e"), F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))
    lens, gaps = F.transform("e", lambda x: x["len"]), F.transform("e", lambda x: x["gap"])
    text = F.concat_ws("|", F.array_join(F.transform(lens, lambda x: x.cast("string")), ","), F.array_join(F.transform(gaps, lambda x: x.cast("string")), ","))
    return out.select(key, "flow_no", lens.alias("lengths"), gaps.alias("gaps"), "packets", "bytes", text.alias("shape"))


def flow_features(tracked: DataFrame, key: str, first: int = 32) -> DataFrame:
    """key, flow_no, hash and eight features of a flow's fingerprint.

    hash: FNV-1a over the lengths (2 bytes each, 65,535 at most), then the gaps (4 bytes each, at most 2^32 - 1 us, the
    first one 0) of the first `first` packets. Features: samples, mean_len and mean_gap of these packets; bytes and
    packets of either side and the skew of bytes to the initiator (-1 to 1, 0 without bytes) of all packets.
    """
    w = Window.partitionBy(key, "flow_no").orderBy("us", "seq")
    gap = F.least(F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0)), F.lit((1 << 32) - 1))
    each = tracked.withColumn("__n", F.row_number().over(w)).withColumn("__gap", gap)
    early = F.when(F.col("__n") <= first, F.struct(F.col("__n").alias("n"), F.least("bytes", F.lit(65535)).alias("len"), F.col("__gap").alias("gap")))
    of = lambda side, c: F.sum(F.when(F.col("side") == side, c).otherwise(0))
    sides = [of(s, c).alias(f"{n}_{s}") for s in ("initiator", "responder") for n, c in (("bytes", F.col("bytes")), ("packets", F.lit(1)))]
    out = each.groupBy(key, "flow_no").agg(F.array_sort(F.collect_list(early)).alias("e"), *sides)
    joined = lambda c, size: F.array_join(F.transform("e", lambda x: hexed(x[c], size)), "")
    mean = lambda c: F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x[c]) / F.size("e")
    total = F.col("bytes_initiator") + F.col("bytes_responder")
    skew = F.when(total > 0, (F.col("bytes_initiator") - F.col("bytes_responder")) / total).otherwise(0.0)
    return out.select(key, "flow_no", fnv1a(F.unhex(F.concat(joined("len", 2), joined("gap", 4)))).alias("hash"), F.size("e").alias("samples"), mean("len").alias("mean_len"), mean("gap").alias("mean_gap"), "bytes_initiator", "bytes_responder", "packets_initiator", "packets_responder", skew.alias("skew"))
