"""Folds, streams, sketches and decoders against brute force on small fixtures."""

import itertools
import random

from pyspark.sql import functions as F

from tidelane.functions import scalars, wire
from tidelane.operators import flows, folds, rates, sketches, streams
from tidelane.parsers import link

random.seed(4)


def events(spark, n=400, keys=5, kinds="abc"):
    rows = sorted((random.randrange(keys), random.randrange(2000), i, random.choice(kinds)) for i in range(n))
    return rows, spark.createDataFrame(rows, "k long, us long, seq long, kind string")


def test_sequences_against_brute_force(spark):
    rows, frame = events(spark)
    pattern, within, want = ["a", "b", "c"], 300, []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        open_: list[list] = []  # all attempts: (start, matched)
        for _, us, seq, kind in group:
            grown = [(s, m + 1) for s, m in open_ if kind == pattern[m] and us - s <= within]
            open_ += grown + ([(us, 1)] if kind == pattern[0] else [])
            if any(m == len(pattern) for _, m in open_):
                want.append((key, us, seq))
                open_ = []
    got = sorted(tuple(r) for r in folds.sequences(frame, "k", "kind", pattern, within).collect())
    assert got == sorted(want) and want


def test_distinct_windows_against_brute_force(spark):
    rows, frame = events(spark, 300)
    width, buckets = 50, 3
    got = {r.seq: r.live for r in rates.live_distinct_at(frame, ["k"], "kind", width, buckets).collect()}
    for k, us, seq, _ in rows:
        live = {v for kk, u, s, v in rows if kk == k and (u, s) <= (us, seq) and u // width * width >= us - buckets * width}
        assert got[seq] == len(live)
    each = {(r.k, r.bucket): r.n_distinct for r in rates.live_distinct(frame, "k", "kind", width, buckets).collect()}
    for k, b in {(r[0], r[1] // width) for r in rows}:
        assert each[k, b] == len({v for kk, u, _, v in rows if kk == k and b - buckets < u // width <= b})


def test_streams_of_random_segments(spark):
    """Segments in any order, repeated and cut anywhere, give the stream back, across the wrap of sequence numbers."""
    data = bytes(random.randrange(256) for _ in range(600))
    base, rows = (1 << 32) - 100, []
    for flow in range(20):
        parts = [(a, data[a : a + random.randrange(1, 60)]) for a in range(0, 600, 20)]
        parts += [(0, data[:1])]
        order = parts[-1:] + random.sample(parts[:-1], len(parts) - 1)
        whole = {i for a, p in parts for i in range(a, a + len(p))}
        rows += [(flow, 1, i, i, (base + a) % (1 << 32), p, False) for i, (a, p) in enumerate(order)]
        rows.append((flow, 1, 99, 99, base, data, False))
        assert whole
    frame = spark.createDataFrame(rows, "flow long, side long, us long, seq long, tcp_seq long, payload binary, syn boolean")
    got: dict = {}
    for r in streams.reassemble(frame, ["flow", "side"]).collect():
        got.setdefault(r.flow, []).append((r.offset, bytes(r.chunk), r.gap, r.inconsistent))
    for chunks in got.values():
        assert b"".join(c for _, c, _, _ in sorted(chunks)) == data and not any(g or i for _, _, g, i in chunks)
    assert len(got) == 20


def test_fragments(spark):
    rows = [("a", "b", 17, 1, 5, 1, 8, False, b"xyz"), ("a", "b", 17, 1, 6, 2, 0, True, b"12345678"), ("a", "b", 17, 2, 5, 3, 0, True, b"12345678"), ("a", "b", 17, 2, 40_000_000, 4, 8, False, b"late")]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, proto long, id long, us long, seq long, fragment long, mf boolean, payload binary")
    assert [(r.id, bytes(r.payload)) for r in streams.defragment(frame).collect()] == [(1, b"12345678xyz")]


def test_lifecycle_of_a_handshake(spark):
    s = [(2, True), (18, False), (16, True), (24, True), (17, False), (17, True), (16, False), (2, False)]
    frame = spark.createDataFrame([("k", i, i, "tcp", fw, fl) for i, (fl, fw) in enumerate(s)], "k string, us long, seq long, l4 string, forward boolean, flags int")
    got = [tuple(r) for r in flows.lifecycle(frame, "k").orderBy("seq").select("flow_no", "state", "established", "reason").collect()]
    assert [g[1] for g in got] == ["syn_sent", "syn_received", "established", "established", "fin_wait", "closing", "closed", "syn_sent"]
    assert [g[0] for g in got] == [0] * 7 + [1] and got[2][2] and got[6][3] == "fin"


def test_merged_sketches_equal_serial_ones(spark):
    _, frame = events(spark)
    cells = lambda f: sorted(tuple(r) for r in sketches.count_min(f, "k", "kind").collect())
    parts = [frame.filter(F.col("seq") % 3 == i) for i in range(3)]
    both = sketches.merge_cells(*[sketches.count_min(p, "k", "kind") for p in parts])
    assert sorted(tuple(r) for r in both.select("k", "row", "cell", "n").collect()) == cells(frame)


def test_scalars_of_bytes(spark):
    one = spark.createDataFrame([(bytes.fromhex("056405C001000004E921"), bytes.fromhex("20010db8000000000001000000000001"), bytes(16))], "d binary, a binary, z binary")
    got = one.select(link.dnp3(F.col("d")).alias("m"), wire.ipv6(F.col("a"), 0).alias("a"), wire.ipv6(F.col("z"), 0).alias("z"), scalars.grease(F.lit(0x7A7A)).alias("g"), scalars.grease(F.lit(0x1A2A)).alias("n")).head()
    assert got.m.crc_ok and got.a == "2001:db8::1:0:0:1" and got.z == "::" and got.g and not got.n


def test_frequent_values_of_shards(spark):
    """Merged summaries of few places are within their bound of the truth, and find every frequent value."""
    rng = random.Random(6)
    rows = [("k", int(rng.paretovariate(0.7)) if rng.random() < 0.5 else rng.randrange(10_000)) for _ in range(30_000)]
    frame, tracked = spark.createDataFrame(rows, "k string, v long"), 256
    shards = [sketches.frequent_state(frame.filter(F.pmod(F.xxhash64("v", F.lit(i)), F.lit(1)) == 0).filter(F.col("v") % 4 == i), "k", "v", tracked) for i in range(4)]
    got = {r.v: r.n for r in sketches.frequent(sketches.merge_frequent(*shards, tracked=tracked), "v", 50).collect()}
    serial = {r.v: r.n for r in sketches.frequent(sketches.frequent_state(frame, "k", "v", tracked), "v", 50).collect()}
    true: dict = {}
    for _, v in rows:
        true[v] = true.get(v, 0) + 1
    bound = 3.5 / tracked * len(rows)
    for found in (got, serial):
        assert all(abs(n - true[v]) <= bound for v, n in found.items())
        assert {v for v, n in true.items() if n > 2 * bound} <= set(found)


def test_merged_digests_have_exact_tails(spark):
    """Ranks of quantiles of merged digests against the sorted values; null keys and values that aren't finite."""
    rng = random.Random(7)
    rows = [(k, rng.lognormvariate(0, 2)) for k in ("a", "b", None) for _ in range(12_000)] + [("a", float("nan")), ("a", float("inf")), ("c", None), ("d", 5.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shards = [sketches.digest(frame.filter(F.pmod(F.xxhash64("v"), F.lit(3)) == i), "k", "v") for i in range(3)]
    both = sketches.merge_digests(*shards, key="k")
    sizes = {r.k: (r.rows, r.n) for r in both.groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    assert set(sizes) == {"a", "b", None, "d"} and all(n == (1 if k == "d" else 12_000) and size <= 101 for k, (size, n) in sizes.items())
    for q, error in ((0.001, 0.0005), (0.5, 0.01), (0.99, 0.001), (0.999, 0.0005)):
        for r in sketches.digest_quantile(both, "k", q).filter("k <> 'd' or k is null").collect():
            values = sorted(v for k, v in rows if k == r.k and v is not None and v == v and v < float("inf"))
            assert abs(sum(v < r.quantile for v in values) / len(values) - q) <= error, (q, r)


def test_distinct_counts_merge(spark):
    frame = spark.createDataFrame([("k", i % 5000) for i in range(20_000)], "k string, v long")
    parts = sketches.distinct_counts(frame.filter("v % 2 = 0"), "k", "v").unionByName(sketches.distinct_counts(frame.filter("v % 2 = 1 or v < 100"), "k", "v"))
    got = parts.groupBy("k").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).head().n
    assert abs(got - 5000) < 250
