import base64
import hashlib
import ipaddress
import struct

from pyspark.sql import functions as F

from tidelane.functions import scalars
from tidelane.operators import folds, keys, rates
from tidelane.sources.pcap import Pcap, captures
from tidelane.streaming import windows


def test_community_id_vectors(spark):
    one = spark.createDataFrame([(6, "128.232.110.120", 34855, "66.35.250.204", 80), (17, "192.168.1.52", 54585, "8.8.8.8", 53)], "p int, s string, sp int, d string, dp int")
    got = [r.c for r in one.select(scalars.community_id(*[F.col(c) for c in ("p", "s", "sp", "d", "dp")]).alias("c")).collect()]
    assert got == ["1:LQU9qZlK+B5F3KDmev6m5PMibrg=", "1:d/FP5EW3wiY1vCndhwleRRKHowQ="]


def test_addresses_of_both_kinds(spark):
    """Every form that Python's own parser takes, in order and as octets; other text is no address."""
    texts = ["::", "::1", "1::", "2001:DB8::a:0:1", "fe80:0:0:0:1:2:3:4", "::ffff:10.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8", "10.0.0.9", "255.1.0.254"]
    frame = spark.createDataFrame([(t,) for t in [*texts, "", "host", "1:2:3", "12345::1"]], "t string")
    got = {r.t: r.h for r in frame.select("t", scalars.address_hex(F.col("t")).alias("h")).collect()}
    assert got == {t: ipaddress.ip_address(t).packed.hex().upper() for t in texts} | dict.fromkeys(["", "host", "1:2:3", "12345::1"])
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    out = pairs.select("a", "b", keys.canonical(F.lit("udp"), F.col("a"), F.lit(1), F.col("b"), F.lit(2)).alias("k"), scalars.community_id(F.lit(17), F.col("a"), F.lit(1), F.col("b"), F.lit(2)).alias("x"), scalars.community_id(F.lit(17), F.col("b"), F.lit(2), F.col("a"), F.lit(1)).alias("y"))
    for r in out.collect():
        ends = sorted([(ipaddress.ip_address(r.a).version, ipaddress.ip_address(r.a).packed, 1, r.a), (ipaddress.ip_address(r.b).version, ipaddress.ip_address(r.b).packed, 2, r.b)])
        assert [(r.k.a_port, r.k.a_ip), (r.k.b_port, r.k.b_ip)] == [e[2:] for e in ends]
        data = b"\0\0" + ends[0][1] + ends[1][1] + b"\x11\0" + struct.pack(">HH", ends[0][2], ends[1][2])
        assert r.x == r.y == "1:" + base64.b64encode(hashlib.sha1(data).digest()).decode()


def test_ewma_variance_vector(spark):
    two = spark.createDataFrame([("k", 0, 0, 1.0), ("k", 1, 1, 2.0)], "k string, us long, seq long, x double")
    row = folds.ewma_variance(two, "k", "x", 0.1).head()
    assert abs(row.mean - 1.1) < 1e-12 and abs(row.variance - 0.09) < 1e-12


def test_live_sum_on_a_bucket_edge(spark):
    rows = spark.createDataFrame([("k", 0, 0), ("k", 5, 1), ("k", 20, 2), ("k", 21, 3)], "k string, us long, seq long")
    got = {r.seq: r.live for r in rates.live_sum(rows, "k", F.lit(1), 10, 2, "live").collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 2}


def test_scalars(spark):
    got = spark.range(1).select(
        scalars.hamming(F.lit("abc"), F.lit("abd")).alias("a"),
        scalars.hamming(F.lit("abc"), F.lit("ab")).alias("b"),
        scalars.looks_hex(F.lit("00112233445566778")).alias("c"),
        scalars.shannon_entropy(F.lit("aabb")).alias("d"),
        scalars.first_bytes(F.lit(b"\x16\x03\x01")).alias("e"),
        scalars.registered_domain(F.lit("x.a.co.uk")).alias("f"),
    ).head()
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (1, None, True, 1.0, "tls", "co.uk")


def test_pcap_both_ways(spark, tmp_path):
    path = tmp_path / "a.pcap"
    path.write_bytes(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 3, 7, 2, 60) + b"ab" + struct.pack("<IIII", 4, 0, 9, 9) + b"cut")
    spark.dataSource.register(Pcap)
    for frames in (spark.read.format("pcap").load(str(path)), captures(spark.read.format("binaryFile").load(str(path)))):
        rows = frames.collect()
        assert [(r.seq, r.us, r.wire_len, bytes(r.frame)) for r in rows] == [(0, 3_000_007, 60, b"ab")]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = windows.event_time(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "ts", "1 day")
    out = windows.windowed_totals(stream, "ts", "user_id", "value", "1 day")
    run = out.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert run.awaitTermination(120)
    got = spark.table("totals").agg(F.count("*"), F.sum("n")).head()
    want = table.groupBy("user_id", F.date_trunc("day", "ts")).count().agg(F.count("*"), F.sum("count")).head()
    assert tuple(got) == tuple(want)
