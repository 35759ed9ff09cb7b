"""Results and plans that have to hold for tables of any size."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidelane.operators import folds, keys, sketches
from tidelane.parsers import names, quic
from tidelane.plans import catalog, connections, tracking
from tidelane.sources import frames


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_newest_names_without_a_join(spark):
    told = [(i, i, 7, f"n{i:02d}") for i in range(12)] + [(11, 20, 7, "n03"), (5, 21, 8, "n00")]
    message = F.struct(F.lit(True).alias("is_response"), F.array(F.struct("name")).alias("questions"), F.array(F.struct(F.lit("A").alias("type"), F.lit(0).alias("section"), F.lit(300).cast("long").alias("ttl"), F.lit("10.0.0.1").alias("value"))).alias("records"))
    rows = spark.createDataFrame(told, "us long, seq long, client long, name string").select("us", "seq", "client", message.alias("message"))
    got = names.name_claims(rows, most=3)
    assert sorted((r.client, r.name, r.us, r.new) for r in got.collect()) == [(7, "n03", 3, True), (7, "n03", 11, False), (7, "n10", 10, True), (7, "n11", 11, True), (8, "n00", 5, True)]
    assert "Join" not in plan_of(got) and "Broadcast" not in plan_of(got)


def events_in(spark, path, rows):
    """A folder with a table of events (event_id, user_id, event_type, value), one a second."""
    table = rows.select(F.col("event_id").cast("long").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)").alias("ts"), F.col("user_id").cast("long").alias("user_id"), F.col("event_type").alias("event_type"), F.col("value").cast("double").alias("value"), F.lit("{}").alias("props"))
    table.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_filter_finds_none_of_many_removed(spark, tmp_path):
    many = spark.range(30_000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1).alias("value"))
    (row,) = tracking.counting_filter(spark, events_in(spark, tmp_path, many)).collect()
    assert (row.kept, row.kept_found, row.removed, row.removed_found) == (15_000, 15_000, 15_000, 0)
    assert sketches.bloom_width(spark.range(0).select("id", "id"), "id") > 0


def test_errors_explain_flows_of_one_user_only(spark, tmp_path):
    users = F.element_at(F.array(*[F.lit(u) for u in (5, 65_541, 131_077, 16_777_221)]), (F.col("id") % 4 + 1).cast("int"))
    path = events_in(spark, tmp_path, spark.range(40).select(F.col("id").alias("event_id"), users.alias("user_id"), F.when(F.col("id") >= 36, "error").otherwise("view").alias("event_type"), F.lit(1).alias("value")))
    got = sorted((r.seq, r.us, r.flow_no) for r in tracking.icmp_explained_drops(spark, path).collect())
    assert [s for s, _, _ in got] == [36, 37, 38, 39]


def test_flows_without_bytes_are_skewed_as_in_sql(spark, tmp_path):
    import duckdb

    path = events_in(spark, tmp_path, spark.range(30).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("error").alias("event_type"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 100).alias("value")))
    want = duckdb.sql(catalog.ORACLES["direction_skew_anomaly"].replace("FROM events", f"FROM '{path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in catalog.direction_skew_anomaly(spark, path).collect()) == sorted(want) == [(0, 0)]


def test_hashes_of_batches(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for x in data:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return f"{h:016X}"

    values = [b"", b"a", bytes(range(256)), None, b"foobar"]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v binary").coalesce(1).select(keys.fnv1a(F.col("v")).alias("h")).collect()]
    assert got == [fnv(v or b"") for v in values] and got[-1] == "85944171F73967E8"
    address = F.concat(F.lit("10.0.0."), F.col("id").cast("string"))
    hashed = keys.stable_hash(keys.canonical(F.lit("udp"), address, F.lit(53), F.lit("10.0.0.9"), F.lit(80)))
    assert plan_of(spark.range(1).select(hashed)).count("10.0.0.9") < 30  # the key is made once, not for each field


def test_gtp_heads():
    opened = bytes([0x34]) + bytes(10) + b"\x85" + b"\x01aa\x00" + b"E"
    assert [frames.gtp_head_of(d) for d in (b"", b"\x30aaaaaaa", b"\x32", b"\x34", opened, opened[:15], opened[:12] + b"\x00aaa")] == [8, 8, 12, None, 16, None, None]


def test_few_rows_are_objects_at_a_time():
    batch = pa.RecordBatch.from_pydict({"a": list(range(2500))})
    assert [b.num_rows for b in folds.sliced([batch, batch.slice(0, 0)])] == [1000, 1000, 500]


def test_hunters_decode_once(spark, tmp_path):
    path = events_in(spark, tmp_path, spark.range(6).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1).alias("value")))
    for hunter in (tracking.ldap_recon_hunter, tracking.kerberoast_hunter):
        assert plan_of(hunter(spark, path)).count("ArrowEvalPython") == 1
    assert "Join" not in plan_of(tracking.smb_lateral_movement(spark, path))


def test_flows_of_late_events(spark):
    at = 60_000 * 300 + 77
    key = f'{{"proto":"tcp","a_ip":"10.0.0.1","a_port":{1024 + at % 60_000},"b_ip":"192.168.{at // 60_000 // 256}.{at // 60_000 % 256}","b_port":80}}'
    assert connections.by_event(spark.createDataFrame([(key,)], "key string")).head().event_id == at


def test_quic_packets_are_opened_once(spark, tmp_path):
    path = events_in(spark, tmp_path, spark.range(6).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1).alias("value")))
    plan = plan_of(connections.quic_hellos(spark, path))
    assert plan.count("ArrowEvalPython") == 4 and plan.count("aesDecrypt") == 1  # keys, headers, frames, hello
    assert plan.count("aesEncrypt") < 10
    frame = b"\x06\x05\x02ab"
    assert quic.crypto_of(bytes(3) + b"\x01\x40\x00" + frame + bytes(2)) == quic.crypto_of(frame) == [{"at": 5, "data": b"ab"}]
    assert quic.crypto_of(bytes(1200)) == [] and quic.crypto_of(bytes(2) + b"\x40") is None


def test_more_streams_make_more_partitions(spark, tmp_path, monkeypatch):
    path = events_in(spark, tmp_path, spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 20).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1).alias("value")))
    monkeypatch.setattr(folds, "ROWS", 20)
    for query in (connections.http2_streams, connections.grpc_streams):
        got = query(spark, path)
        plan = plan_of(got)
        assert plan.count(", 12), REPARTITION_BY_NUM") == 2 and plan.count("Exchange hashpartitioning") == 3
        assert plan.index("SortAggregate") < plan.rindex("REPARTITION_BY_NUM", 0, plan.index("MapInArrow")) and "SortAggregate" not in plan[plan.index("MapInArrow") :]
        assert got.count() == 60
