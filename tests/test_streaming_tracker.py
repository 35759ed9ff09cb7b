"""The tracker over a stream of several triggers against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import flows
from tidelane.streaming import tracker

S = 1_000_000
SCHEMA = "k string, us long, seq long, l4 string, forward boolean, flags int, bytes long"


@pytest.fixture
def stateful(spark):
    name, value = tracker.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def made() -> list[tuple]:
    rng, rows = random.Random(3), []
    for k in range(8):
        us = 0
        for _ in range(40):
            us += rng.choice([1000, 20_000, 5 * S, 70 * S, 400 * S]) + rng.randrange(999)
            rows.append((f"k{k}", us, len(rows), "udp" if k % 3 == 0 else "tcp", rng.random() < 0.6, rng.choice([2, 18, 16, 24, 17, 4, 16, 24]), rng.randrange(1500)))
    return sorted(rows, key=lambda r: r[1])


def test_stream_equals_batch(stateful, tmp_path):
    """Packets come up to ten seconds late over six triggers; those that come later still are dropped."""
    spark, rows, rng = stateful, made(), random.Random(4)
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(10 * S))
    last = max(r[1] for r in rows)
    parts = [late[i * len(late) // 5 : (i + 1) * len(late) // 5] for i in range(5)]
    parts += [[("end", last + 5000 * S, 10_000, "udp", True, 0, 0)], [("end", last + 6000 * S, 10_001, "udp", True, 0, 0), ("k1", 5, 10_002, "tcp", True, 4, 7)]]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    events = tracker.flow_events(stream.withColumn("ts", F.timestamp_micros("us")), "k", "ts", "10 seconds", tick_us=60 * S)
    query = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        query = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)  # each start goes on from the checkpoint
        assert query.exception() is None, i
    got = spark.read.parquet(str(tmp_path / "out")).filter("k <> 'end'")

    batch = flows.with_lifecycle(spark.createDataFrame(rows, SCHEMA), "k")
    names = ["k", "flow_no", "start_us", "end_us", "packets_initiator", "packets_responder", "bytes_initiator", "bytes_responder", "reason", "state"]
    want = sorted(tuple(r[n] for n in names) for r in flows.flow_ends(batch, "k").collect())
    assert sorted(tuple(r[n] for n in names) for r in got.filter("event = 'ended'").collect()) == want
    assert {r.reason for r in got.filter("event = 'ended'").collect()} == {"idle_timeout", "rst", "fin"} or len(want) > 20
    assert sorted((r.k, r.flow_no, r.us) for r in got.filter("event = 'started'").collect()) == sorted((w[0], w[1], w[2]) for w in want)
    made_ = sorted((r.k, r.flow_no, r.us) for r in batch.filter("established").collect())
    assert sorted((r.k, r.flow_no, r.us) for r in got.filter("event = 'established'").collect()) == made_
    ticks = sorted((r.k, r.flow_no, r.us) for r in flows.ticks(batch, "k", 60 * S).filter("tick > 0").collect())
    assert sorted((r.k, r.flow_no, r.us) for r in got.filter("event = 'tick'").collect()) == ticks
