"""Pulses in one fold against the steps they are made of, over odd captures; what whole batches tell of frames."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelane.operators import flows, folds, keys, sessions
from tidelane.plans import connections
from tidelane.sources import frames

A, B = b"\x0a\0\0\x01", b"\xc0\xa8\0\x02"
A6, B6 = b"\xfe\x80" + bytes(13) + b"\x09", b"\x20\x01\x0d\xb8" + bytes(11) + b"\x08"
ASK = [b"GET /a HTTP/1.1\r\nHost: x\r\n\r\n", b"POST /b HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc", b"PUT /c HTTP/1.0\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n", b"nonsense\r\n\r\n"]
ANSWER = [b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok", b"HTTP/1.1 204 none\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nto the end", b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n"]


def dns(number: int, response: bool) -> bytes:
    head = struct.pack(">6H", number, 0x8180 if response else 0x100, 1, int(response), 0, 0) + b"\x01a\x03com\0\0\1\0\1"
    return head + (b"\xc0\x0c\0\1\0\1\0\0\0\x3c\0\4\x0a\0\0\x07" if response else b"")


def packet(proto: int, body: bytes, forward: bool, six: bool, fragment: int = 0, tag: bool = False) -> bytes:
    ends = ((A6, B6) if six else (A, B))[:: 1 if forward else -1]
    if six:
        ip = struct.pack(">IHBB", 6 << 28, len(body), proto, 9) + b"".join(ends) + body
    else:
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 7, fragment, 64, proto, 0) + b"".join(ends) + body
    kind = b"\x86\xdd" if six else b"\x08\0"
    return bytes(12) + (b"\x81\0\0\x05" if tag else b"") + kind + ip + bytes(max(0, 46 - len(ip)))


def capture(seed: int) -> list[tuple]:
    """path, seq, us, frame, wire_len: flows with lost, repeated, late and cut packets, new flows of old keys, DNS, fragments and other frames."""
    rng, out = random.Random(seed), []

    def put(us, frame, snap=None):
        out.append((rng.choice("ab"), len(out), us, frame[:snap], rng.choice([len(frame), len(frame), None])))

    for flow in range(60):
        port, six, us = 2000 + flow % 25, flow % 5 == 4, rng.randrange(400) * 1_000_000
        server, tag = rng.choice([80, 53]), rng.random() < 0.2
        if rng.random() < 0.25:  # UDP
            for i, response in enumerate((False, True)):
                ports = (port, server) if not response else (server, port)
                data = dns(flow, response)[: rng.choice([5, 99])]
                put(us + i, packet(17, struct.pack(">4H", *ports, 8 + len(data), 0) + data, not response, six, tag=tag))
            continue
        sent, numbers = [], [rng.randrange(1 << 32), rng.randrange(1 << 32)]
        say = lambda way, flags, data=b"", ack=True: sent.append([way, flags | (16 if ack else 0), numbers[way], numbers[1 - way] if ack else 0, data])  # noqa: B023, E731
        say(0, 2, ack=False)
        numbers[0] = (numbers[0] + 1) % (1 << 32)
        say(1, 2)
        numbers[1] = (numbers[1] + 1) % (1 << 32)
        say(0, 0)
        for _ in range(rng.randrange(1, 5)):
            for way, kinds in ((0, ASK), (1, ANSWER)):
                whole = rng.choice(kinds) if server == 80 or rng.random() < 0.2 else (lambda m: struct.pack(">H", len(m)) + m)(dns(flow, way == 1))
                at = 0
                while at < len(whole):
                    n = rng.choice([7, 1000])
                    say(way, 8, whole[at : at + n])
                    numbers[way] = (numbers[way] + len(whole[at : at + n])) % (1 << 32)
                    at += n
        if rng.random() < 0.2:
            say(0, 4)
        else:
            for way in (0, 1):
                if rng.random() < 0.8:
                    say(way, 1)
                    numbers[way] = (numbers[way] + 1) % (1 << 32)
            say(0, 0)
        for i, (way, flags, number, ack, data) in enumerate(sent):
            chance = rng.random()
            if chance < 0.05:
                continue
            ports = (port, server) if way == 0 else (server, port)
            frame = packet(6, struct.pack(">HHIIBBHHH", *ports, number, ack, 0x50, flags, 9, 0, 0) + data, way == 0, six, tag=tag)
            put(us + i * rng.choice([10, 10, 10, 2_000_000]), frame, len(frame) - 3 if chance > 0.93 and len(data) > 3 else None)
            if chance > 0.9:
                put(us + i * 10 + 55, frame)
    put(5, packet(1, b"\x08\0aabbcc", True, False))
    put(5, packet(58, b"\x80\0aabbcc", True, True))
    put(6, packet(47, b"gre-body", False, False))
    put(7, packet(17, b"rest of a datagram", True, False, fragment=3))
    put(8, packet(6, b"\0\x50", True, False), 36)
    put(8, packet(6, struct.pack(">HHIIBBHHH", 9, 80, 1, 1, 0x60, 16, 9, 0, 0) + b"\x01\x01\x01\0xy", True, False))
    put(9, b"\0" * 12 + b"\x08\x06" + b"arp")
    put(9, b"")
    return out


@pytest.fixture(params=range(2))
def captured(spark, request):
    rows = spark.createDataFrame(capture(request.param), "path string, seq long, us long, frame binary, wire_len long")
    return rows.unionByName(spark.createDataFrame([("a", -1, 9, None, 7)], rows.schema))


def told(frame) -> list[str]:
    return sorted(map(str, frame.collect()))


def test_batches_tell_what_columns_do(captured):
    known = keys.five_tuple(frames.decode(captured))
    cut = F.greatest(F.col("wire_len") - F.length("frame"), F.lit(0))
    want = known.select(
        "path", "seq", "us", F.to_json("key").alias("key"), "forward", F.col("proto").alias("l4"), F.coalesce("tcp.flags", F.lit(0)).alias("flags"), F.col("tcp.seq").alias("tcp_seq"), F.col("tcp.ack").alias("tcp_ack"),
        "payload", F.when(F.col("proto").isin("tcp", "udp"), cut).otherwise(0).cast("long").alias("missing"), F.col("wire_len").alias("bytes"), "src_port", "dst_port",
    )
    got = sessions.flow_packets(captured)
    assert got.columns == want.columns and told(got) == told(want)


def test_one_fold_gives_what_the_steps_do(captured):
    packets = sessions.tracked(captured)
    each = lambda messages, name: messages.select("key", "flow_no", "us", "seq", "n", F.lit("message").alias("pulse"), "side", F.lit(name).alias("protocol"), F.col("message").alias(name))
    want = sessions.life(packets).unionByName(each(sessions.http_messages(packets), "http"), allowMissingColumns=True).unionByName(each(sessions.dns_messages(packets), "dns"), allowMissingColumns=True)
    rows = told(want)
    assert sum("protocol='http'" in r for r in rows) > 10 and sum("protocol='dns'" in r for r in rows) > 5 and any("flow_no=1" in r for r in rows)
    assert told(sessions.pulses(packets).select(want.columns)) == rows
    assert told(sessions.captured_pulses(captured, parts=3).select(want.columns)) == rows
    few = sessions.captured_pulses(captured, http="struct<status:int>", dns="struct<id:bigint>")
    assert told(few.select("key", "us", "seq", "http.status", "dns.id")) == told(want.select("key", "us", "seq", "http.status", "dns.id"))


def test_packets_of_pulses_are_read_once(spark, tmp_path):
    spark.range(8).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    plan = connections.capture_pulses(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 2 and "Union" not in plan
    pulses = sessions.pulses(sessions.tracked(connections.captured(spark, str(tmp_path))))._jdf.queryExecution().executedPlan().toString()
    assert pulses.count("MapInArrow") == 3 and pulses.count("Exchange") == 1


def test_values_of_columns_as_objects():
    import pyarrow as pa

    columns = [pa.array(["a", None, "ü"]), pa.array([b"", None, b"\0a"]), pa.array([1 << 62, None, -1]), pa.array([1, 2], pa.int32()), pa.array([True, None, False]), pa.array([True]), pa.array([0.5, None, float("inf")]), pa.array([{"a": 1}, None]), pa.array([], pa.int64())]
    for c in columns:
        got = folds.objects(c)
        assert got == c.to_pylist() and list(map(type, got)) == list(map(type, c.to_pylist()))
        assert folds.objects(c.slice(1)) == c.slice(1).to_pylist()
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (3, 4, 20, 1)]
    assert [b.num_rows for b in folds.joined(batches, 10)] == [7, 20, 1] and [b.num_rows for b in folds.joined(batches, 100, 8)] == [3, 4, 20, 1] and list(folds.joined([])) == []
