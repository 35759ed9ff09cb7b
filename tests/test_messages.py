"""Messages with many entries, cut anywhere, hostile or split over chunks."""

import random
import struct

from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.parsers import names, web


def texts(messages):
    return [(m["is_request"], m["path"] or m["status"], m["body"]) for m in messages]


PIPELINED = b"".join(b"GET /%d HTTP/1.1\r\nHost: a\r\n\r\n" % i for i in range(200))
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x;x=y\r\n%s\r\n" % (1 + i % 20, b"z" * (1 + i % 20)) for i in range(1000)) + b"0\r\nTrailer: t\r\n\r\n"
MISSING = b"HTTP/1.1 404 Not Found\r\nContent-Length: 2\r\n\r\nno"


def test_many_messages_and_chunks(spark):
    got = spark.createDataFrame([(PIPELINED,), (CHUNKED + MISSING,), (None,), (b"",)], "s binary").select(web.http(F.col("s")).alias("m")).collect()
    assert [m.path for m in got[0].m] == [f"/{i}" for i in range(200)]
    assert [(m.status, len(m.body)) for m in got[1].m] == [(200, sum(1 + i % 20 for i in range(1000))), (404, 2)]
    assert got[2].m is None and got[3].m == []


def test_messages_don_t_depend_on_chunks(spark):
    stream = CHUNKED + MISSING + b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.0 200 OK\r\n\r\nup to the end"
    whole = texts(web.messages_of(stream))
    assert len(whole) == 4 and whole[-1][2] == "up to the end"
    for size in (1, 3, 1000):
        side = web.HttpSide()
        out = [m for i in range(0, len(stream), size) for m in side.read(stream[i : i + size])]
        assert texts([*out, side.finish()]) == whole
    rows = [("a", 0, i, i, i, stream[i : i + 700], 0) for i in range(0, len(stream), 700)] + [("b", 0, 1, 1, 0, PIPELINED[:600], 0), ("b", 0, 2, 2, 700, PIPELINED[600:], 7)]
    frame = spark.createDataFrame(rows, "flow string, side int, us long, seq long, offset long, chunk binary, gap long")
    got = web.http_messages(frame, ["flow", "side"]).orderBy("us", "n").collect()
    assert texts([r.message.asDict() for r in got if r.flow == "a"]) == whole and sum(r.flow == "b" for r in got) == 600 // len(b"GET /0 HTTP/1.1\r\nHost: a\r\n\r\n")


def test_broken_messages():
    for bad in (b"nothing of the kind\r\n\r\n", b"GET / HTTP/1.1\r\nContent-Length: x\r\n\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", b"GET / HTTP/1.1\r\n" + b"a: b\r\n" * 20_000 + b"\r\n"):
        assert web.messages_of(PIPELINED[:29] + bad + MISSING) == web.messages_of(PIPELINED[:29])
    rng = random.Random(1)
    for _ in range(500):
        cut = bytearray(CHUNKED + MISSING)
        for _ in range(3):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        web.messages_of(bytes(cut[: rng.randrange(len(cut))]))


def label(name: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"


def test_dns_with_many_records(spark):
    head = struct.pack(">6H", 7, 0x8583, 1, 300, 1, 1)
    body = label("Www.Example.org") + struct.pack(">HH", 1, 1) + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([10, 0, i // 256, i % 256]) for i in range(300))
    body += b"\xc0\x10" + struct.pack(">HHIH", 2, 1, 5, 5) + b"\x02ns\xc0\x10" + b"\0" + struct.pack(">HHIH", 16, 1, 0, 8) + b"\x03abc\x03def"
    (m,) = spark.createDataFrame([(head + body,)], "p binary").select(names.dns(F.col("p")).alias("m")).collect()
    m = m.m
    assert (m.is_response, m.authoritative, m.truncated, m.recursion_desired, m.recursion_available, m.rcode, m.id) == (True, True, False, True, True, "NXDOMAIN", 7)
    assert [r.value for r in m.records if r.section == 0] == [f"10.0.{i // 256}.{i % 256}" for i in range(300)]
    assert [(r.section, r.type, r.name, r.value) for r in m.records[300:]] == [(1, "NS", "example.org", "ns.example.org"), (2, "TXT", "", "abcdef")]


def test_broken_dns():
    """Circles, names past the end, long names, and any bytes give what is whole before them."""
    head = struct.pack(">6H", 1, 0x0100, 2, 0, 0, 0)
    for bad in (b"\xc0\x13\0\1\0\1", b"\xff\xff\0\1\0\1", label("a" * 60 + "." + ".".join(["b" * 60] * 5)) + b"\0\1\0\1", b"\x05ab"):
        m = names.message_of(head + label("x") + b"\0\1\0\1" + bad)
        assert [q["name"] for q in m["questions"]] == ["x"] and m["records"] == []
    rng = random.Random(2)
    for _ in range(5000):
        names.message_of(struct.pack(">6H", 1, 0, 2, 3, 1, 1) + bytes(rng.choice([0, 1, 3, 192, 12, 255, 97]) for _ in range(rng.randrange(80))))
    assert names.split_messages(b"\0\2ab\0\0\0\5ab") == [b"ab", b""]


def test_walks_without_a_count(spark):
    """Hundreds of TLS records, ASN.1 elements and nested levels."""
    stream = b"".join(b"\x16\x03\x03\0\1" + bytes([i % 256]) for i in range(700)) + b"\x15\x03\x03\0\2\x02\x28"
    (r,) = spark.createDataFrame([(stream,)], "s binary").select(web.handshakes(F.col("s")).alias("h"), web.alerts(F.col("s")).alias("a")).collect()
    assert len(r.h) == 700 and [(a.level, a.code) for a in r.a] == [("fatal", 40)]
    assert len(wire.ber_elements(b"\x02\x01\x05" * 1000)) == 1000
    deep = b""
    for _ in range(5000):
        deep = b"\x30\x82" + len(deep).to_bytes(2) + deep if len(deep) < 65000 else deep
    assert len(wire.ber_elements(deep)) == 64
    lists = spark.createDataFrame([(b"".join(bytes([1, 1, 65]) for _ in range(300)),)], "d binary").select(F.size(wire.records(F.col("d"), 0, F.length("d"), 2, lambda at: wire.uint(F.col("d"), at + 1, 1))).alias("n"))
    assert lists.head().n == 300
