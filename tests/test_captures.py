"""Capture files in ranges of any size, classic and block-structured, and messages of two files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelane.operators import sessions
from tidelane.sources import pcap

MOST = 2048


def frames(n: int, seed: int = 1) -> list[bytes]:
    """Packets of which some hold parts of captures."""
    rng = random.Random(seed)
    nested = b"".join(struct.pack("<4I", 5, 6, 40, 40) + bytes(40) for _ in range(20))
    out = []
    for i in range(n):
        kind = rng.randrange(4)
        out.append(rng.randbytes(rng.randrange(200)) if kind < 2 else nested[: rng.randrange(900)] if kind == 2 else nested[: 56 * rng.randrange(1, 20)])
    return out


def classic(packets, order="<", nanos=False, more=3) -> bytes:
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    return struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "4I", i, i % 1000, len(p), len(p) + more) + p for i, p in enumerate(packets))


def block(kind: int, body: bytes, order: str) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def option(code: int, value: bytes, order: str) -> bytes:
    return struct.pack(order + "HH", code, len(value)) + value + bytes(-len(value) % 4)


def section(packets, order: str, second: bool) -> bytes:
    """A section with an interface in microseconds, and later one in 2^-10 seconds with an offset; simple packets, too."""
    out = block(pcap.SECTION, struct.pack(order + "IHHq", pcap.ORDER_MARK, 1, 0, -1), order)
    out += block(pcap.INTERFACE, struct.pack(order + "HHI", 1, 0, 0), order) + block(5, bytes(20), order)
    for i, p in enumerate(packets):
        if i == len(packets) // 2 and second:
            out += block(pcap.INTERFACE, struct.pack(order + "HHI", 101, 0, 0) + option(9, b"\x8a", order) + option(14, struct.pack(order + "q", 100), order), order)
        number = int(second and i >= len(packets) // 2)
        ticks = i * 1024 + 512 if number else i * 1_000_000 + 7
        flags = option(2, struct.pack(order + "I", 1 + i % 2), order) + option(0, b"", order) if i % 3 == 0 else b""
        out += block(pcap.PACKET, struct.pack(order + "5I", number, ticks >> 32, ticks & 0xFFFFFFFF, len(p), len(p) + 1) + p + bytes(-len(p) % 4) + flags, order)
        if i % 10 == 9:
            out += block(pcap.SIMPLE_PACKET, struct.pack(order + "I", len(p)) + p, order)
    return out


def rows(frame):
    return [tuple(r)[1:-1] + (bytes(r.frame),) for r in frame.orderBy("path", "seq").collect()]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["classic", "nanos", "blocks"])
def test_ranges_equal_the_whole(spark, tmp_path, kind, order):
    packets = frames(900)
    other = ">" if order == "<" else "<"
    data = section(packets[:500], order, True) + section(packets[500:], other, False) if kind == "blocks" else classic(packets, order, kind == "nanos")
    path = tmp_path / "a.cap"
    path.write_bytes(data)
    whole = rows(pcap.captures(spark.read.format("binaryFile").load(str(path))))
    assert [r[-1] for r in whole if kind != "blocks" or r[1] is not None] == packets
    for split in (3000, 20_011, 1 << 30):
        got = pcap.read_captures(spark, [str(path)], split, MOST)
        assert rows(got) == whole
        if split == 20_011:
            assert got.rdd.getNumPartitions() == -(-len(data) // split)


def test_fields_of_blocks(spark, tmp_path):
    path = tmp_path / "b.pcapng"
    path.write_bytes(section([b"ab", b"cdefg", b"x", b"yz"], "<", True))
    got = pcap.read_captures(spark, [str(path)]).orderBy("seq").collect()
    assert [(r.us, r.nanos, r.wire_len, r.link_type, r.interface, r.direction, bytes(r.frame)) for r in got] == [
        (7, 7000, 3, 1, 0, "inbound", b"ab"), (1_000_007, 7000, 6, 1, 0, None, b"cdefg"), (102_500_000, 500_000_000, 2, 101, 1, None, b"x"), (103_500_000, 500_000_000, 3, 101, 1, "outbound", b"yz"),
    ]


def test_broken_files(spark, tmp_path):
    """Cut off anywhere, a file gives its whole records; an empty file none; other files are an error."""
    packets = frames(20)
    for name, data in (("c", classic(packets)), ("b", section(packets, "<", False))):
        ends = [len(data[:n]) for n in (0, 10, len(data) // 2, len(data) - 1)]
        for i, n in enumerate(ends):
            path = tmp_path / f"{name}{i}"
            path.write_bytes(data[:n])
            if n == 10 and name == "c":
                with pytest.raises(Exception, match="not a capture file"):
                    pcap.read_captures(spark, [str(path)]).collect()
                continue
            got = rows(pcap.read_captures(spark, [str(path)]))
            assert [r[-1] for r in got if r[1] is not None] == packets[: sum(r[1] is not None for r in got)] and len(got) < 23


def ip_frame(proto: int, body: bytes, forward: bool) -> bytes:
    a, b = b"\x0a\0\0\x01", b"\x0a\0\0\x02"
    return bytes(12) + b"\x08\0" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 7, 0, 64, proto, 0) + (a + b if forward else b + a) + body


def tcp(forward: bool, port: int, seq: int, ack: int, flags: int, data: bytes = b"") -> bytes:
    ports = (port, 80) if forward else (80, port)
    return ip_frame(6, struct.pack(">HHIIBBHHH", *ports, seq, ack, 0x50, flags, 9, 0, 0) + data, forward)


def exchange(port: int) -> list[bytes]:
    ask, answer = b"GET /%d HTTP/1.1\r\n\r\n" % port, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    return [tcp(True, port, 9, 0, 2), tcp(False, port, 99, 10, 18), tcp(True, port, 10, 100, 16), tcp(True, port, 10, 100, 24, ask), tcp(False, port, 100, 10 + len(ask), 24, answer[:9]), tcp(False, port, 109, 10 + len(ask), 24, answer[9:]), tcp(True, port, 10 + len(ask), 100 + len(answer), 4)]


def test_messages_of_two_captures(spark, tmp_path):
    """The same numbers in two files; a flow that goes on from one file to the next; one placement for all steps."""
    first, second = exchange(1000), exchange(2000)
    paths = [tmp_path / "1.pcap", tmp_path / "2.pcap"]
    for path, packets in zip(paths, (first[:4] + second, first[4:] + [b"\0\1"]), strict=True):
        path.write_bytes(classic(packets, more=0))
    both = pcap.read_captures(spark, list(map(str, paths)))
    later = F.when(F.col("path").endswith("2.pcap"), 20_000_000).otherwise(0)
    packets = sessions.tracked(both.withColumn("us", F.col("us") + later))
    got = sessions.pulses(packets).orderBy("key", "us", "seq", "n").collect()
    told = [(r.pulse, r.reason, r.http and (r.http.path or r.http.body)) for r in got]
    one = lambda p: [("started", None, None), ("established", None, None), ("message", None, f"/{p}"), ("message", None, "hi"), ("ended", "rst", None)]
    assert told == one(1000) + one(2000)
    plan = sessions.http_messages(packets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
