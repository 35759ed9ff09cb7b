"""Frames that are cut off, tagged, chained or hostile, and captures whose numbers repeat."""

import random
import struct

from tidelane.operators import flows, keys
from tidelane.sources import frames

ETHER = bytes(12)


def v4(proto: int, body: bytes, src=b"\x0a\0\0\x01", dst=b"\x0a\0\0\x02", word=0) -> bytes:
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 7, word, 64, proto, 0) + src + dst + body


def udp(src: int, dst: int, body: bytes) -> bytes:
    return struct.pack(">HHHH", src, dst, 8 + len(body), 0) + body


def decoded(spark, made: list):
    table = spark.createDataFrame(list(enumerate(made)), "i long, frame binary")
    return frames.decode(table).orderBy("i").collect()


def test_any_bytes_decode(spark):
    """Cut off anywhere or random: a row for each frame, and fields only where their bytes are."""
    whole = ETHER + b"\x81\0\0\x05\x81\0\0\x06\x08\0" + v4(6, struct.pack(">HHIIBBHHH", 1, 2, 3, 4, 0x70, 2, 5, 0, 0) + b"\x02\x04\x05\xb4\x01\x01\x01\x00" + b"data")
    rng = random.Random(1)
    made = [whole[:n] for n in range(len(whole) + 1)] + [bytes(rng.randrange(256) for _ in range(rng.randrange(80))) for _ in range(300)] + [None, b""]
    rows = decoded(spark, made)
    assert len(rows) == len(made)
    last = rows[len(whole)]
    assert (last.src_port, last.tcp.options[0].kind, last.tcp.options[0].size, len(last.tcp.options), bytes(last.payload), [v.vid for v in last.vlans]) == (1, 2, 2, 4, b"data", [5, 6])
    for n, r in enumerate(rows[: len(whole)]):
        assert r.ip is None or n >= 42
        assert r.truncated == (n < (14 if r.ip is None else 42 + 28 if n >= 55 else 42))
    assert rows[-2].ip is None and rows[-1].ip is None


def test_many_tags_and_extension_headers(spark):
    """Twenty tags, twelve IPv6 headers, mapped addresses."""
    tagged = ETHER + b"".join(b"\x81\0" + n.to_bytes(2) for n in range(20)) + b"\x08\0" + v4(17, udp(5, 6, b"x"))
    chain = b"".join(bytes([60 if n < 11 else 17, 0]) + bytes(6) for n in range(12)) + udp(7, 8, b"y")
    address = bytes(10) + b"\xff\xff\x01\x02\x03\x04"
    six = ETHER + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28 | 99, len(chain), 60, 3) + address + bytes(15) + b"\x01" + chain
    a, b = decoded(spark, [tagged, six])
    assert [v.vid for v in a.vlans] == list(range(20)) and a.src_port == 5
    assert (b.src_ip, b.dst_ip, b.src_port, b.ip.label, bytes(b.payload), bytes(b.ip.src_bytes)) == ("::ffff:1.2.3.4", "::1", 7, 99, b"y", address)


def test_gtp_extension_headers(spark):
    """Two headers, ports on either side; a header without a length or beyond the end leaves the frame alone."""
    inner = v4(17, udp(1, 53, b"in"), src=b"\x09\x09\x09\x09")
    head = lambda flags, extra: bytes([0x30 | flags, 255, 0, 0]) + (77).to_bytes(4) + extra
    chain = b"\0\0\0\x85" + b"\x01\xaa\xbb\xc0" + b"\x02" + bytes(6) + b"\0"
    made = [(udp(2152, 40000, head(4, chain) + inner)), udp(40000, 2152, head(2, b"\0\x01\0\0") + inner), udp(1, 2152, head(0, b"") + inner), udp(1, 2152, head(4, b"\0\0\0\x85\0\0\0\0") + inner), udp(1, 2152, head(4, b"\0\0\0\x85\xff\0") + inner), udp(1, 2152, head(0, b"") + b"\x10garbage")]
    table = spark.createDataFrame([(i, ETHER + b"\x08\0" + v4(17, m)) for i, m in enumerate(made)], "i long, frame binary")
    got = frames.decode(frames.decapsulate(table)).orderBy("i").collect()
    assert [(r.src_ip, r.tunnel, r.tunnel_number) for r in got] == [("9.9.9.9", "gtpu", 77)] * 3 + [("10.0.0.1", None, None)] * 3


def test_two_captures_with_the_same_numbers(spark):
    """Numbers that restart in each file: a row for each packet, in order of time, file and number."""
    flags = [2, 18, 16, 4]
    rows = [(f"f{c}", n, 10 * n, "k", "tcp", n % 2 == 0, f, f"{c}{n}") for c in range(2) for n, f in enumerate(flags)]
    table = spark.createDataFrame(rows, "path string, seq long, us long, k string, l4 string, forward boolean, flags int, note string")
    got = flows.with_lifecycle(table, "k").orderBy("us", "path", "seq").collect()
    assert len(got) == 8 and [r.note for r in got] == ["00", "10", "01", "11", "02", "12", "03", "13"]
    assert [r.flow_no for r in got] == [0] * 7 + [1] and [r.reason for r in got] == [None] * 6 + ["rst", "rst"]
    apart = flows.with_lifecycle(table, ["path", "k"]).collect()
    assert len(apart) == 8 and all(r.flow_no == 0 for r in apart)


def test_keys_of_mapped_and_plain_addresses(spark):
    made = [ETHER + b"\x08\0" + v4(17, udp(1, 2, b"")), ETHER + b"\x08\0" + v4(17, udp(2, 1, b""), src=b"\x0a\0\0\x02", dst=b"\x0a\0\0\x01")]
    table = spark.createDataFrame(list(enumerate(made)), "i long, frame binary")
    got = keys.five_tuple(frames.decode(table)).orderBy("i").collect()
    assert got[0].key == got[1].key and (got[0].forward, got[1].forward) == (True, False)
