"""Connections: compressed headers, frames, encrypted hellos and reassembly, against public vectors and models."""

import random

import pytest

from pyspark.sql import functions as F

from tidelane.parsers import http2, quic


def hexed(text: str) -> bytes:
    return bytes.fromhex(text.replace(" ", ""))


def pairs(fields):
    return [(n.decode(), v.decode()) for n, v in fields]


def test_requests_of_the_public_examples():
    """RFC 7541, C.3 and C.4: three requests that share a table, plain and coded."""
    plain = ["8286 8441 0f77 7777 2e65 7861 6d70 6c65 2e63 6f6d", "8286 84be 5808 6e6f 2d63 6163 6865", "8287 85bf 400a 6375 7374 6f6d 2d6b 6579 0c63 7573 746f 6d2d 7661 6c75 65"]
    coded = ["8286 8441 8cf1 e3c2 e5f2 3a6b a0ab 90f4 ff", "8286 84be 5886 a8eb 1064 9cbf", "8287 85bf 4088 25a8 49e9 5ba9 7d7f 8925 a849 e95b b8e8 b4bf"]
    for blocks in (plain, coded):
        table = http2.HeaderTable()
        first, second, third = [pairs(table.decode(hexed(b))) for b in blocks]
        assert first == [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com")]
        assert second == [*first, ("cache-control", "no-cache")]
        assert third == [(":method", "GET"), (":scheme", "https"), (":path", "/index.html"), (":authority", "www.example.com"), ("custom-key", "custom-value")]
        assert table.size == 164


def test_answers_that_push_fields_out():
    """RFC 7541, C.6: a table of 256 bytes, coded values."""
    table = http2.HeaderTable()
    table.limited(256)
    first = pairs(table.decode(hexed("4882 6402 5885 aec3 771a 4b61 96d0 7abe 9410 54d4 44a8 2005 9504 0b81 66e0 82a6 2d1b ff6e 919d 29ad 1718 63c7 8f0b 97c8 e9ae 82ae 43d3")))
    assert first == [(":status", "302"), ("cache-control", "private"), ("date", "Mon, 21 Oct 2013 20:13:21 GMT"), ("location", "https://www.example.com")]
    assert table.size == 222
    assert pairs(table.decode(hexed("4883 640e ffc1 c0bf"))) == [(":status", "307"), *first[1:]] and table.size == 222
    third = pairs(table.decode(hexed("88c1 6196 d07a be94 1054 d444 a820 0595 040b 8166 e084 a62d 1bff c05a 839b d9ab 77ad 94e7 821d d7f2 e6c7 b335 dfdf cd5b 3960 d5af 2708 7f36 72c1 ab27 0fb5 291f 9587 3160 65c0 03ed 4ee5 b106 3d50 07")))
    assert third[-1] == ("set-cookie", "foo=ASDJKHQKBZXOQWEOPIUAXQWEOIU; max-age=3600; version=1") and third[2][1].endswith(":22 GMT") and table.size == 215


def test_every_byte_has_a_code():
    """The codes fill the tree exactly, and each string comes back from bits written by the same table."""
    assert sum(1 << (30 - b) for b in http2.SIZES) == 1 << 30 and sorted(http2.SYMBOLS) == list(range(257))
    code = {s: (c >> (30 - b), b) for c, b, s in zip(http2.STARTS, http2.SIZES, http2.SYMBOLS, strict=True)}
    assert code[ord("w")] == (0x78, 7) and code[10] == (0x3FFFFFFC, 30) and code[255] == (0x3FFFFEE, 26) and code[92] == (0x7FFF0, 19)
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        bits = "".join(f"{code[b][0]:0{code[b][1]}b}" for b in text)
        bits += "1" * (-len(bits) % 8)
        assert http2.huffman(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == text
    for bad in (b"\xff\xff\xff\xff", b"\xff", b"\x00", b"\xfe"):
        with pytest.raises(http2.Fault):
            http2.huffman(bad)


def test_numbers_and_broken_blocks():
    assert http2.whole_number(hexed("1f9a0a"), 0, 5) == (1337, 3) and http2.whole_number(b"\x0a", 0, 5) == (10, 1)
    for block, why in (("80", "unknown_field"), ("be", "unknown_field"), ("7f", "truncated_block"), ("4005", "truncated_block"), ("7f" + "ff" * 12 + "01", "number_too_large"), ("3fe1ff7f", "table_too_large"), ("82" * 257, "too_many_fields")):
        with pytest.raises(http2.Fault, match=why):
            http2.HeaderTable().decode(hexed(block))
    rng = random.Random(2)
    for _ in range(3000):  # nothing but a Fault comes of any bytes
        try:
            http2.HeaderTable().decode(bytes(rng.randrange(256) for _ in range(rng.randrange(60))))
        except http2.Fault:
            pass


def frame(kind, flags, stream, body=b""):
    return len(body).to_bytes(3) + bytes([kind, flags]) + stream.to_bytes(4) + body


OPEN = http2.PREFACE + frame(4, 0, 0)


def events_of(spark, chunks, **options):
    rows = [("c", i, 0, side, data, gap) for i, (side, data, gap) in enumerate(chunks)]
    got = http2.h2_events(spark.createDataFrame(rows, "c string, us long, seq long, side string, payload binary, gap long"), ["c"], **options)
    return [(r.side, r.event, r.stream, bytes(r.data) if r.data else None, r.code, r.error) for r in got.orderBy("us", "seq", "n").collect()]


def test_framing_does_not_depend_on_how_bytes_arrive(spark):
    block = hexed("828684418cf1e3c2e5f23a6ba0ab90f4ff")
    client = OPEN + frame(1, 0, 1, block[:3]) + frame(9, 0, 1, block[3:9]) + frame(9, 4, 1, block[9:]) + frame(0, 8, 1, b"\x02hello\0\0") + frame(1, 5, 1, hexed("00017801 79")) + frame(1, 0x25, 3, b"\0\0\0\0\x10" + b"\x82\x86\x84\xbe") + frame(6, 0, 0, b"12345678") + frame(3, 0, 3, b"\0\0\0\x08")
    whole = events_of(spark, [("initiator", client, 0)])
    assert [e[1:3] for e in whole] == [("head", 1), ("body", 1), ("trailers", 1), ("end", 1), ("head", 3), ("end", 3), ("reset", 3)] and whole[1][3] == b"hello" and whole[-1][4] == 8
    for size in (1, 2, 7, 50):
        assert events_of(spark, [("initiator", client[i : i + size], 0) for i in range(0, len(client), size)]) == whole


@pytest.mark.parametrize(
    ("client", "why"),
    [
        (b"GET / HTTP/1.1\r\n\r\n         ", "no_preface"),
        (OPEN + (1 << 21).to_bytes(3) + bytes(6), "frame_too_large"),
        (OPEN + frame(1, 0, 1, b"\x82") + frame(0, 0, 1, b"x"), "interleaved_block"),
        (OPEN + frame(9, 4, 1, b"\x82"), "lone_continuation"),
        (OPEN + frame(0, 8, 1, b"\x05abc"), "malformed_frame"),
        (OPEN + frame(3, 0, 1, b"abc"), "malformed_frame"),
        (OPEN + frame(4, 0, 0, b"abc"), "malformed_frame"),
        (OPEN + frame(1, 4, 1, b"\xff\xff\xff"), "truncated_block"),
        (OPEN + frame(1, 0, 1, bytes(40000)) + frame(9, 0, 1, bytes(40000)), "block_too_large"),
        (OPEN + b"".join(frame(1, 4, 2 * i + 1, b"\x82") for i in range(257)), "too_many_streams"),
    ],
)
def test_faults_end_a_connection(spark, client, why):
    got = events_of(spark, [("initiator", client, 0), ("responder", frame(1, 5, 1, b"\x88"), 0)])
    assert got[-1][1] == "error" and got[-1][-1] == why and sum(e[1] == "error" for e in got) == 1


def test_settings_gaps_promises_and_missing_prefaces(spark):
    """Settings bind the other side's table; a promise opens a stream of its own; a gap ends the connection."""
    small = frame(4, 0, 0, b"\x00\x01\x00\x00\x00\x00")
    got = events_of(spark, [("initiator", http2.PREFACE + small, 0), ("responder", frame(1, 4, 1, hexed("400161 0162")) + frame(5, 4, 1, b"\0\0\0\x02\x82") + frame(1, 4, 1, b"\xbe"), 0)])
    assert [e[1:3] for e in got] == [("settings", 0), ("head", 1), ("head", 2), ("error", 0)] and got[-1][-1] == "unknown_field"
    assert events_of(spark, [("initiator", frame(1, 5, 1, b"\x82"), 0)], strict=False)[0][1] == "head"
    lost = events_of(spark, [("initiator", OPEN, 0), ("initiator", frame(1, 5, 1, b"\x82"), 3), ("responder", frame(1, 5, 1, b"\x88"), 0)])
    assert [(e[1], e[-1]) for e in lost] == [("error", "gap")]


HELLO = hexed("060040f1010000ed0303ebf8fa56f12939b9584a3896472ec40bb863cfd3e86804fe3a47f06a2b69484c00000413011302010000c000000010000e00000b6578616d706c652e636f6dff01000100000a00080006001d0017001800100007000504616c706e000500050100000000003300260024001d00209370b2c9caa47fbabaf4559fedba753de171fa71f50f1ce15d43e994ec74d748002b0003020304000d0010000e0403050306030203080408050806002d00020101001c00024001003900320408ffffffffffffffff05048000ffff07048000ffff0801100104800075300901100f088394c8f03e51570806048000ffff")
DCID = hexed("8394c8f03e515708")


def test_keys_of_the_public_example():
    """RFC 9001, A.1, and RFC 9369, A.1."""
    assert {k: v.hex() for k, v in quic.client_keys(DCID, 1).items()} == {"key": "1f369613dd76d5467730efcbe3b1a22d", "iv": "fa044b2f42a3fd3b46fb255c", "hp": "9f50449e04a0e810283a1e9933adedd2"}
    assert quic.client_keys(DCID, 0x6B3343CF)["key"].hex() == "8b1a0bc121284290a29e0971b5cd045d"


def initial(spark, plain: bytes, pn: bytes = b"\0\0\0\x02", dcid: bytes = DCID, token: bytes = b"") -> bytes:
    """A protected packet, by Spark's encryption and XOR by hand."""
    keys = quic.client_keys(dcid, 1)
    head = bytes([0xC0 | len(pn) - 1]) + b"\0\0\0\x01" + bytes([len(dcid)]) + dcid + b"\0" + bytes([len(token)]) + token + (0x4000 | len(plain) + 16 + len(pn)).to_bytes(2) + pn
    nonce = (int.from_bytes(keys["iv"]) ^ int.from_bytes(pn)).to_bytes(12)
    one = spark.createDataFrame([(plain, keys["key"], keys["hp"], nonce, head)], "p binary, k binary, hp binary, n binary, a binary")
    sealed = bytes(one.select(F.aes_encrypt("p", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("n"), F.col("a"))).head()[0])[12:]
    mask = bytes(spark.createDataFrame([(sealed[4 - len(pn) : 20 - len(pn)], keys["hp"])], "s binary, hp binary").select(quic.mask_of(F.col("s"), F.col("hp"))).head()[0])
    first = bytes([head[0] ^ mask[0] & 15])
    return first + head[1 : -len(pn)] + bytes(a ^ b for a, b in zip(pn, mask[1:], strict=False)) + sealed


def hellos(spark, packets, **options):
    rows = [("f", us, i, p) for i, (us, p) in enumerate(packets)]
    return quic.quic_hellos(spark.createDataFrame(rows, "f string, us long, seq long, payload binary"), ["f"], **options).orderBy("us").collect()


def test_packet_of_the_public_example(spark):
    """RFC 9001, A.2: the protected header and the start of what follows are the published ones, and the name comes out."""
    packet = initial(spark, HELLO + bytes(1162 - len(HELLO)))
    assert len(packet) == 1200 and packet[:36].hex() == "c000000001088394c8f03e5157080000449e7b9aec34d1b1c98dd7689fb8ec11d242b123"
    (row,) = hellos(spark, [(5, packet + b"another packet")])
    assert (row.sni, row.alpn, row.version, bytes(row.dcid), row.packets, row.us) == ("example.com", ["alpn"], "v1", DCID, 1, 5) and row.ja4.startswith("q13d0211")


def test_hellos_across_packets(spark):
    """Fragments in any order, overlapping, repeated, with tokens and short numbers; packets that can't be opened don't count."""
    body = HELLO[4:]
    crypto = lambda a, b: b"\x06" + (0x4000 | a).to_bytes(2) + (0x4000 | b - a).to_bytes(2) + body[a:b]
    packets = [initial(spark, b"\x01" + crypto(200, len(body)) + bytes(30), b"\x07"), initial(spark, crypto(0, 120) + bytes(9), b"\0\x08", token=b"tok"), initial(spark, crypto(100, 210) + bytes(9), b"\0\0\x09")]
    (row,) = hellos(spark, [(i, p) for i, p in enumerate([*packets, packets[0]])])
    assert row.sni == "example.com" and row.packets == 3 and row.us == 2 and bytes(row.hello) == body
    broken = bytearray(packets[0])
    broken[-1] ^= 1
    other = [bytes(broken), packets[0][:60], b"\x40abc", b"", None, b"\xc0" + bytes(30)]
    assert hellos(spark, [(i, p) for i, p in enumerate(other)]) == []
    (left,) = hellos(spark, [(1, packets[0]), (2, packets[1])])
    assert left.sni is None and left.hello is None and left.packets == 2
    late = hellos(spark, [(1, packets[0]), (6_000_002, packets[1]), (6_000_003, packets[2])])
    assert [(r.packets, r.hello) for r in late] == [(1, None), (2, None)]
    (full,) = hellos(spark, [(1, packets[0]), (2, packets[1]), (3, packets[2])], frames=2)
    assert full.dropped == 1 and full.hello is None


def test_frames_of_opened_packets():
    assert quic.crypto_of(hexed("0001 02050301000102 0300000000010203 06000161 1c")) == [{"at": 0, "data": b"a"}]
    assert quic.crypto_of(hexed("060005 61")) is None and quic.crypto_of(b"\x40") is None and quic.crypto_of(None) is None
    rng = random.Random(5)
    for _ in range(3000):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        quic.crypto_of(data)
        quic.header_of(b"\xc3\0\0\0\x01" + data)


def test_certificates_of_a_chain(spark):
    """Chains over several messages, cut off at any byte; bytes that are no certificate give null."""
    from tidelane.parsers import certificates

    a, b = b"\x30\x82\x01\x00FAKE_LEAF", b"\x30\x82\x02\x00FAKE_INTERMEDIATE"
    listed = lambda *ders: (lambda body: b"\x0b" + (len(body) + 3).to_bytes(3) + len(body).to_bytes(3) + body)(b"".join(len(d).to_bytes(3) + d for d in ders))
    both = b"\x02\0\0\x02hi" + listed(a, b) + listed() + b"\x0e\0\0\0"
    assert certificates.chain_of(both) == [a, b] and certificates.chain_of(both[:-9]) == [a, b] and certificates.chain_of(b"\x02\0\0\x02hi") == []
    for n in range(len(both)):
        certificates.chain_of(both[:n])
    assert certificates.certificate_of(a) is None and certificates.certificate_of(b"") is None
    assert certificates.time_of(0x17, b"500101000000Z") == -631152000000000 and certificates.time_of(0x18, b"20380119031408Z") == 2147483648000000
    rng = random.Random(8)
    for _ in range(3000):
        certificates.certificate_of(bytes(rng.choice([0x30, 0x02, 0x31, 0xA0, 3, 1, 0x84, 0]) for _ in range(rng.randrange(60))))
