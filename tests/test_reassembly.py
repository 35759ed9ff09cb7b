"""Reassembly against a model of single bytes, its reasons to give up, its speed on hostile orders, and anomaly rows."""

import random
import time

import pytest

from tidelane.operators.reassembly import PIECE, POLICIES, Rules, SideStream, anomalies, both_ways, chunks, side_totals


def bytewise(policy: str, segments: list[tuple[int, bytes]]) -> tuple[bytes, list[int]]:
    """(stream, gaps): one dict entry a byte, delivered as soon as it is next; what is left comes at the end."""
    waiting, at, stream, gaps = {}, 0, bytearray(), []
    for start, data in segments:
        overlapping = bool(waiting) or start != at
        for i, byte in enumerate(data, start):
            if i < at:
                continue
            old = waiting.get(i)
            first = max(start, at) if overlapping else start
            if old is None or policy == "last" or policy == "lower_seq" and first < old[1] or policy == "higher_seq" and first > old[1]:
                if old is None or old[0] != byte:
                    waiting[i] = (byte, first)
        while at in waiting:
            stream.append(waiting.pop(at)[0])
            at += 1
    while waiting:
        gaps.append(min(waiting) - at)
        at = min(waiting)
        while at in waiting:
            stream.append(waiting.pop(at)[0])
            at += 1
    return bytes(stream), gaps


@pytest.mark.parametrize("policy", POLICIES)
def test_random_orders_equal_the_model(policy):
    rng = random.Random(policy)
    for _ in range(3000):
        base = rng.choice([0, 1000, (1 << 32) - 30, (1 << 31) - 5])
        segments = [(rng.randrange(60), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 15)))) for _ in range(rng.randint(1, 14))]
        s = SideStream(Rules(policy=policy, waiting=1 << 30, patience_us=1 << 40))
        s.anchor(base, 0)
        out = []
        for i, (start, data) in enumerate(segments):
            s.segment((base + start) % (1 << 32), data, i)
            out += s.taken()
        out += s.finish()
        stream, gaps = bytewise(policy, segments)
        assert b"".join(o[1] for o in out) == stream, segments
        assert [o[2] for o in out if o[2]] == gaps and s.gap_bytes == sum(gaps)
        at = 0
        for offset, data, gap, _ in out:
            assert offset == at + gap
            at = offset + len(data)


@pytest.mark.parametrize("order", ["up", "down", "shuffled", "every second"])
def test_three_hundred_thousand_bytes_above_a_hole(order):
    """Segments of one byte cost no more than a few microseconds each in any order, within the bound on waiting bytes."""
    places = list(range(1, 300_001))
    if order == "down":
        places.reverse()
    elif order == "shuffled":
        random.Random(1).shuffle(places)
    elif order == "every second":
        places = places[::2] + places[1::2]
    s, began = SideStream(Rules(waiting=256 * 1024)), time.perf_counter()
    s.anchor(0, 0)
    for p in places:
        s.segment(p, b"x", 1)
        s.taken()
        assert s.pieces.charged() <= 256 * 1024 and len(s.pieces.starts) <= 256 * 1024 // PIECE
    assert time.perf_counter() - began < 15
    s.finish()
    assert s.gaps >= 1


def run(rules, rows, origin=0):
    """rows: (us, what, ...) -> (gaps by cause, bytes)"""
    s, out = SideStream(rules), []
    s.anchor(origin, 0)
    for us, what, *values in rows:
        getattr(s, what)(*values, us)
        out += [(us, *o) for o in s.taken()]
    return out, s


def test_reasons_to_give_up():
    data = [(10, "segment", 0, b"abc"), (20, "segment", 5, b"fg")]
    out, _ = run(Rules(), [*data, (30, "acknowledged", 8), (10_029, "acknowledged", 8), (10_031, "acknowledged", 8)])
    assert out[1:] == [(10_031, 5, b"fg", 2, "acknowledged")]
    out, _ = run(Rules(), [*data, (900_000, "segment", 8, b"i"), (1_000_021, "segment", 9, b"j")])
    assert [o[0] for o in out] == [10, 1_000_021] and out[1][3:] == (2, "deadline")  # two segments bear the hole out
    out, _ = run(Rules(), [*data, (3_900_000, "acknowledged", 3), (4_000_021, "acknowledged", 3)])
    assert out[1:] == [(4_000_021, 5, b"fg", 2, "deadline")]  # one alone waits four times as long
    out, _ = run(Rules(waiting=2 * PIECE + 4), [*data, (21, "segment", 9, b"jk"), (22, "segment", 13, b"n")])
    assert out[1:] == [(22, 5, b"fg", 2, "full")]
    assert run(Rules(waiting=0), data)[0][1:] == [(20, 5, b"fg", 2, "full")]
    out, s = run(Rules(), data)
    assert s.finish() == [(5, b"fg", 2, "end")]


def test_bytes_that_the_capture_cut():
    out, s = run(Rules(), [(1, "segment", 0, b"abc"), (2, "cut", 3, 4), (3, "segment", 7, b"h")])
    assert out == [(1, 0, b"abc", 0, None), (2, 7, b"", 4, "cut"), (3, 7, b"h", 0, None)]
    out, s = run(Rules(), [(1, "segment", 5, b"fg"), (2, "cut", 0, 9)])
    assert [o[1:] for o in out] == [(5, b"fg", 5, "cut"), (9, b"", 2, "cut")]
    out, s = run(Rules(), [(1, "segment", 0, b"abc"), (2, "fin", 6), (3, "acknowledged", 7), (20_000, "acknowledged", 7)])
    assert [o[1:] for o in out[1:]] == [(6, b"", 3, "acknowledged")] and s.fin_at == 6  # a FIN has a number, but no byte


def test_strays_and_late_segments():
    far = 5 << 20
    out, s = run(Rules(), [(1, "segment", 0, b"abc"), (2, "segment", far, b"x")])
    assert len(out) == 1 and s.out_of_window == 1 and s.finish() == []
    out, s = run(Rules(), [(1, "segment", 0, b"abc"), (2, "segment", far, b"x"), (3, "segment", far + 1, b"y")])
    assert [o[1:3] for o in out] == [(0, b"abc"), (far, b"x"), (far + 1, b"y")] and out[1][3:] == (far - 3, "resync") and (s.out_of_window, s.resets) == (0, 1)
    out, s = run(Rules(), [(1, "segment", 0, b"abc"), (2, "segment", far, b"x"), (3, "acknowledged", far + 2)])
    assert out[1][1:] == (far, b"x", far - 3, "resync")
    out, s = run(Rules(waiting=0), [(1, "segment", 0, b"abc"), (2, "segment", 9, b"j"), (3, "segment", 4, b"efg"), (4, "segment", 0, b"ab"), (5, "segment", 2, b"c" * 9)])
    assert (s.dropped, s.retransmits, s.gaps) == (1, 2, 1) and out[-1][1:3] == (10, b"c")


def test_caps():
    out, s = run(Rules(cap=4), [(1, "segment", 0, b"abcdef")])
    assert out == [(1, 2, b"cdef", 2, "overflow")] and s.oversize == 2
    out, s = run(Rules(cap=4, overflow="drop_flow"), [(1, "segment", 0, b"abc"), (2, "segment", 3, b"defgh"), (3, "segment", 8, b"i")])
    assert [o[2] for o in out] == [b"abc"] and s.stopped and s.oversize == 5


PACKETS = "flow long, side string, us long, seq long, tcp_seq long, tcp_ack long, flags int, payload binary, missing long"


def test_packets_of_both_sides(spark):
    """An acknowledgement of the other side gives a hole up; rows come in order; anomalies follow the counters."""
    rows = [
        (1, "initiator", 0, 0, 99, 0, 2, b"", 0), (1, "responder", 10, 1, 499, 100, 18, b"", 0), (1, "initiator", 20, 2, 100, 500, 24, b"GET ", 0),
        (1, "initiator", 30, 3, 108, 500, 24, b"HTTP", 0), (1, "responder", 40, 4, 500, 112, 16, b"", 0), (1, "responder", 20_000, 5, 500, 112, 24, b"OK", 3),
        (1, "initiator", 20_010, 6, 104, 505, 16, b"/aaa", 0), (1, "initiator", 20_020, 7, 112, 505, 17, b"", 0), (1, "initiator", 20_030, 8, 100, 505, 24, b"GET ", 0),
    ]
    p = both_ways(spark.createDataFrame(rows, PACKETS))
    got = [(r.side, r.us, r.offset, bytes(r.chunk), r.gap, r.cause) for r in chunks(p, ["flow", "side"]).orderBy("us", "side", "offset").collect()]
    assert got == [("initiator", 20, 0, b"GET ", 0, None), ("initiator", 20_000, 8, b"HTTP", 4, "acknowledged"), ("responder", 20_000, 0, b"OK", 0, None), ("responder", 20_000, 5, b"", 3, "cut")]
    told = [(r.side, r.us, r.kind, r["count"], r.bytes) for r in anomalies(p, ["flow", "side"]).orderBy("us", "side").collect()]
    assert told == [("initiator", 20_000, "stream_gap", 1, 4), ("responder", 20_000, "stream_gap", 1, 3), ("initiator", 20_010, "out_of_order", 1, None), ("initiator", 20_030, "retransmitted", 1, None)]
    totals = {r.side: (r.reached, r.gap_bytes, r.retransmits, r.dropped) for r in side_totals(p, ["flow", "side"]).collect()}
    assert totals == {"initiator": (12, 4, 1, 1), "responder": (5, 3, 0, 0)}
