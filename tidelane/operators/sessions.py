"""From frames to messages: keys, lifecycle, byte streams and parsers on one placement of packets by flow key.

Packets are shuffled once, by key. Every later step (lifecycle, reassembly, parsers) only sorts within the partitions that come out
of that, so a capture of any size costs one shuffle of its packets. All packets of one key are one task's work, in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.operators import flows, reassembly
from tidelane.operators.folds import joined, ordered_fold
from tidelane.parsers import names, web
from tidelane.sources import headers

FLOW = ["key", "flow_no"]
DNS_PORT = 53
PACKET = "path string, seq long, us long, key string, forward boolean, l4 string, flags int, tcp_seq long, tcp_ack long, payload binary, missing long, bytes long, src_port int, dst_port int"
TRANSPORTS = {headers.TCP: "tcp", headers.UDP: "udp", headers.ICMP: "icmp", headers.ICMPV6: "icmp6"}


def packets_of(batches: Iterable, form) -> Iterator:
    """Batches of PACKET, whose Arrow schema is `form`, out of batches of path, seq, us, frame and wire_len, a whole batch at a time.

    They are what `frames.decode` and `keys.five_tuple` tell of each frame, with the key as JSON.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in joined(batches):
        h = headers.read(batch.column("frame"))
        there = h.field("version").is_valid()
        if there.false_count:
            batch, h = batch.filter(there), h.filter(there)
        if not batch.num_rows:
            continue
        n, b = batch.num_rows, headers.Bytes(batch.column("frame"))
        number = lambda c: pc.fill_null(h.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        at, proto, four = number("at"), number("proto"), number("version") == 4
        ports = [number("src_port"), number("dst_port")]
        ends = [[np.where(four, b.uint(at + short, 4), b.uint(at + long, 4)), *[np.where(four, 0, b.uint(at + long + i, 4)) for i in (4, 8, 12) if not four.all()], port] for short, long, port in zip((12, 16), (8, 24), ports, strict=True)]
        forward = np.ones(n, bool)
        for one, other in reversed(list(zip(*ends, strict=True))):
            forward = np.where(one == other, forward, one < other)
        known = list(TRANSPORTS)
        l4 = pa.array([*TRANSPORTS.values(), "other"]).take(pa.array(np.select([proto == k for k in known], range(len(known)), len(known))))
        way, src, dst = pa.array(forward), h.field("src"), h.field("dst")
        port = lambda a, b: pa.array(np.where(forward, a, b)).cast(pa.string())  # noqa: B023, E731
        key = pc.binary_join_element_wise('{"proto":"', l4, '","a_ip":"', pc.if_else(way, src, dst), '","a_port":', port(*ports), ',"b_ip":"', pc.if_else(way, dst, src), '","b_port":', port(*ports[::-1]), "}", "")
        begin = number("l4") + number("head")
        stop = np.minimum(np.maximum(begin, number("end")), b.size)
        # bytes before, in and behind each payload, of which the second are taken
        parts = np.append(np.stack([b.start, b.start + np.minimum(begin, b.size), b.start + stop], 1).reshape(-1), len(b.data)).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), 3 * n, [None, pa.py_buffer(parts), pa.py_buffer(b.data)]).take(pa.array(np.arange(n) * 3 + 1))
        wire = pc.fill_null(batch.column("wire_len"), 0).to_numpy(zero_copy_only=False)
        missing = np.where(np.isin(proto, (headers.TCP, headers.UDP)), np.maximum(wire - b.size, 0), 0)
        flags = pc.fill_null(h.field("flags"), 0)
        columns = [*[batch.column(c) for c in ("path", "seq", "us")], key, way, l4, flags, h.field("seq"), h.field("ack"), payload, missing, batch.column("wire_len"), h.field("src_port"), h.field("dst_port")]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, form, strict=True)], schema=form)


def flow_packets(captured: DataFrame, column: str = "frame") -> DataFrame:
    """PACKET of frames (path, seq, us, `column`, and wire_len if it is known); those without an IP header are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wire_len = F.col("wire_len") if "wire_len" in captured.columns else F.length(column)
    path = F.col("path") if "path" in captured.columns else F.lit("")
    named = captured.select(path.alias("path"), F.col("seq").cast("long").alias("seq"), F.col("us").cast("long").alias("us"), F.col(column).alias("frame"), wire_len.cast("long").alias("wire_len"))
    form = to_arrow_schema(_parse_datatype_string(PACKET))
    return named.mapInArrow(lambda batches: packets_of(batches, form), PACKET)


def tracked(captured: DataFrame, column: str = "frame", **options) -> DataFrame:
    """Packets of flows out of frames (path, seq, us, `column`, and wire_len if it is known), placed by key.

    nth is a packet's place among those of its key, by us, path and seq. Frames without an IP header are left out. `options` are those
    of flows.with_lifecycle.
    """
    return flows.with_lifecycle(flow_packets(captured, column), "key", **options)


def key_fields(key: Column) -> Column:
    """struct<proto, a_ip, a_port, b_ip, b_port> of a key's text."""
    return F.from_json(key, "proto string, a_ip string, a_port int, b_ip string, b_port int")


def byte_streams(packets: DataFrame, rules: reassembly.Rules = reassembly.Rules()) -> DataFrame:  # noqa: B008 - frozen
    """key, flow_no, side and the chunks of TCP flows out of `tracked`, placed by key; seq is nth."""
    tcp = packets.filter("tcp_seq is not null").select(*FLOW, "us", F.col("nth").alias("seq"), "side", "tcp_seq", "tcp_ack", "flags", "payload", "missing")
    return reassembly.chunks(reassembly.both_ways(tcp), [*FLOW, "side"], rules, placed=True)


def http_messages(packets: DataFrame) -> DataFrame:
    """key, flow_no, side, us, seq, n, message: HTTP/1 messages of all flows that carry them."""
    return web.http_messages(byte_streams(packets), [*FLOW, "side"], placed=True)


def dns_messages(packets: DataFrame, port: int = DNS_PORT) -> DataFrame:
    """key, flow_no, side, us, seq, n, message: DNS over UDP, and over TCP once a message's bytes are there."""
    either = (F.col("src_port") == port) | (F.col("dst_port") == port)
    udp = packets.filter((F.col("l4") == "udp") & either).select(*FLOW, "side", "us", F.col("nth").alias("seq"), F.lit(0).alias("n"), "payload")
    tcp = names.framed(byte_streams(packets.filter((F.col("l4") == "tcp") & either)), [*FLOW, "side"], placed=True)
    both = udp.unionByName(tcp).withColumn("message", names.dns(F.col("payload"))).drop("payload")
    return both.filter("message is not null")


def life(packets: DataFrame) -> DataFrame:
    """key, flow_no, us, seq, n, pulse, reason: started, established and ended of each flow; ended by idling at its last packet."""
    first = F.min(F.struct("us", "nth"))
    last = F.max(F.struct("us", "nth", F.coalesce("reason", F.lit("idle_timeout")).alias("reason")))
    made = F.min(F.when(F.col("established"), F.struct("us", "nth")))
    each = packets.groupBy(*FLOW).agg(first.alias("a"), made.alias("b"), last.alias("c"))
    one = lambda at, n, pulse, reason=None: F.struct(at["us"].alias("us"), at["nth"].alias("seq"), F.lit(n).alias("n"), F.lit(pulse).alias("pulse"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = F.array_compact(F.array(one(a, -2, "started"), F.when(b.isNotNull(), one(b, -1, "established")), one(c, 1 << 20, "ended", c["reason"])))
    return each.select(*FLOW, F.inline(rows))


class Side:
    """One side of a TCP flow: its stream, the messages in it, and us and nth of its last packet and of its last chunk."""

    __slots__ = ("number", "name", "stream", "http", "dns", "packet", "chunk")

    def __init__(self, number: int, name: str, rules: reassembly.Rules, dns: bool):
        self.number, self.name, self.stream, self.http, self.dns = number, name, reassembly.SideStream(rules), web.HttpSide(), [b"", False] if dns else None
        self.packet = self.chunk = None

    def told(self, chunks: list[tuple], at: tuple[int, int]) -> list[tuple]:
        """What chunks of the stream carry."""
        out = []
        for _, data, gap, _ in chunks:
            self.chunk = at
            out += [(self.number, *at, i, "message", None, self.name, "http", m, None) for i, m in enumerate(self.http.take(data, gap))]
            if self.dns is not None:
                asked = ((i, names.message_of(m)) for i, m in enumerate(names.framed_step(self.dns, data, gap)))
                out += [(self.number, *at, i, "message", None, self.name, "dns", None, m) for i, m in asked if m is not None]
        return out

    def finish(self) -> list[tuple]:
        left = self.stream.finish() if self.packet else []
        out = self.told(left, self.packet) if left else []
        last = self.http.finish()
        return [*out, (self.number, *self.chunk, 1 << 16, "message", None, self.name, "http", last, None)] if last else out


class Flow:
    """One flow with the streams of its sides, which are there from its first TCP segment on. All give rows of flow_no, us, seq, n, and pulse to dns."""

    __slots__ = ("number", "rules", "sides", "last", "reason", "established")

    def __init__(self, number: int, rules: reassembly.Rules):
        self.number, self.rules, self.sides, self.last, self.established = number, rules, None, None, False

    def packet(self, side, established, reason, us, nth, l4, flags, tcp_seq, tcp_ack, payload, missing, asks: bool) -> list[tuple]:
        """asks: whether a port is that of DNS."""
        out, at = [], (us, nth)
        if self.last is None:
            out.append((self.number, us, nth, -2, "started", None, None, None, None, None))
        if established and not self.established:
            self.established = True
            out.append((self.number, us, nth, -1, "established", None, None, None, None, None))
        self.last, self.reason = at, reason
        if tcp_seq is not None:
            if self.sides is None:
                self.sides = [Side(self.number, name, self.rules, asks) for name in ("initiator", "responder")]
            own, other = self.sides if side == "initiator" else self.sides[::-1]
            own.packet, stream = at, own.stream
            reassembly.fed(stream, us, tcp_seq, payload, flags & 2, flags & 1, None, missing)
            if stream.out or stream.missing:
                out += own.told(stream.taken(), at)
            if flags & 16:
                other.packet, stream = at, other.stream
                stream.acknowledged(tcp_ack, us)
                if stream.out or stream.missing:
                    out += other.told(stream.taken(), at)
        elif asks and l4 == "udp":
            message = names.message_of(payload)
            if message is not None:
                out.append((self.number, us, nth, 0, "message", None, side, "dns", None, message))
        return out

    def finish(self) -> list[tuple]:
        out = [r for s in self.sides for r in s.finish()] if self.sides else []
        return [*out, (self.number, *self.last, 1 << 20, "ended", self.reason or "idle_timeout", None, None, None, None)]


def flow_step(flow: list[Flow], rules: reassembly.Rules, number: int, *packet) -> list[tuple]:
    """Rows of one packet of a key. flow: the key's open flow, if there is one; packet: what Flow.packet takes."""
    if flow and flow[0].number == number:
        return flow[0].packet(*packet)
    done = flow[0].finish() if flow else []
    flow[:] = [Flow(number, rules)]
    return done + flow[0].packet(*packet)


CARRIED = ["l4", "flags", "tcp_seq", "tcp_ack", "payload", "missing"]


def asking(packets: DataFrame, port: int) -> DataFrame:
    """`packets` with asks: whether one of the ports is `port`."""
    return packets.withColumn("asks", F.coalesce((F.col("src_port") == port) | (F.col("dst_port") == port), F.lit(False)))


def pulse_schema(http: str, dns: str) -> str:
    return f"flow_no long, us long, seq long, n int, pulse string, reason string, side string, protocol string, http {http}, dns {dns}"


def pulses(packets: DataFrame, port: int = DNS_PORT, http: str = web.HTTP, dns: str = names.MESSAGE) -> DataFrame:
    """key, flow_no, us, seq, n, pulse, reason, side, protocol, http, dns: what happens on each flow of `tracked`; order by us, seq and n.

    Lifecycle rows stand before and after what their packet carries. The rows are those of `life`, `http_messages` and `dns_messages`
    together, but packets are read once, in one fold. http, dns: which fields of the messages are told.
    """
    rules = reassembly.Rules()

    def step(flow, us, nth, number, side, established, reason, *carried):
        return flow_step(flow, rules, number, side, established, reason, us, nth, *carried)

    columns = ["flow_no", "side", "established", "reason", *CARRIED, "asks"]
    return ordered_fold(asking(packets, port), "key", columns, list, step, pulse_schema(http, dns), lambda flow: flow[0].finish(), ("us", "nth"), placed=True)


def captured_pulses(captured: DataFrame, column: str = "frame", port: int = DNS_PORT, http: str = web.HTTP, dns: str = names.MESSAGE, parts: int | None = None, **options) -> DataFrame:
    """`pulses` of `tracked` frames, with the lifecycle in the same fold. options: those of flows.lifecycle_steps; parts: how many partitions."""
    rules, (start, life_step) = reassembly.Rules(), flows.lifecycle_steps(**options)

    def step(state, us, path, seq, forward, l4, flags, *carried):
        life, flow = state
        number, side, _, established, reason, nth = life_step(life, us, l4, forward, flags)
        return flow_step(flow, rules, number, side, established, reason, us, nth, l4, flags, *carried)

    columns = ["forward", *CARRIED, "asks"]
    return ordered_fold(asking(flow_packets(captured, column), port), "key", columns, lambda: [start(), []], step, pulse_schema(http, dns), lambda state: state[1][0].finish(), ("us", "path", "seq"), parts=parts)
