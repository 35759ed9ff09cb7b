"""Header fields of whole batches of frames at once: numpy over the bytes of an Arrow column, a mask for each kind of header."""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: EtherTypes of tags, labels and packets, IP protocols, and IPv6 headers that name a next one.
VLAN, MPLS, IPV4, IPV6 = (0x8100, 0x88A8, 0x9100), (0x8847, 0x8848), 0x0800, 0x86DD
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
LONG_HEADERS, FRAGMENT, AUTHENTICATION = (0, 43, 60), 44, 51

SCHEMA = (
    "type int, at int, vlans array<struct<vid:bigint,pcp:bigint,dei:boolean>>, mpls array<struct<label:bigint,tc:bigint,bottom:boolean,ttl:bigint>>, version int, src string, dst string, proto bigint, ttl bigint, "
    "dscp bigint, ecn bigint, id bigint, df boolean, mf boolean, fragment bigint, label bigint, l4 int, end int, head int, src_port int, dst_port int, seq bigint, ack bigint, flags int, window int, options array<struct<kind:bigint,at:int,size:int>>"
)


class Bytes:
    """The bytes of a batch: big-endian numbers at a place of each row, 0 where a row is too short."""

    def __init__(self, column: pa.Array):
        buffers = column.buffers()
        wide = pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        if column.null_count:
            self.size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, self.size)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
        self.data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
        self.start = self.start - offsets[0]

    def uint(self, at, size: int, rows=None) -> np.ndarray:
        start, length = (self.start, self.size) if rows is None else (self.start[rows], self.size[rows])
        there = (length >= at + size) & (np.asarray(at) >= 0)
        place = np.where(there, start + at, 0)
        value = self.data[place].astype(np.int64)
        for i in range(1, size):
            value = value << 8 | self.data[place + i]
        return np.where(there, value, 0)


def listed(n: int, rows: list[np.ndarray], fields: dict[str, list[np.ndarray]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """A list for each of n rows: what each step has found for some rows, in the order of steps."""
    at = np.concatenate([np.empty(0, np.int64), *rows])
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=n) if len(at) else np.zeros(n, np.int64)
    columns = [pa.array(np.concatenate([np.empty(0, np.int64), *fields[k]])[order]).cast(t) for k, t in kinds.items()]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(columns, list(kinds)))


NUMBERS = pa.array([str(i) for i in range(256)])
DOT = pa.scalar(".")


def dotted(words: np.ndarray) -> pa.Array:
    parts = [NUMBERS.take(pa.array((words >> s & 255).astype(np.int16))) for s in (24, 16, 8, 0)]
    return pc.binary_join_element_wise(*parts, DOT)


def colons(address: bytes) -> str:
    """RFC 5952 form; an IPv4 address that is mapped ends in dotted form."""
    mapped = address[:12] == bytes(10) + b"\xff\xff"
    return "::ffff:" + ".".join(map(str, address[12:])) if mapped else ipaddress.IPv6Address(address).compressed


def texts(b: Bytes, at: np.ndarray, four: np.ndarray, six: np.ndarray, places: tuple[int, int]) -> pa.Array:
    """Addresses of the rows with IPv4 and IPv6 headers; places: of the address in either header."""
    n, index = len(at), np.zeros(len(at), np.int64)
    v4, v6 = np.flatnonzero(four), np.flatnonzero(six)
    index[v4] = np.arange(len(v4))
    values = dotted(b.uint(at[v4] + places[0], 4, v4))
    if len(v6):
        raw = b.data[(b.start[v6] + at[v6] + places[1])[:, None] + np.arange(16)]
        unique, which = np.unique(raw, axis=0, return_inverse=True)
        index[v6] = len(v4) + which.reshape(-1)
        values = pa.concat_arrays([values, pa.array([colons(bytes(a)) for a in unique], pa.string())])
    return values.take(pa.array(index, mask=~(four | six))) if n else pa.array([], pa.string())


def masked(values: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, mask=~there).cast(kind)


def read(column: pa.Array) -> pa.Array:
    """Fields of every frame of a batch. Walks over tags, extension headers and options go on as long as any row has more."""
    b, n = Bytes(column), len(column)
    at, kind = np.full(n, 14), b.uint(12, 2)
    vlans: dict[str, list] = {k: [] for k in ("vid", "pcp", "dei")}
    labels: dict[str, list] = {k: [] for k in ("label", "tc", "bottom", "ttl")}
    vlan_rows, label_rows = [], []
    rows = np.flatnonzero(np.isin(kind, VLAN + MPLS) & (b.size >= at + 4))
    while len(rows):
        here, is_label = at[rows], np.isin(kind[rows], MPLS)
        word = b.uint(here, 4, rows)
        tag, label = rows[~is_label], rows[is_label]
        tci, w = word[~is_label] >> 16, word[is_label]
        vlan_rows.append(tag)
        label_rows.append(label)
        for name, value in (("vid", tci & 0xFFF), ("pcp", tci >> 13), ("dei", tci >> 12 & 1)):
            vlans[name].append(value)
        for name, value in (("label", w >> 12), ("tc", w >> 9 & 7), ("bottom", w >> 8 & 1), ("ttl", w & 255)):
            labels[name].append(value)
        kind[tag] = word[~is_label] & 0xFFFF
        below = np.where(b.uint(here[is_label] + 4, 1, label) >> 4 == 6, IPV6, IPV4)
        kind[label] = np.where(w >> 8 & 1, below, kind[label])
        at[rows] += 4
        rows = rows[np.isin(kind[rows], VLAN + MPLS) & (b.size[rows] >= at[rows] + 4)]

    four, six = (kind == IPV4) & (b.size >= at + 20), (kind == IPV6) & (b.size >= at + 40)
    ip = four | six
    word = b.uint(at, 4)
    service = np.where(four, word >> 16 & 255, word >> 20 & 255)
    flags = b.uint(at + 6, 2)
    proto = np.where(four, b.uint(at + 9, 1), b.uint(at + 6, 1))
    fragment, more = np.where(four, (flags & 0x1FFF) * 8, 0), np.where(four, flags >> 13 & 1, 0)
    ident, has_ident = np.where(four, b.uint(at + 4, 2), 0), four.copy()
    total = word & 0xFFFF
    end = np.where(four, np.where(total > 0, at + total, b.size), at + 40 + b.uint(at + 4, 2))
    end = np.minimum(end, b.size)
    l4 = np.where(four, at + (word >> 24 & 15) * 4, at + 40)
    chained = LONG_HEADERS + (FRAGMENT, AUTHENTICATION)
    rows = np.flatnonzero(six & np.isin(proto, chained) & (b.size >= l4 + 8))
    while len(rows):
        here, this = l4[rows], proto[rows]
        size = b.uint(here + 1, 1, rows)
        part = this == FRAGMENT
        word2 = b.uint(here + 2, 2, rows)
        fragment[rows] = np.where(part, (word2 >> 3) * 8, fragment[rows])
        more[rows] = np.where(part, word2 & 1, more[rows])
        ident[rows] = np.where(part, b.uint(here + 4, 4, rows), ident[rows])
        has_ident[rows] |= part
        proto[rows] = b.uint(here, 1, rows)
        l4[rows] += np.where(part, 8, np.where(this == AUTHENTICATION, (size + 2) * 4, (size + 1) * 8))
        rows = rows[np.isin(proto[rows], chained) & (fragment[rows] == 0) & (b.size[rows] >= l4[rows] + 8)]

    first = ip & (fragment == 0)
    tcp, udp, icmp = first & (proto == TCP), first & (proto == UDP), first & np.isin(proto, (ICMP, ICMPV6))
    head = np.where(tcp, (b.uint(l4 + 12, 1) >> 4) * 4, np.where(udp | icmp, 8, 0))
    ported, whole = (tcp | udp) & (b.size >= l4 + 4), tcp & (b.size >= l4 + 20)

    found: dict[str, list] = {k: [] for k in ("kind", "at", "size")}
    found_rows, place, stop = [], l4 + 20, np.minimum(l4 + head, b.size)
    rows = np.flatnonzero(whole & (place < stop))
    while len(rows):
        here = place[rows]
        option = b.uint(here, 1, rows)
        one = option == 1
        size = np.where(one, 0, np.where(b.size[rows] >= here + 2, b.uint(here + 1, 1, rows) - 2, -1))
        after = here + np.where(one, 1, 2) + size
        good = (option != 0) & (size >= 0) & (after <= stop[rows])
        found_rows.append(rows[good])
        for name, value in (("kind", option), ("at", after - size), ("size", size)):
            found[name].append(value[good])
        place[rows] = after
        rows = rows[good & (after < stop[rows])]

    i64, i32, flag = pa.int64(), pa.int32(), pa.bool_()
    columns = {
        "type": masked(kind, b.size >= 14, i32), "at": pa.array(at, i32),
        "vlans": listed(n, vlan_rows, vlans, {"vid": i64, "pcp": i64, "dei": flag}), "mpls": listed(n, label_rows, labels, {"label": i64, "tc": i64, "bottom": flag, "ttl": i64}),
        "version": masked(np.where(four, 4, 6), ip, i32), "src": texts(b, at, four, six, (12, 8)), "dst": texts(b, at, four, six, (16, 24)),
        "proto": masked(proto, ip, i64), "ttl": masked(np.where(four, b.uint(at + 8, 1), b.uint(at + 7, 1)), ip, i64), "dscp": masked(service >> 2, ip, i64), "ecn": masked(service & 3, ip, i64),
        "id": masked(ident, has_ident, i64), "df": masked(flags >> 14 & 1, four, flag), "mf": masked(more, ip, flag), "fragment": masked(fragment, ip, i64), "label": masked(word & 0xFFFFF, six, i64),
        "l4": masked(l4, ip, i32), "end": masked(end, ip, i32), "head": masked(head, ip, i32), "src_port": masked(b.uint(l4, 2), ported, i32), "dst_port": masked(b.uint(l4 + 2, 2), ported, i32),
        "seq": masked(b.uint(l4 + 4, 4), whole, i64), "ack": masked(b.uint(l4 + 8, 4), whole, i64), "flags": masked(b.uint(l4 + 13, 1), whole, i32), "window": masked(b.uint(l4 + 14, 2), whole, i32),
        "options": listed(n, found_rows, found, {"kind": i64, "at": i32, "size": i32}),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def header_fields(frame: Column) -> Column:
    """struct of SCHEMA: the numbers and addresses of a frame's headers, and where its parts are."""
    return F.arrow_udf(read, SCHEMA)(frame)
