"""spark.read.format("pcap"): frames of capture files, classic and block-structured, read in byte ranges.

A record belongs to the range in which its header begins. A range finds its first record by itself: it starts well before its
begin at a place where likely headers follow each other for longer than any record is, and walks on from there. Headers inside of a
packet (a capture that was itself captured) end with that packet, and then meet the true ones or bytes that are unlikely to go on as
headers, so what the walk reaches at the range's begin is a true header. A record's number is its place after the file header: unique and in order without counting.
"""

from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Magic numbers of classic files as read in little-endian order -> (byte order, ticks of a second).
MAGIC = {0xA1B2C3D4: ("<", 1_000_000), 0xD4C3B2A1: (">", 1_000_000), 0xA1B23C4D: ("<", 1_000_000_000), 0x4D3CB2A1: (">", 1_000_000_000)}
#: Kinds of blocks, the mark of a section's byte order, options, and the largest packet that capture tools write.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET, ORDER_MARK = 0x0A0D0D0A, 1, 2, 3, 6, 0x1A2B3C4D
RESOLUTION, OFFSET, PACKET_FLAGS, LARGEST = 9, 14, 2, 262_144
DIRECTIONS = {1: "inbound", 2: "outbound"}
SCHEMA = "path string, seq long, us long, nanos int, wire_len long, link_type int, interface int, direction string, frame binary"
#: Bytes of a range, and of the largest record with its head and options.
SPLIT, RECORD = 128 << 20, LARGEST + 4096
#: Headers in a row that a range takes for true ones, and how many of the largest records they must reach over.
CHAIN, COVERED = 16, 4


def is_blocks(head: bytes) -> bool:
    return head[:4] == b"\x0a\x0d\x0d\x0a"


class Window:
    """Bytes of a file from a place on, read ahead in parts."""

    PART = 4 << 20

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """`n` bytes, fewer at the end of the file."""
        if at < self.base or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, self.PART))
        return self.data[at - self.base : at - self.base + n]


class Classic:
    """Records behind a file header of 24 bytes."""

    FIRST, STEP = 24, 1

    def __init__(self, head: bytes):
        magic = struct.unpack("<I", head[:4])[0] if len(head) >= 24 else None
        if magic not in MAGIC:
            raise ValueError("not a capture file")
        self.order, self.ticks = MAGIC[magic]
        self.link = struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF

    def length(self, w: Window, at: int, most: int, strict: bool = False) -> int | None:
        """Bytes of the record that may begin at a place; null if none can. strict: nor one that captures hardly ever hold."""
        head = w.bytes(at, 16)
        if len(head) < 16:
            return None
        _, part, held, wire = struct.unpack(self.order + "4I", head)
        likely = wire >= max(held, 1) or not strict
        return 16 + held if held + 16 <= most and part < self.ticks and likely else None

    def record(self, w: Window, at: int) -> tuple[int, tuple | None] | None:
        """(place after it, row without path) of the record at a place; null at the end or for one that is cut off."""
        head = w.bytes(at, 16)
        if len(head) < 16:
            return None
        seconds, part, held, wire = struct.unpack(self.order + "4I", head)
        frame = w.bytes(at + 16, held) if at + 16 + held <= w.size else b""
        if len(frame) < held:
            return None
        nanos = part * (1_000_000_000 // self.ticks)
        return at + 16 + held, (at - self.FIRST, seconds * 1_000_000 + nanos // 1000, nanos, wire, self.link, 0, None, frame)


def options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0 or at + 4 + size > len(body):
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


class Blocks:
    """Blocks, whose sections have a byte order and interfaces of their own.

    known: (place, kind, order or interface) of the blocks before a range that say so, as `sections` finds them.
    """

    FIRST, STEP = 0, 4

    def __init__(self, known: list[list] = (), order: str = "<"):
        self.order, self.interfaces = order, []
        for _, kind, told in known:
            if kind == SECTION:
                self.order, self.interfaces = told, []
            else:
                self.interfaces.append(tuple(told))

    def sizes(self, w: Window, at: int) -> tuple[str, int, int] | None:
        """(order, kind, bytes) of the block at a place."""
        head = w.bytes(at, 12)
        if len(head) < 12:
            return None
        order = self.order
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if head[8:12] == struct.pack("<I", ORDER_MARK) else ">" if head[8:12] == struct.pack(">I", ORDER_MARK) else ""
        if not order:
            return None
        kind, size = struct.unpack(order + "II", head[:8])
        return (order, kind, size) if size >= 12 and size % 4 == 0 and at + size <= w.size else None

    def length(self, w: Window, at: int, most: int, strict: bool = False) -> int | None:
        for order in (self.order, ">" if self.order == "<" else "<"):  # a range may begin in a section of either order
            head = w.bytes(at, 8)
            if len(head) < 8:
                return None
            size = struct.unpack(order + "I", head[4:8])[0]
            if 12 <= size <= most and size % 4 == 0 and at + size <= w.size and w.bytes(at + size - 4, 4) == head[4:8]:
                return size
        return None

    def record(self, w: Window, at: int) -> tuple[int, tuple | None] | None:
        found = self.sizes(w, at)
        if found is None:
            return None
        order, kind, size = found
        if kind == SECTION:
            self.order, self.interfaces = order, []
        elif kind == INTERFACE:
            self.interfaces.append(interface(w.bytes(at + 8, size - 12), order))
        elif kind in (PACKET, OLD_PACKET, SIMPLE_PACKET):
            return at + size, self.packet(kind, w.bytes(at + 8, size - 12), at)
        return at + size, None

    def packet(self, kind: int, body: bytes, at: int) -> tuple | None:
        if len(body) < (4 if kind == SIMPLE_PACKET else 20):
            return None
        number, ticks, direction = 0, None, None
        if kind == SIMPLE_PACKET:
            (wire,), start = struct.unpack_from(self.order + "I", body), 4
            held = min(wire, len(body) - 4)
        else:
            number, high, low, held, wire = struct.unpack_from(self.order + ("5I" if kind == PACKET else "H2x4I"), body)
            ticks, start = high << 32 | low, 20
        if number >= len(self.interfaces) or start + held > len(body):
            return None
        link, snap, unit, offset = self.interfaces[number]
        held = min(held, snap) if kind == SIMPLE_PACKET and snap else held
        for code, value in options(body[start + (held + 3) // 4 * 4 :], self.order) if kind == PACKET else ():
            if code == PACKET_FLAGS and len(value) == 4:
                direction = DIRECTIONS.get(struct.unpack(self.order + "I", value)[0] & 3)
        if ticks is None:
            return at, None, None, wire, link, number, direction, body[start : start + held]
        nanos = (ticks * 1_000_000_000 >> (unit & 127)) if unit & 128 else ticks * 10 ** (9 - unit) if unit <= 9 else ticks // 10 ** (unit - 9)
        nanos += offset * 1_000_000_000
        return at, nanos // 1000, nanos % 1_000_000_000, wire, link, number, direction, body[start : start + held]


def interface(body: bytes, order: str) -> tuple[int, int, int, int]:
    """(link type, longest packet, resolution, seconds to add)."""
    link, snap = struct.unpack_from(order + "HxxI", body) if len(body) >= 8 else (-1, 0)
    told = dict(options(body[8:], order))
    unit = told[RESOLUTION][0] if told.get(RESOLUTION) else 6
    return link, snap, unit, struct.unpack(order + "q", told[OFFSET])[0] if len(told.get(OFFSET, b"")) == 8 else 0


def border(form: Classic | Blocks, w: Window, start: int, most: int) -> int:
    """The first true record at `start` or later."""
    at = form.FIRST
    if start > form.FIRST + (COVERED + 1) * most:
        tried = start - (COVERED + 1) * most
        tried += -tried % form.STEP
        while tried < start and not follows(form, w, tried, most):
            tried += form.STEP
        at = tried if tried < start else at  # from the first record on, where nothing can be told
    while at < start:
        size = form.length(w, at, max(most, w.size))
        if size is None:
            return w.size
        at += size
    return at


def follows(form: Classic | Blocks, w: Window, at: int, most: int) -> bool:
    """Whether likely headers follow each other from a place on, CHAIN at least and over COVERED records, or to the end."""
    upto, n = at + COVERED * most, 0
    while at <= upto or n < CHAIN:
        size = form.length(w, at, most, strict=True)
        if size is None:
            return at >= w.size or (n >= CHAIN and w.size - at < most)  # the last record may be cut off
        at += size
        n += 1
    return True


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    """what: rows of packets, or (sections) the blocks that later ranges need to know."""

    def __init__(self, paths: list[str], split: int, most: int, known: dict[str, list], sections: bool):
        self.paths, self.split, self.most, self.known, self.sections = paths, split, most, known, sections

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                whole = is_blocks(f.read(4)) and path not in self.known and not self.sections
            step = max(size, 1) if whole else self.split
            out += [Range(path, a, min(a + step, size)) for a in range(0, max(size, 1), step)]
        return out

    def read(self, partition: Range):
        with open(partition.path, "rb") as f:
            w = Window(f, os.path.getsize(partition.path))
            head = w.bytes(0, 24)
            if not head:
                return
            if is_blocks(head):
                known = self.known.get(partition.path, [])
                form = Blocks([k for k in known if k[0] < partition.start], "<" if head[8:12] == struct.pack("<I", ORDER_MARK) else ">")
            else:
                form = Classic(head)
            if self.sections:
                yield from found_sections(form, w, partition, self.most)
                return
            at = border(form, w, partition.start, self.most)
            while at < partition.end:
                got = form.record(w, at)
                if got is None:
                    return
                at, row = got
                if row is not None:
                    yield (partition.path, *row)


def found_sections(form: Classic | Blocks, w: Window, partition: Range, most: int):
    """(path, place, kind, bytes) of the blocks of a range that say how later ones are read."""
    at = border(form, w, partition.start, most) if isinstance(form, Blocks) else partition.end
    while at < partition.end:
        size = form.length(w, at, w.size)
        if size is None:
            return
        body = w.bytes(at, size)
        if is_blocks(body) or body[:4] in (struct.pack("<I", INTERFACE), struct.pack(">I", INTERFACE)):  # the section tells which order holds
            yield partition.path, at, body
        at += size


class Pcap(DataSource):
    """Files that every machine sees at `path` (one path, or several joined by commas).

    Options: split, bytes of a range; most, bytes of the largest record; known, what `sections` finds, as JSON. Without it,
    block-structured files are one range each.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "path string, at long, body binary" if self.options.get("sections") == "true" else SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        return Reader([p for p in o["path"].split(",") if p], int(o.get("split", SPLIT)), int(o.get("most", RECORD)), json.loads(o.get("known", "{}")), o.get("sections") == "true")


def known_sections(rows) -> dict[str, list]:
    """What ranges need to know, out of the section and interface blocks of all files."""
    out: dict[str, list] = {}
    order = "<"
    for path, at, body in sorted((r.path, r.at, bytes(r.body)) for r in rows):
        told = out.setdefault(path, [])
        if body[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if body[8:12] == struct.pack("<I", ORDER_MARK) else ">"
            told.append([at, SECTION, order])
        elif struct.unpack(order + "I", body[:4])[0] == INTERFACE:
            told.append([at, INTERFACE, list(interface(body[8:-4], order))])
    return out


def read_captures(spark: SparkSession, paths: list[str], split: int = SPLIT, most: int = RECORD) -> DataFrame:
    """Frames of capture files as SCHEMA, each file in ranges of `split` bytes.

    Block-structured files are read twice: first, in ranges too, for their sections and interfaces, a few rows that every range then
    knows. us and nanos are null for packets without a time.
    """
    spark.dataSource.register(Pcap)
    read = spark.read.format("pcap").option("split", split).option("most", most)
    known = known_sections(read.option("sections", "true").load(",".join(paths)).collect())
    return spark.read.format("pcap").option("split", split).option("most", most).option("known", json.dumps(known)).load(",".join(paths))


def captures(files: DataFrame) -> DataFrame:
    """Frames of capture files read by spark.read.format("binaryFile"): works on any store that Spark reads, a file a task."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    form = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(path, *r) for r in records(content, io.BytesIO(content))]
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(form)], schema=form)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def records(content: bytes, file: BinaryIO) -> Iterator[tuple]:
    """Rows without path of a whole file, one after the other."""
    if not content:
        return
    w = Window(file, len(content))
    form = Blocks() if is_blocks(content) else Classic(content[:24])
    at = form.FIRST
    while (got := form.record(w, at)) is not None:
        at, row = got
        if row is not None:
            yield row
