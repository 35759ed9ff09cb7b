"""HTTP/2 connections: header blocks decompressed in wire order, streams told apart, and gRPC calls on top.

A connection's chunks are folded in order, as its header tables depend on every block before; what comes out are rows, and
exchanges and calls are grouped out of those rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.wire import named
from tidelane.operators.folds import ordered_fold
from tidelane.parsers.web import GRPC_STATUS, PREFACE, grpc_method, is_grpc

#: The static table of header compression, a name and its value a line, in order.
STATIC = """:authority
:method GET
:method POST
:path /
:path /index.html
:scheme http
:scheme https
:status 200
:status 204
:status 206
:status 304
:status 400
:status 404
:status 500
accept-charset
accept-encoding gzip, deflate
accept-language
accept-ranges
accept
access-control-allow-origin
age
allow
authorization
cache-control
content-disposition
content-encoding
content-language
content-length
content-location
content-range
content-type
cookie
date
etag
expect
expires
from
host
if-match
if-modified-since
if-none-match
if-range
if-unmodified-since
last-modified
link
location
max-forwards
proxy-authenticate
proxy-authorization
range
referer
refresh
retry-after
server
set-cookie
strict-transport-security
transfer-encoding
user-agent
vary
via
www-authenticate"""

#: The bytes that have a code of so many bits; 256 is the end of a string.
CODE_BITS = {
    5: b"012aceiost", 6: b" %-./3456789=A_bdfghlmnpru", 7: b":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: b"&*,;XZ", 10: b'!"()?', 11: b"'+|", 12: b"#>", 13: b"\0$@[]~", 14: b"^}", 15: b"<`{",
    19: [92, 195, 208], 20: [128, 130, 131, 162, 184, 194, 224, 226], 21: [153, 161, 167, 172, 176, 177, 179, 209, 216, 217, 227, 229, 230],
    22: [129, 132, 133, 134, 136, 146, 154, 156, 160, 163, 164, 169, 170, 173, 178, 181, 185, 186, 187, 189, 190, 196, 198, 228, 232, 233],
    23: [1, 135, 137, 138, 139, 140, 141, 143, 147, 149, 150, 151, 152, 155, 157, 158, 165, 166, 168, 174, 175, 180, 182, 183, 188, 191, 197, 231, 239],
    24: [9, 142, 144, 145, 148, 159, 171, 206, 215, 225, 236, 237], 25: [199, 207, 234, 235], 26: [192, 193, 200, 201, 202, 205, 210, 213, 218, 219, 238, 240, 242, 243, 255],
    27: [203, 204, 211, 212, 214, 221, 222, 223, 241, 244, 245, 246, 247, 248, 250, 251, 252, 253, 254], 28: [*range(2, 9), 11, 12, *range(14, 22), *range(23, 32), 127, 220, 249], 30: [10, 13, 22, 256],
}

#: Limits of a connection: bytes of a frame, of a header block and of a header table, fields of a block, open streams.
FRAME, BLOCK, TABLE, FIELDS, STREAMS = 1 << 20, 1 << 16, 1 << 16, 256, 256
#: Size of a header table before settings change it, and what an entry counts besides its bytes.
TABLE_AT_FIRST, ENTRY = 4096, 32

CODE = 30


class Fault(Exception):
    """Why a connection can't be read any further."""


def codes() -> tuple[list[int], list[int], list[int]]:
    """(codes as the upper ones of 30 bits, their bits, symbols): codes of one length follow each other, longer ones come after."""
    starts, sizes, symbols, code = [], [], [], 0
    for bits, group in CODE_BITS.items():
        for symbol in group:
            starts.append(code)
            sizes.append(bits)
            symbols.append(symbol)
            code += 1 << (CODE - bits)
    return starts, sizes, symbols


STARTS, SIZES, SYMBOLS = codes()


def huffman(data: bytes) -> bytes:
    """Decoded bytes. What is left at the end must be fewer than 8 bits, all of them ones."""
    out, held, n = bytearray(), 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        while n >= 5:
            window = held >> (n - CODE) if n >= CODE else held << (CODE - n) | (1 << (CODE - n)) - 1
            i = bisect_right(STARTS, window) - 1
            if SIZES[i] > n:
                break
            if SYMBOLS[i] == 256:
                raise Fault("huffman")
            out.append(SYMBOLS[i])
            n -= SIZES[i]
            held &= (1 << n) - 1
    if n > 7 or held != (1 << n) - 1:
        raise Fault("huffman")
    return bytes(out)


def whole_number(data: bytes, at: int, bits: int) -> tuple[int, int]:
    """(number, place after it): `bits` of the first byte, and seven of each further one where those are all ones."""
    if at >= len(data):
        raise Fault("truncated_block")
    most = (1 << bits) - 1
    value, at, shift = data[at] & most, at + 1, 0
    if value < most:
        return value, at
    while True:
        if at >= len(data):
            raise Fault("truncated_block")
        if shift > 56:
            raise Fault("number_too_large")
        value += (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def string(data: bytes, at: int) -> tuple[bytes, int]:
    if at >= len(data):
        raise Fault("truncated_block")
    packed = data[at] & 128
    size, at = whole_number(data, at, 7)
    if at + size > len(data):
        raise Fault("truncated_block")
    part = bytes(data[at : at + size])
    return huffman(part) if packed else part, at + size


class HeaderTable:
    """What one side's header blocks refer to: the static table, and the fields that it has added, the newest first."""

    FIXED = [tuple(line.encode().partition(b" ")[::2]) for line in STATIC.split("\n")]

    def __init__(self):
        self.added, self.size, self.limit = deque(), 0, TABLE_AT_FIRST

    def limited(self, limit: int) -> None:
        self.limit = limit
        self.shrink()

    def shrink(self) -> None:
        while self.size > self.limit:
            name, value = self.added.pop()
            self.size -= len(name) + len(value) + ENTRY

    def add(self, name: bytes, value: bytes) -> None:
        """A field larger than the table empties it."""
        self.added.appendleft((name, value))
        self.size += len(name) + len(value) + ENTRY
        self.shrink()

    def field(self, number: int) -> tuple[bytes, bytes]:
        beyond = number - len(self.FIXED) - 1
        if number < 1 or beyond >= len(self.added):
            raise Fault("unknown_field")
        return self.added[beyond] if beyond >= 0 else self.FIXED[number - 1]

    def decode(self, block: bytes, most_table: int = TABLE) -> list[tuple[bytes, bytes]]:
        """Fields of a block, in order."""
        out, at = [], 0
        while at < len(block):
            if len(out) >= FIELDS:
                raise Fault("too_many_fields")
            first = block[at]
            if first >= 128:  # a field of the table
                number, at = whole_number(block, at, 7)
                out.append(self.field(number))
            elif 32 <= first < 64:  # a size for the table
                limit, at = whole_number(block, at, 5)
                if limit > most_table:
                    raise Fault("table_too_large")
                self.limited(limit)
            else:  # a value of its own, which is added to the table or isn't
                number, at = whole_number(block, at, 6 if first >= 64 else 4)
                if number:
                    name = self.field(number)[0]
                else:
                    name, at = string(block, at)
                value, at = string(block, at)
                if first >= 64:
                    self.add(name, value)
                out.append((name, value))
        return out


class Side:
    """Unread bytes of one side, its header table, and the header block that isn't complete."""

    def __init__(self, preface: bool):
        self.held, self.table, self.open, self.frame, self.preface = bytearray(), HeaderTable(), None, FRAME, preface


#: Kinds of frames, flags, and numbers of settings.
DATA, HEADERS, RESET, SETTINGS, PROMISE, GOAWAY, CONTINUATION = 0, 1, 3, 4, 5, 7, 9
END_STREAM, ACK, END_HEADERS, PADDED, PRIORITY = 1, 1, 4, 8, 32
TABLE_SIZE, FRAME_SIZE = 1, 5


class Connection:
    """Both sides of one connection; `read` takes bytes of a side and gives what happened as (event, stream, fields, data, end, code)."""

    def __init__(self, strict: bool):
        self.sides = {"initiator": Side(True), "responder": Side(False)}
        self.heads: dict[int, set[str]] = {}
        self.strict, self.failed = strict, False

    def read(self, name: str, data: bytes, gap: int):
        if self.failed or not data and not gap:
            return
        try:
            if gap:  # the table can't be known behind lost bytes
                raise Fault("gap")
            side = self.sides[name]
            side.held += data
            at = self.opening(side)
            while at is not None and at + 9 <= len(side.held):
                size = int.from_bytes(side.held[at : at + 3])
                if size > side.frame:
                    raise Fault("frame_too_large")
                if at + 9 + size > len(side.held):
                    break
                kind, flags, stream = side.held[at + 3], side.held[at + 4], int.from_bytes(side.held[at + 5 : at + 9]) & 0x7FFFFFFF
                yield from self.frame(name, side, kind, flags, stream, bytes(side.held[at + 9 : at + 9 + size]))
                at += 9 + size
            del side.held[: at or 0]
        except Fault as why:
            self.failed = True
            for side in self.sides.values():
                side.held.clear()
            self.heads.clear()
            yield "error", 0, None, None, False, None, str(why)

    def opening(self, side: Side) -> int | None:
        """Where frames begin; None while the preface may still be coming."""
        if not side.preface:
            return 0
        part = side.held[: len(PREFACE)]
        if PREFACE.startswith(part) and len(part) < len(PREFACE):
            return None
        side.preface = False
        if part == PREFACE:
            return len(PREFACE)
        if self.strict:
            raise Fault("no_preface")
        return 0

    def frame(self, name: str, side: Side, kind: int, flags: int, stream: int, body: bytes):
        if side.open and (kind != CONTINUATION or stream != side.open[0]):
            raise Fault("interleaved_block")
        if kind in (DATA, HEADERS, PROMISE) and flags & PADDED:
            if not body or body[0] + 1 > len(body):
                raise Fault("malformed_frame")
            body = body[1 : len(body) - body[0]]
        if kind == DATA:
            if body:
                yield "body", stream, None, body, bool(flags & END_STREAM), None, None
            if flags & END_STREAM:
                yield self.ended(name, stream)
        elif kind in (HEADERS, PROMISE):
            skip = 4 if kind == PROMISE else 5 if flags & PRIORITY else 0
            if len(body) < skip:
                raise Fault("malformed_frame")
            about = int.from_bytes(body[:4]) & 0x7FFFFFFF if kind == PROMISE else stream
            side.open = [stream, about, bytearray(), kind == HEADERS and bool(flags & END_STREAM)]
            yield from self.block(name, side, flags, body[skip:])
        elif kind == CONTINUATION:
            if not side.open:
                raise Fault("lone_continuation")
            yield from self.block(name, side, flags, body)
        elif kind == SETTINGS and not flags & ACK:
            if len(body) % 6:
                raise Fault("malformed_frame")
            told = {int.from_bytes(body[i : i + 2]): int.from_bytes(body[i + 2 : i + 6]) for i in range(0, len(body), 6)}
            other = self.sides["responder" if name == "initiator" else "initiator"]  # they bind what the other side sends
            if TABLE_SIZE in told:
                other.table.limited(min(told[TABLE_SIZE], TABLE))
            if FRAME_SIZE in told:
                other.frame = min(told[FRAME_SIZE], FRAME)
            shown = [(n, str(told[i]).encode()) for i, n in ((TABLE_SIZE, b"header_table_size"), (FRAME_SIZE, b"max_frame_size")) if i in told]
            if shown:
                yield "settings", 0, shown, None, False, None, None
        elif kind in (RESET, GOAWAY):
            if len(body) < (4 if kind == RESET else 8):
                raise Fault("malformed_frame")
            if kind == RESET:
                self.heads.pop(stream, None)
                yield "reset", stream, None, None, False, int.from_bytes(body[:4]), None
            else:
                yield "goaway", int.from_bytes(body[:4]) & 0x7FFFFFFF, None, None, False, int.from_bytes(body[4:8]), None

    def block(self, name: str, side: Side, flags: int, part: bytes):
        side.open[2] += part
        if len(side.open[2]) > BLOCK:
            raise Fault("block_too_large")
        if not flags & END_HEADERS:
            return
        (_, stream, block, end), side.open = side.open, None
        fields = side.table.decode(bytes(block))
        if stream not in self.heads and len(self.heads) >= STREAMS:
            raise Fault("too_many_streams")
        seen = self.heads.setdefault(stream, set())
        yield "trailers" if name in seen else "head", stream, fields, None, end, None, None
        seen.add(name)
        if end:
            yield self.ended(name, stream)

    def ended(self, name: str, stream: int):
        if name == "responder":
            self.heads.pop(stream, None)
        return "end", stream, None, None, True, None, None


FIELD = "array<struct<name:string,value:string>>"


def h2_events(chunks: DataFrame, keys: list[str], strict: bool = True, parts: int | None = None) -> DataFrame:
    """keys, us, seq, n, side, event, stream, fields, data, end_stream, code, error: what happens on each connection, in order.

    chunks: keys of a connection, us, seq, side (initiator or responder), payload, and, if there is one, gap: bytes lost
    before a chunk. event: head, body, trailers, end, reset, goaway (stream: the last one that counts), settings, error. `n` numbers
    a chunk's events. A body's bytes come as they arrive. An error ends a connection: a gap, broken framing or compression, or a limit
    (FRAME, BLOCK, TABLE, FIELDS, STREAMS) that is passed. strict: the client must open with the preface. Unfinished frames
    at the end give nothing. A connection is read by one task, with at most a frame and a block of either side in memory.
    parts: partitions that connections are dealt to (None: the session's number).
    """
    rows = chunks if "gap" in chunks.columns else chunks.withColumn("gap", F.lit(0).cast("long"))

    def step(state, us, seq, side, payload, gap):
        out = []
        for i, (event, stream, fields, data, end, code, error) in enumerate(state[0].read(side, payload or b"", gap or 0)):
            told = None if fields is None else [{"name": n.decode("latin-1"), "value": v.decode("latin-1")} for n, v in fields]
            out.append((us, seq, i, side, event, stream, told, data, end, code, error))
        return out

    schema = f"us long, seq long, n int, side string, event string, stream long, fields {FIELD}, data binary, end_stream boolean, code long, error string"
    return ordered_fold(rows, keys, ["side", "payload", "gap"], lambda: [Connection(strict)], step, schema, parts=parts)


def value(fields: Column, name: str) -> Column:
    """Value of the first field of a (lower-case) name."""
    return F.get(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"]), F.lit(0))


def h2_exchanges(events: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """One row for each stream with a request or a response: what was asked, what came back, bytes of both bodies, how it ended.

    outcome: completed (the server ended the stream), reset, or open. Events are dealt by their stream before they are sorted
    for grouping, to `parts` partitions (None: the session's number), and bodies go along as sizes.
    """
    of = lambda side, event: (F.col("side") == side) & (F.col("event") == event)
    at = F.struct("us", "seq", "n")
    first = lambda side, event: F.min_by(F.when(of(side, event), F.col("fields")), F.when(of(side, event), at))
    size = lambda side: F.coalesce(F.sum(F.when(of(side, "body"), F.col("size"))), F.lit(0))
    told = events.filter(F.col("event").isin("head", "body", "trailers", "end", "reset")).select(*keys, "stream", "us", "seq", "n", "side", "event", "fields", F.length("data").alias("size"), "code")
    each = told.repartition(*([parts] if parts else []), *keys, "stream").groupBy(*keys, "stream").agg(
        first("initiator", "head").alias("request"), first("responder", "head").alias("response"), first("responder", "trailers").alias("trailers"),
        F.min(F.when(of("initiator", "head"), F.col("us"))).alias("us"), F.max(F.when(F.col("side") == "responder", F.col("us"))).alias("last_us"),
        size("initiator").alias("request_bytes"), size("responder").alias("response_bytes"),
        F.bool_or(of("responder", "end")).alias("__ended"), F.max(F.when(F.col("event") == "reset", F.col("code"))).alias("reset_code"),
    )
    asked = {name: value(F.col("request"), f":{name}").alias(name) for name in ("method", "scheme", "authority", "path")}
    outcome = F.when(F.col("reset_code").isNotNull(), "reset").when(F.col("__ended"), "completed").otherwise("open")
    return each.filter("request is not null or response is not null").select(*keys, "stream", "us", "last_us", *asked.values(), value(F.col("response"), ":status").try_cast("int").alias("status"), "request", "response", "trailers", "request_bytes", "response_bytes", "reset_code", outcome.alias("outcome"))


def grpc_calls(exchanges: DataFrame) -> DataFrame:
    """`exchanges` of gRPC with service, method, and the status of the trailers, or of the only block that came back."""
    told = lambda name: F.coalesce(value(F.col("trailers"), name), value(F.col("response"), name))
    code = F.trim(told("grpc-status")).try_cast("int")
    call = grpc_method(F.col("path"))
    calls = exchanges.filter(is_grpc(value(F.col("request"), "content-type")))
    return calls.withColumn("service", call["service"]).withColumn("grpc_method", call["method"]).withColumn("grpc_status", code).withColumn("grpc_status_name", named(code, GRPC_STATUS)).withColumn("grpc_message", told("grpc-message"))
