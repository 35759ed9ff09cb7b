"""HTTP/1, TLS hellos and their fingerprints, QUIC headers, HTTP/2 frames, gRPC, SSH."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.scalars import grease
from tidelane.functions.wire import bits, cut, named, records, text, uint
from tidelane.operators.folds import ordered_fold

METHODS = "GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH"
#: Bytes of one message's head, and of one message that isn't whole; a side with more is given up.
HEAD, WAITING = 1 << 16, 1 << 24


def locate(what: str, where: Column, start: Column) -> Column:
    """Place (from 0) of `what` at `start` or later, -1 without one."""
    return F.call_function("locate", F.lit(what), where, (start + 1).cast("int")) - 1


def header(headers: Column, name: str) -> Column:
    """Value of the first header of a name, whatever its case."""
    return F.get(headers_all(headers, name), F.lit(0))


def headers_all(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"])


HTTP = "struct<is_request:boolean,method:string,path:string,version:string,status:int,headers:array<struct<name:string,value:string>>,body:string,poison:string>"
FIRST_LINE = re.compile(rb"((?:%s) [^\r\n]* HTTP/1\.[01]|HTTP/1\.[01] \d{3}[^\r\n]*)\r\n" % METHODS.encode())
CHUNK_SIZE = re.compile(rb"[0-9A-Fa-f]{1,7}")
FOLDED, BARE = re.compile(rb"\r\n[ \t]"), re.compile(rb"\r(?!\n)")


def head_of(head: bytes) -> tuple[dict, bool, int | None] | None:
    """(fields, whether the body is in chunks, its size or None if it goes on to the end) of a head; null for bytes that can't be one."""
    top = FIRST_LINE.match(head)
    if not top or len(head) > HEAD:
        return None
    first = top[1].decode("latin-1")
    headers = [(n, v.strip(" ")) for n, colon, v in (line.partition(":") for line in head[top.end() :].decode("latin-1").split("\r\n")) if colon]
    of: dict[str, list[str]] = {"content-length": [], "host": [], "transfer-encoding": []}
    for n, v in headers:
        if (lower := n.lower()) in of:
            of[lower].append(v)
    lengths, hosts = list(dict.fromkeys(of["content-length"])), {v.lower() for v in of["host"]}
    chunked = "chunked" in (of["transfer-encoding"] or [""])[0].lower()
    status = int(first[9:12]) if first.startswith("HTTP/") else None
    bodiless = status is not None and (status < 200 or status in (204, 304))
    poison = "both_framings" if chunked and lengths else "content_lengths_differ" if len(lengths) > 1 else "hosts_differ" if len(hosts) > 1 else "folded_line" if FOLDED.search(head) else "bare_carriage_return" if BARE.search(head) else None
    size = 0
    if not bodiless and lengths:
        if not re.fullmatch(r"\d{1,12}", lengths[0], re.ASCII):
            return None
        size = int(lengths[0])
    elif not bodiless and status is not None:
        size = None  # up to the end
    words = first.split(" ")
    told = {"is_request": status is None, "method": words[0] if status is None else None, "path": words[1] if status is None else None, "version": re.search(r"HTTP/(1\.[01])", first)[1], "status": status, "headers": [{"name": n, "value": v} for n, v in headers], "poison": poison}
    return told, chunked, size


#: Heads of at most SMALL bytes are remembered, as many messages of a capture have equal ones.
SMALL = 1 << 10
small_head_of = lru_cache(4096)(head_of)


class HttpSide:
    """Messages of one side's bytes as they become whole. What waits is scanned once: heads and chunks are remembered."""

    def __init__(self):
        self.held, self.at, self.seen, self.open, self.failed = bytearray(), 0, 0, None, False

    def read(self, data: bytes):
        if self.failed:
            return
        self.held += data
        while not self.failed:
            if self.open is None and not self.head():
                break
            one = self.body()
            if one is None:
                break
            yield one
        del self.held[: self.at]
        self.seen = max(0, self.seen - self.at)
        if self.open:
            self.open["from"] -= self.at
            self.open["next"] -= self.at
        self.at = 0
        if len(self.held) > WAITING:
            self.fail()

    def take(self, chunk: bytes | None, gap: int | None) -> list[dict]:
        """The messages that a chunk of a stream completes; a gap ends the walk."""
        if gap:
            self.fail()
        return list(self.read(bytes(chunk or b"")))

    def fail(self) -> None:
        self.failed, self.open = True, None
        self.held.clear()
        self.at = self.seen = 0

    def head(self) -> bool:
        """Whether the next head is there; bytes that can't begin one fail the side."""
        end = self.held.find(b"\r\n\r\n", max(self.at, self.seen - 3))
        if end < 0:
            self.seen = len(self.held)
            if len(self.held) - self.at > HEAD:
                self.fail()
            return False
        head = bytes(memoryview(self.held)[self.at : end + 2])
        found = (head_of if len(head) > SMALL else small_head_of)(head)
        if found is None:
            self.fail()
            return False
        told, chunked, size = found
        self.open = {"told": told, "chunked": chunked, "size": size, "from": end + 4, "next": end + 4, "parts": []}
        self.at = end + 4
        return True

    def body(self) -> dict | None:
        """The open message if its body is whole."""
        o = self.open
        if o["chunked"]:
            return self.chunks(o)
        if o["size"] is None or o["from"] + o["size"] > len(self.held):
            return None
        return self.done(bytes(self.held[o["from"] : o["from"] + o["size"]]), o["from"] + o["size"])

    def chunks(self, o: dict) -> dict | None:
        while True:
            eol = self.held.find(b"\r\n", o["next"])
            if eol < 0:
                return None
            size = CHUNK_SIZE.match(self.held, o["next"], eol)
            if not size:
                self.fail()
                return None
            n = int(size[0], 16)
            if n == 0:  # trailers up to an empty line
                end = eol + 4 if self.held.startswith(b"\r\n", eol + 2) else self.held.find(b"\r\n\r\n", eol) + 4
                return self.done(b"".join(o["parts"]), end) if end >= eol + 4 and end <= len(self.held) else None
            if eol + 4 + n > len(self.held):
                return None
            o["parts"].append(bytes(self.held[eol + 2 : eol + 2 + n]))
            o["next"] = eol + 4 + n

    def done(self, body: bytes, end: int) -> dict:
        told, self.open, self.at, self.seen = self.open["told"], None, end, end
        return {**told, "body": body.decode("latin-1")}

    def finish(self) -> dict | None:
        """A response without a length, at the end of its side."""
        if self.open and not self.open["chunked"] and self.open["size"] is None:
            return self.done(bytes(self.held[self.open["from"] :]), len(self.held))
        return None


def messages_of(data: bytes) -> list[dict]:
    side = HttpSide()
    out = list(side.read(data))
    last = side.finish()
    return out + [last] if last else out


def http(stream: Column) -> Column:
    """array<struct<is_request, method, path, version, status, headers, body, poison>> of the messages of one side's bytes.

    Bodies are framed by Transfer-Encoding, else by Content-Length; a response with neither and a status that has a body
    goes on to the end. poison names what makes the framing doubtful: both framings, lengths or hosts that differ, folded
    lines, a bare carriage return. Messages that aren't whole end the walk, as do a head over HEAD bytes and bytes that are no
    message.
    """
    return wire.by_row(f"array<{HTTP}>", messages_of, stream)


def http_messages(chunks: DataFrame, keys: list[str], placed: bool = False) -> DataFrame:
    """keys, us, seq, n, message: the HTTP messages of streams, when their last byte comes.

    chunks: keys (the last one the side), us, seq, offset, chunk, gap, as reassembly gives them. A gap ends a side's walk. A side is read by one
    task with one unfinished message in memory, WAITING bytes at most.
    """

    def rows(us, seq, made):
        return [(us, seq, i, m) for i, m in enumerate(made)]

    def step(state, us, seq, offset, chunk, gap):
        state[1:] = [us, seq]
        return rows(us, seq, state[0].take(chunk, gap))

    def finish(state):
        last = state[0].finish()
        return [(*state[1:], 1 << 16, last)] if last else []

    return ordered_fold(chunks, keys, ["chunk", "gap"], lambda: [HttpSide(), 0, 0], step, f"us long, seq long, n int, message {HTTP}", finish, ("us", "seq", "offset"), placed)


def status_class(status: Column) -> Column:
    """1xx to 5xx as a number; null outside of them."""
    return F.when(status.between(100, 599), F.floor(status / 100).cast("int"))


def http_exchanges(messages: DataFrame, flow: str, reset: str = "reset") -> DataFrame:
    """flow, n, request, response, outcome: the n-th request of a flow with its n-th final response.

    messages: flow, us, seq, is_request, status, `reset` (whether the flow ended by a reset). Interim responses don't
    count. outcome: completed, reset or no_response.
    """
    final = messages.filter(F.col("is_request") | ~F.coalesce(F.col("status").between(100, 199) & (F.col("status") != 101), F.lit(False)))
    n = F.row_number().over(Window.partitionBy(flow, "is_request").orderBy("us", "seq"))
    each = final.withColumn("n", n).groupBy(flow, "n").agg(
        F.max(F.when(F.col("is_request"), F.col("seq"))).alias("request"), F.max(F.when(~F.col("is_request"), F.col("seq"))).alias("response"),
        F.max(F.when(~F.col("is_request"), F.col("status"))).alias("status"), F.max(F.when(F.col("is_request"), F.col("us"))).alias("us"),
        (F.max(F.when(~F.col("is_request"), F.col("us"))) - F.max(F.when(F.col("is_request"), F.col("us")))).alias("elapsed_us"), F.bool_or(reset).alias("was_reset"),
    )
    outcome = F.when(F.col("response").isNotNull(), "completed").when(F.col("was_reset"), "reset").otherwise("no_response")
    return each.filter("request is not null").select(flow, "n", "us", "request", "response", "status", "elapsed_us", outcome.alias("outcome"))


#: TLS versions, extension numbers, and groups that resist quantum computers.
VERSIONS = {0x0300: "SSL3.0", 0x0301: "TLS1.0", 0x0302: "TLS1.1", 0x0303: "TLS1.2", 0x0304: "TLS1.3"}
SHORT = {0x0300: "s3", 0x0301: "10", 0x0302: "11", 0x0303: "12", 0x0304: "13"}
SNI, GROUPS, ALPN, SUPPORTED, KEY_SHARE, ECH = 0, 10, 16, 43, 51, 0xFE0D
PQ_GROUPS = {0x11EB: "SecP256r1MLKEM768", 0x11EC: "X25519MLKEM768", 0x11ED: "SecP384r1MLKEM1024", 0x6399: "X25519Kyber768Draft00"}


def tls_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, content) of the whole TLS records."""
    at = 0
    while at + 5 <= len(data) and at + 5 + int.from_bytes(data[at + 3 : at + 5]) <= len(data):
        size = int.from_bytes(data[at + 3 : at + 5])
        yield data[at], data[at + 5 : at + 5 + size]
        at += 5 + size


def handshakes(stream: Column) -> Column:
    """Handshake bytes of one side's TLS records, put together."""
    return wire.by_row("binary", lambda data: b"".join(body for kind, body in tls_records(data) if kind == 22), stream)


LEVELS = {1: "warning", 2: "fatal"}


def alerts(stream: Column) -> Column:
    """array<struct<level, code>> of one side's plain alerts."""
    return wire.by_row("array<struct<level:string,code:bigint>>", lambda data: [{"level": LEVELS.get(body[0], "other"), "code": body[1]} for kind, body in tls_records(data) if kind == 21 and len(body) == 2], stream)


CLIENT_HELLO = "struct<version:bigint,ciphers:array<bigint>,extensions:array<bigint>,groups:array<bigint>,supported:array<bigint>,sni:string,alpn:array<string>,ech:boolean,key_shares:array<bigint>>"
SERVER_HELLO = "struct<version:bigint,cipher:bigint,extensions:array<bigint>,alpn:string>"


def number(data: bytes, at: int, size: int) -> int | None:
    return int.from_bytes(data[at : at + size]) if 0 <= at and at + size <= len(data) else None


def pairs(data: bytes, at: int, size: int | None) -> list[int]:
    """Numbers of two bytes from `at` on, `size` bytes of them, as far as they go."""
    return [int.from_bytes(data[i : i + 2]) for i in range(at, min(at + (size or 0), len(data)) - 1, 2)]


def typed(data: bytes, at: int, head: int = 2) -> Iterator[tuple[int, bytes]]:
    """(kind, content) of the whole extensions behind a length of two bytes."""
    end = at + 2 + (number(data, at, 2) or 0)
    at += 2
    while at + head + 2 <= min(end, len(data)):
        size = int.from_bytes(data[at + head : at + head + 2])
        if at + head + 2 + size > min(end, len(data)):
            return
        yield int.from_bytes(data[at : at + head]), data[at + head + 2 : at + head + 2 + size]
        at += head + 2 + size


def names_in(data: bytes) -> list[str]:
    """Names with a length of one byte each, behind a length of two."""
    out, at = [], 2
    while at < len(data) and at + 1 + data[at] <= len(data):
        out.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    return out


def client_hello_of(data: bytes) -> dict | None:
    if len(data) < 42 or data[0] != 1:
        return None
    sid = 39 + data[38]
    ciphers = number(data, sid, 2)
    after = sid + 2 + (ciphers or 0)
    found = list(typed(data, after + 1 + (number(data, after, 1) or 0))) if ciphers is not None else []
    first: dict[int, bytes] = {}
    for kind, value in found:
        first.setdefault(kind, value)
    sni = first.get(SNI)
    return {
        "version": number(data, 4, 2), "ciphers": pairs(data, sid + 2, ciphers), "extensions": [k for k, _ in found],
        "groups": pairs(first.get(GROUPS, b""), 2, number(first.get(GROUPS, b""), 0, 2)), "supported": pairs(first.get(SUPPORTED, b""), 1, number(first.get(SUPPORTED, b""), 0, 1)),
        "sni": None if sni is None or len(sni) < 5 else sni[5 : 5 + int.from_bytes(sni[3:5])].decode("latin-1").lower(), "alpn": names_in(first.get(ALPN, b"")), "ech": ECH in first,
        "key_shares": [k for k, _ in typed(first.get(KEY_SHARE, b""), 0)],
    }


def client_hello(message: Column) -> Column:
    """struct<version, ciphers, extensions, groups, supported, sni, alpn, ech, key_shares> of a ClientHello message; else null."""
    return wire.by_row(CLIENT_HELLO, client_hello_of, message)


def server_hello_of(data: bytes) -> dict | None:
    if len(data) < 42 or data[0] != 2:
        return None
    sid = 39 + data[38]
    found = list(typed(data, sid + 3))
    first = dict(reversed(found))
    alpn = names_in(first.get(ALPN, b""))
    agreed = number(first.get(SUPPORTED, b""), 0, 2)
    return {"version": number(data, 4, 2) if agreed is None else agreed, "cipher": number(data, sid, 2), "extensions": [k for k, _ in found], "alpn": alpn[0] if alpn else None}


def server_hello(message: Column) -> Column:
    """struct<version, cipher, extensions, alpn> of a ServerHello message; else null. version is the one agreed on."""
    return wire.by_row(SERVER_HELLO, server_hello_of, message)


def plain(values: Column) -> Column:
    return F.filter(values, lambda x: ~grease(x))


def ja3_text(hello: Column) -> Column:
    """Version, ciphers, extensions and groups without GREASE; point formats count as empty."""
    listed = lambda c: F.array_join(F.transform(plain(c), lambda x: x.cast("string")), "-")
    return F.concat_ws(",", hello["version"].cast("string"), listed(hello["ciphers"]), listed(hello["extensions"]), listed(hello["groups"]), F.lit(""))


def ja3(hello: Column) -> Column:
    return F.md5(ja3_text(hello).cast("binary"))


def ja4(hello: Column, transport: str = "t") -> Column:
    """Transport, highest version, SNI or not, counts, ALPN; then hashes of the sorted ciphers and of the sorted extensions."""
    ciphers, extensions = plain(hello["ciphers"]), plain(hello["extensions"])
    version = F.coalesce(F.array_max(plain(hello["supported"])), hello["version"])
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    first = F.get(hello["alpn"], F.lit(0))
    ends = F.when(first.isNull() | (first == ""), "00").otherwise(F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1)))
    table = F.create_map(*[F.lit(x) for p in SHORT.items() for x in p])
    head = F.concat(F.lit(transport), F.coalesce(F.try_element_at(table, version.cast("int")), F.lit("00")), F.when(hello["sni"].isNotNull(), "d").otherwise("i"), two(F.size(ciphers)), two(F.size(extensions)), ends)
    hashed = lambda xs: F.when(F.size(xs) == 0, "000000000000").otherwise(F.substring(F.sha2(F.array_join(F.array_sort(F.transform(xs, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))), ",").cast("binary"), 256), 1, 12))
    return F.concat_ws("_", head, hashed(ciphers), hashed(extensions))


#: Cipher suites without encryption, with RC4, DES or 40-bit keys.
WEAK_CIPHERS = (0x0000, 0x0001, 0x0002, 0x0003, 0x0004, 0x0005, 0x0006, 0x0008, 0x000A, 0x0013, 0x0014, 0x0016, 0x0017, 0x0018, 0x0019, 0x001A, 0x001B, 0x003B, 0xC002, 0xC003, 0xC007, 0xC008, 0xC00C, 0xC011, 0xC012, 0xC016)


def tls_handshake(client: Column, server: Column) -> Column:
    """struct of one handshake from both sides' streams: what was offered, what was agreed on, fingerprints."""

    def both(h: Column) -> Column:
        c, s = h["c"], h["s"]
        return F.struct(
            c["sni"].alias("sni"),
            F.coalesce(s["alpn"], F.get(c["alpn"], F.lit(0))).alias("alpn"),
            named(s["version"], VERSIONS).alias("version"),
            s["cipher"].alias("cipher"),
            ja3(c).alias("ja3"),
            ja4(c).alias("ja4"),
            c["ech"].alias("ech_offered"),
            F.get(F.filter(F.transform(c["key_shares"], lambda g: F.try_element_at(F.create_map(*[F.lit(x) for p in PQ_GROUPS.items() for x in p]), g.cast("int"))), lambda n: n.isNotNull()), F.lit(0)).alias("pq_group"),
            s["cipher"].isin(*WEAK_CIPHERS).alias("weak_cipher"),
            (s["version"] < 0x0303).alias("obsolete_version"),
        )

    return wire.let(F.struct(client_hello(handshakes(client)).alias("c"), server_hello(handshakes(server)).alias("s")), both)


#: QUIC versions.
QUIC_VERSIONS = {1: "v1", 0x6B3343CF: "v2", 0: "negotiation"}


def quic(payload: Column) -> Column:
    """struct<version, kind, dcid, scid, initial> of a long header; null for short headers. Contents stay encrypted."""
    first, version = uint(payload, 0, 1), uint(payload, 1, 4)
    dcid = uint(payload, 5, 1)
    scid_at = 6 + dcid
    v2 = version == 0x6B3343CF
    kind = F.when(v2, (bits(first, 4, 2) + 3) % 4).otherwise(bits(first, 4, 2))
    table = F.create_map(*[F.lit(x) for p in QUIC_VERSIONS.items() for x in p])
    draft = F.floor(version / 256) == 0xFF0000
    return F.when(
        (first >= 0xC0) & (dcid <= 20),
        F.struct(
            F.coalesce(F.try_element_at(table, version), F.when(draft, "draft").otherwise("other")).alias("version"),
            F.when(version != 0, named(kind, {0: "initial", 1: "zero_rtt", 2: "handshake", 3: "retry"})).alias("kind"),
            F.lower(F.hex(cut(payload, 6, dcid))).alias("dcid"),
            F.lower(F.hex(cut(payload, scid_at + 1, uint(payload, scid_at, 1)))).alias("scid"),
            F.coalesce((version != 0) & (kind == 0), F.lit(False)).alias("initial"),
        ),
    )


#: HTTP/2 frame kinds, and names of gRPC's status numbers.
H2_KINDS = {0: "data", 1: "headers", 2: "priority", 3: "rst_stream", 4: "settings", 5: "push_promise", 6: "ping", 7: "goaway", 8: "window_update", 9: "continuation"}
GRPC_STATUS = dict(enumerate("ok cancelled unknown invalid_argument deadline_exceeded not_found already_exists permission_denied resource_exhausted failed_precondition aborted out_of_range unimplemented internal unavailable data_loss unauthenticated".split()))
PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"


def http2_frames(stream: Column) -> Column:
    """array<struct<kind, flags, stream, size, end_stream, error>> of one side's HTTP/2 frames, the preface passed over."""
    start = F.when(stream.startswith(F.lit(PREFACE)), len(PREFACE)).otherwise(0)
    each = records(stream, start, F.length(stream), 9, lambda at: uint(stream, at, 3), kind=lambda at: uint(stream, at + 3, 1))

    def frame(r: Column) -> Column:
        flags = uint(stream, r["at"] - 5, 1)
        error = F.when(r["kind"] == 3, uint(stream, r["at"], 4)).when(r["kind"] == 7, uint(stream, r["at"] + 4, 4))
        return F.struct(named(r["kind"], H2_KINDS).alias("kind"), flags.alias("flags"), bits(uint(stream, r["at"] - 4, 4), 0, 31).alias("stream"), r["size"].alias("size"), (r["kind"].isin(0, 1) & wire.bit(flags, 1)).alias("end_stream"), error.alias("error"))

    return F.transform(each, frame)


def grpc_method(path: Column) -> Column:
    """struct<service, method> of a path like /package.Service/Method; else null."""
    return F.when(path.rlike("^/[^/]+/[^/]+$"), F.struct(F.split_part(path, F.lit("/"), F.lit(2)).alias("service"), F.split_part(path, F.lit("/"), F.lit(3)).alias("method")))


def is_grpc(content_type: Column) -> Column:
    return F.lower(content_type).rlike(r"^application/grpc($|[+;])")


def grpc_status(headers: Column) -> Column:
    """struct<code, name, message> of the trailers; null without a status."""
    code = header(headers, "grpc-status").try_cast("int")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), named(code, GRPC_STATUS).alias("name"), header(headers, "grpc-message").alias("message")))


def ssh(stream: Column) -> Column:
    """struct<banner, kex, encryption, mac, compression, hassh> of one side's SSH stream; lists are those of that side's sending."""
    eol = locate("\n", text(stream), F.lit(0))
    banner = F.when(stream.startswith(F.lit(b"SSH-")) & (eol > 0), F.rtrim(F.regexp_replace(text(cut(stream, 0, eol)), "\r$", "")))
    at = eol + 1
    end = at + 4 + uint(stream, at, 4)
    lists = records(stream, (at + 22).cast("int"), F.least(end, F.length(stream)), 4, lambda i: uint(stream, i, 4), most=10, kind=lambda i: F.lit(0))
    listed = lambda ls, i: F.split(text(cut(stream, F.get(ls, F.lit(i))["at"], F.get(ls, F.lit(i))["size"])), ",")

    def told(ls: Column) -> Column:
        names = [listed(ls, i) for i in (0, 2, 4, 6)]
        return F.struct(banner.alias("banner"), *[F.when(F.size(ls) == 10, n).alias(a) for a, n in zip(("kex", "encryption", "mac", "compression"), names, strict=True)], F.when(F.size(ls) == 10, F.md5(F.concat_ws(";", *[F.array_join(n, ",") for n in names]).cast("binary"))).alias("hassh"))

    return F.when(banner.isNotNull(), wire.let(F.when(uint(stream, at + 5, 1) == 20, lists).otherwise(F.array().cast("array<struct<kind:bigint,at:int,size:int>>")), told))
