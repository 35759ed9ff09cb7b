"""Name services: DNS over UDP and TCP, multicast DNS, NetBIOS names, SSDP, and exchanges of queries and responses."""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.wire import bit, bits, cut, ipv4, named, text, uint
from tidelane.operators.folds import ordered_fold
from tidelane.sources.headers import colons

#: Record types and response codes.
TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 65: "HTTPS"}
CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
#: Services that devices announce over multicast DNS.
DEVICE_SERVICES = ("_airplay._tcp.local", "_googlecast._tcp.local", "_hap._tcp.local", "_ipp._tcp.local", "_printer._tcp.local", "_raop._tcp.local", "_ssh._tcp.local", "_workstation._tcp.local")
#: Bytes of a domain name on the wire, and pointers that may be followed in one.
NAME, JUMPS = 255, 64
MESSAGE = (
    "struct<id:bigint,is_response:boolean,opcode:bigint,authoritative:boolean,truncated:boolean,recursion_desired:boolean,recursion_available:boolean,rcode:string,"
    "questions:array<struct<name:string,type:string>>,records:array<struct<section:int,name:string,type:string,ttl:bigint,value:string>>>"
)


def name_at(data: bytes, at: int) -> tuple[str, int] | None:
    """(name, place after it) with pointers followed; null for one that runs off the data, is too long or goes in circles."""
    labels, end, size, jumps = [], -1, 0, 0
    while True:
        if at >= len(data):
            return None
        n = data[at]
        if n >= 192:
            jumps += 1
            if at + 2 > len(data) or jumps > JUMPS:
                return None
            end = end if end >= 0 else at + 2
            at = (n & 63) << 8 | data[at + 1]
        elif n == 0:
            return ".".join(labels).lower(), end if end >= 0 else at + 1
        else:
            size += n + 1
            if at + 1 + n > len(data) or size > NAME:
                return None
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def value_of(data: bytes, kind: int, at: int, size: int) -> str | None:
    """A record's data as text: addresses, names, text; hexadecimal for other types."""
    if kind == 1 and size == 4:
        return ".".join(map(str, data[at : at + 4]))
    if kind == 28 and size == 16:
        return colons(data[at : at + 16])
    if kind in (2, 5, 12, 15):
        found = name_at(data, at + (2 if kind == 15 else 0))
        return found and found[0]
    if kind == 16:
        out, end = [], at + size
        while at < end:
            out.append(data[at + 1 : min(at + 1 + data[at], end)])
            at += 1 + data[at]
        return b"".join(out).decode("latin-1")
    return data[at : at + size].hex()


HEAD, KIND, RECORD = struct.Struct(">6H"), struct.Struct(">H"), struct.Struct(">HHIH")


@lru_cache(1024)
def flag_fields(flags: int) -> dict:
    bits_ = {n: bool(flags & m) for n, m in (("is_response", 0x8000), ("authoritative", 0x400), ("truncated", 0x200), ("recursion_desired", 0x100), ("recursion_available", 0x80))}
    return {"opcode": flags >> 11 & 15, "rcode": CODES.get(flags & 15, "other"), **bits_}


def message_of(data: bytes) -> dict | None:
    """Fields of MESSAGE; sections end at the first entry that isn't whole."""
    if len(data) < 12:
        return None
    number, flags, asked, *counts = HEAD.unpack_from(data)
    questions, records, at = [], [], 12
    for _ in range(asked):
        found = name_at(data, at)
        if found is None or found[1] + 4 > len(data):
            at = -1
            break
        (kind,) = KIND.unpack_from(data, found[1])
        questions.append({"name": found[0], "type": TYPES.get(kind) or f"TYPE{kind}"})
        at = found[1] + 4
    for section, count in enumerate(counts):
        for _ in range(count if at >= 0 else 0):
            found = name_at(data, at)
            if found is None or found[1] + 10 > len(data):
                at = -1
                break
            kind, _, ttl, size = RECORD.unpack_from(data, found[1])
            at = found[1] + 10
            if at + size > len(data):
                at = -1
                break
            records.append({"section": section, "name": found[0], "type": TYPES.get(kind) or f"TYPE{kind}", "ttl": ttl, "value": value_of(data, kind, at, size)})
            at += size
    return {"id": number, "questions": questions, "records": records, **flag_fields(flags)}


def dns(payload: Column) -> Column:
    """struct<id, is_response, opcode, authoritative, truncated, recursion_desired, recursion_available, rcode, questions, records>.

    questions: array<struct<name, type>>; records: array<struct<section, name, type, ttl, value>>, section 0 to 2 for
    answers, authorities and additionals. Sections end at the first entry that isn't whole. Null for fewer than 12 bytes.
    """
    return wire.by_row(MESSAGE, message_of, payload)


def split_messages(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 2 <= len(data) and at + 2 + int.from_bytes(data[at : at + 2]) <= len(data):
        size = int.from_bytes(data[at : at + 2])
        out.append(data[at + 2 : at + 2 + size])
        at += 2 + size
    return out


def dns_stream(chunk: Column) -> Column:
    """array<binary>: the whole messages of a DNS stream over TCP, each behind its length."""
    return wire.by_row("array<binary>", split_messages, chunk)


def framed_step(state: list, chunk: bytes | None, gap: int | None) -> list[bytes]:
    """The messages that a chunk of a stream completes. state: the bytes that wait ([b"", False] at first), and whether a gap has ended it."""
    if gap:
        state[:] = [b"", True]
    if state[1]:
        return []
    data = state[0] + bytes(chunk or b"")
    found = split_messages(data)
    state[0] = data[sum(2 + len(m) for m in found) :]
    return found


def framed(chunks: DataFrame, keys: list[str], placed: bool = False) -> DataFrame:
    """keys, us, seq, n, payload: the messages of DNS streams, when their last byte comes. A gap ends a side's stream."""

    def step(state, us, seq, offset, chunk, gap):
        return [(us, seq, i, m) for i, m in enumerate(framed_step(state, chunk, gap))]

    return ordered_fold(chunks, keys, ["chunk", "gap"], lambda: [b"", False], step, "us long, seq long, n int, payload binary", order=("us", "seq", "offset"), placed=placed)


def services(message: Column) -> Column:
    """array<struct<service, instance>> that a multicast DNS message announces by PTR records."""
    pointers = F.filter(message["records"], lambda r: r["type"] == "PTR")
    return F.transform(pointers, lambda r: F.struct(r["name"].alias("service"), r["value"].alias("instance"), r["name"].isin(*DEVICE_SERVICES).alias("device")))


def nbns(payload: Column) -> Column:
    """struct<id, is_response, opcode, name, suffix, answers>: a NetBIOS name message; names are 32 letters for 16 bytes."""
    flags = uint(payload, 2, 2)
    encoded = text(cut(payload, 13, 32))
    half = lambda i: F.ascii(F.substring(encoded, i, F.lit(1))) - 65
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: half(2 * i + 1) * 16 + half(2 * i + 2))
    name = F.rtrim(F.array_join(F.transform(F.slice(codes, 1, 15), lambda c: F.char(c)), ""))
    return F.when(
        (F.length(payload) >= 50) & (uint(payload, 12, 1) == 32),
        F.struct(uint(payload, 0, 2).alias("id"), bit(flags, 0x8000).alias("is_response"), named(bits(flags, 11, 4), {0: "query", 5: "registration", 6: "release", 7: "wack", 8: "refresh"}).alias("opcode"), name.alias("name"), F.element_at(codes, 16).alias("suffix"), uint(payload, 6, 2).alias("answers")),
    )


def ssdp(payload: Column) -> Column:
    """struct<kind, nt, nts, st, usn, location, server, max_age, alive, bye>; null for other texts."""
    said = text(payload)
    header = lambda name: F.nullif(F.trim(F.regexp_extract(said, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    kind = F.when(said.startswith("M-SEARCH "), "search").when(said.startswith("NOTIFY "), "notify").when(said.startswith("HTTP/1.1 200"), "response")
    age = F.nullif(F.regexp_extract(said, r"(?i)max-age\s*=\s*(\d+)", 1), F.lit("")).cast("long")
    return F.when(
        kind.isNotNull(),
        F.struct(kind.alias("kind"), header("NT").alias("nt"), header("NTS").alias("nts"), header("ST").alias("st"), header("USN").alias("usn"), header("LOCATION").alias("location"), header("SERVER").alias("server"), age.alias("max_age"), F.coalesce(header("NTS") == "ssdp:alive", F.lit(False)).alias("alive"), F.coalesce(header("NTS") == "ssdp:byebye", F.lit(False)).alias("bye")),
    )


def exchanges(messages: DataFrame, scope: list[str], number: str = "id", timeout_us: int = 30_000_000) -> DataFrame:
    """Queries and orphan responses of `messages` (us, seq, is_response, rcode): query_seq, response_seq, elapsed_us, outcome.

    A response belongs to the last query of its scope and number if nothing has answered that yet. A later query with
    the same number takes the place of an open one. outcome: completed, failed (an error code), no_response, replaced, or
    orphan. One shuffle by scope and number, no join.
    """
    w = Window.partitionBy(*scope, number).orderBy("us", "seq")
    told = messages.withColumn("__q", F.lag("is_response").over(w)).withColumn("__n", F.lead("is_response").over(w))
    for name in ("us", "seq", "rcode"):
        told = told.withColumn(f"__{name}", F.lead(name).over(w))
    told = told.withColumn("__prior", F.lag("us").over(w))
    query = ~F.col("is_response")
    answered = query & F.coalesce(F.col("__n"), F.lit(False)) & (F.col("__us") - F.col("us") < timeout_us)
    taken = F.coalesce(~F.col("__q") & (F.col("us") - F.col("__prior") < timeout_us), F.lit(False))
    replaced = query & F.coalesce(~F.col("__n") & (F.col("__us") - F.col("us") < timeout_us), F.lit(False))
    outcome = F.when(answered, F.when(F.col("__rcode") == "NOERROR", "completed").otherwise("failed")).when(replaced, "replaced").when(query, "no_response").otherwise("orphan")
    rows = told.filter(query | ~taken)
    return rows.select(*scope, number, F.when(query, F.col("seq")).alias("query_seq"), F.when(answered, F.col("__seq")).when(~query, F.col("seq")).alias("response_seq"), F.when(answered, F.col("__us") - F.col("us")).alias("elapsed_us"), F.when(answered, F.col("__rcode")).when(~query, F.col("rcode")).alias("rcode"), outcome.alias("outcome"))


def name_claims(responses: DataFrame, default_ttl_s: int = 300, grace_s: int = 60, most: int = 8) -> DataFrame:
    """client, ip, name, us, expires_us, new: each binding of an address to the name that was asked for.

    responses: us, seq, client, message (of `dns`). The time to live is the least one of the address record and the
    aliases before it. A claim ends a grace time after its expiry; new: no live claim of that name was there. Of an
    address the `most` newest names stay.
    """
    m = F.col("message")
    alias = F.array_min(F.transform(F.filter(m["records"], lambda r: r["type"] == "CNAME"), lambda r: r["ttl"]))
    answers = F.when(m["is_response"] & (F.size(m["questions"]) > 0), m["records"])  # null, and so no rows, for the others
    records = responses.select("us", "seq", "client", F.get(m["questions"], F.lit(0))["name"].alias("name"), alias.alias("alias_ttl"), F.explode(answers).alias("r"))
    claims = records.filter(F.col("r.type").isin("A", "AAAA") & (F.col("r.section") == 0)).select("us", "seq", "client", F.col("r.value").alias("ip"), "name", (F.col("us") + (F.coalesce(F.least(F.col("r.ttl"), F.coalesce("alias_ttl", F.col("r.ttl"))), F.lit(default_ttl_s)) + grace_s) * 1_000_000).alias("expires_us"))
    of = Window.partitionBy("client", "ip", "name")
    until = F.lag("expires_us").over(of.orderBy("us", "seq"))
    rank = F.dense_rank().over(Window.partitionBy("client", "ip").orderBy(F.desc("__last"), "name"))
    placed = claims.repartition("client", "ip")  # all windows keep to this one shuffle, and nothing is joined or broadcast
    told = placed.withColumn("new", F.coalesce(until < F.col("us"), F.lit(True))).withColumn("__last", F.max("us").over(of)).withColumn("__r", rank)
    return told.filter(F.col("__r") <= most).select("client", "ip", "name", "us", "seq", "expires_us", "new")
