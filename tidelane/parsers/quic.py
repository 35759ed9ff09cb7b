"""QUIC Initial packets: keys from the connection id, protection taken off, and the ClientHello put together across packets.

Headers, keys and frame borders are read in Arrow batches; all AES work is Spark's own.
"""

from __future__ import annotations

import functools
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.wire import cut, hexed, uint
from tidelane.operators.folds import ordered_fold
from tidelane.parsers.web import client_hello, ja4

#: Versions with their salt, the prefix of key labels, and the two bits that mark an Initial packet.
VERSIONS = {
    0x00000001: ("v1", "38762cf7f55934b34d179ae6a4c80cadccbb7f0a", "quic ", 0),
    0x6B3343CF: ("v2", "0dede3def700a6db819381be6e269dcbf9bd2ed9", "quicv2 ", 1),
    0xFF00001D: ("draft", "afbfec289993d24c9e9786f19c6111e04390a899", "quic ", 0),
}
#: What is held of a connection until its ClientHello is whole: frames, bytes, and microseconds without progress.
FRAMES, BYTES, PATIENCE_US = 64, 1 << 16, 5_000_000

KEYS = "struct<key:binary,iv:binary,hp:binary>"
HEADER = "struct<version:string,dcid:binary,scid:binary,token:boolean,pn_at:int,end:int,key:binary,iv:binary,hp:binary>"
CRYPTO = "array<struct<at:long,data:binary>>"


@functools.cache
def label_of(label: str, size: int) -> bytes:
    name = b"tls13 " + label.encode()
    return size.to_bytes(2) + bytes([len(name)]) + name + b"\0\x01"


def expanded(secret: bytes, label: str, size: int) -> bytes:
    """HKDF-Expand-Label with an empty context, for one block of output."""
    return hmac.digest(secret, label_of(label, size), "sha256")[:size]


def client_keys(dcid: bytes, version: int) -> dict | None:
    """Key, nonce base and header key of the client's Initial packets; null for other versions."""
    if version not in VERSIONS:
        return None
    _, salt, prefix, _ = VERSIONS[version]
    secret = hmac.digest(bytes.fromhex(salt), dcid, "sha256")
    client = expanded(secret, "client in", 32)
    return {"key": expanded(client, prefix + "key", 16), "iv": expanded(client, prefix + "iv", 12), "hp": expanded(client, prefix + "hp", 16)}


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it); IndexError beyond the data."""
    size = 1 << (data[at] >> 6)
    if at + size > len(data):
        raise IndexError
    return int.from_bytes(data[at : at + size]) & ((1 << (8 * size - 2)) - 1), at + size


def header_of(data: bytes | None) -> dict | None:
    """Fields of an Initial packet at the start of a datagram with its keys; null for anything else or if it is cut off."""
    try:
        if not data or data[0] & 0xC0 != 0xC0:
            return None
        version = int.from_bytes(data[1:5])
        keys = VERSIONS.get(version)
        if keys is None or data[0] >> 4 & 3 != keys[3]:
            return None
        dcid = data[6 : 6 + data[5]]
        at = 6 + data[5]
        scid = data[at + 1 : at + 1 + data[at]]
        size, at = varint(data, at + 1 + data[at])
        length, pn_at = varint(data, at + size)
    except IndexError:
        return None
    if len(dcid) > 20 or len(scid) > 20 or length < 20 or pn_at + length > len(data):
        return None
    return {"version": keys[0], "dcid": dcid, "scid": scid, "token": size > 0, "pn_at": pn_at, "end": pn_at + length, **client_keys(dcid, version)}


def crypto_of(plain: bytes | None) -> list[dict] | None:
    """CRYPTO frames of an opened packet; null where frames are broken. Frames that Initial packets can't hold end the walk."""
    if plain is None:
        return None
    out, at = [], 0
    try:
        while at < len(plain):
            at = len(plain) - len(plain[at:].lstrip(b"\0\x01"))  # padding and pings, all at once
            if at == len(plain):
                break
            kind, at = varint(plain, at)
            if kind in (0, 1):  # written longer
                continue
            if kind in (2, 3):  # acknowledgements
                _, at = varint(plain, at)
                _, at = varint(plain, at)
                ranges, at = varint(plain, at)
                for _ in range(1 + 2 * ranges + (3 if kind == 3 else 0)):
                    _, at = varint(plain, at)
            elif kind == 6:
                place, at = varint(plain, at)
                size, at = varint(plain, at)
                if at + size > len(plain):
                    return None
                out.append({"at": place, "data": plain[at : at + size]})
                at += size
            else:
                break
    except IndexError:
        return None
    return out


def headers(payload: Column) -> Column:
    names = [f.split(":")[0] for f in HEADER.removeprefix("struct<").rstrip(">").split(",")]

    @F.pandas_udf(HEADER)
    def read(payloads: pd.Series) -> pd.DataFrame:
        rows = [header_of(p) or dict.fromkeys(names) for p in payloads]
        return pd.DataFrame(rows, columns=names).astype({"pn_at": "Int32", "end": "Int32", "token": "boolean"})

    return read.asNondeterministic()(payload)


def keys_of(dcid: Column, version: Column) -> Column:
    """struct<key, iv, hp> of the client's packets under a connection id and the number of a version."""

    @F.pandas_udf(KEYS)
    def derived(dcids: pd.Series, versions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([client_keys(d, int(v)) or dict.fromkeys(("key", "iv", "hp")) for d, v in zip(dcids, versions, strict=True)], columns=["key", "iv", "hp"])

    return derived.asNondeterministic()(dcid, version)


def crypto_frames(plain: Column) -> Column:
    @F.pandas_udf(CRYPTO)
    def read(values: pd.Series) -> pd.Series:
        return values.map(crypto_of, na_action="ignore")

    return read.asNondeterministic()(plain)


def mask_of(sample: Column, hp: Column) -> Column:
    """The first five bytes of the sample under the header key."""
    return F.substring(F.aes_encrypt(sample, hp, F.lit("ECB"), F.lit("PKCS")), 1, 5)


def nonce_of(iv: Column, pn: Column) -> Column:
    return F.concat(cut(iv, 0, 8), F.unhex(hexed(uint(iv, 8, 4).bitwiseXOR(pn), 4)))


def initials(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """`packets` whose payload starts with a client's Initial packet, with quic: version, dcid, scid, token, crypto frames.

    What isn't one, is cut off, or doesn't open under its connection's keys (a server's packet, for one) is left out.
    """
    p = packets.withColumn("__h", headers(F.col(payload))).filter("__h.pn_at is not null")
    data, head = F.col(payload), F.col("__h")
    p = p.withColumn("__m", mask_of(cut(data, F.col("__h.pn_at") + 4, 16), head["hp"]))
    p = p.withColumn("__first", uint(data, 0, 1).bitwiseXOR(uint(F.col("__m"), 0, 1).bitwiseAND(F.lit(0x0F))))
    size = F.col("__first").bitwiseAND(F.lit(3)) + 1
    masked = F.lit(0)
    for n in range(4, 0, -1):
        masked = F.when(size == n, uint(data, head["pn_at"], n).bitwiseXOR(uint(F.col("__m"), 1, n))).otherwise(masked)
    p = p.withColumn("__n", size.cast("int")).withColumn("__pn", masked)
    digits = F.lpad(F.hex("__pn"), F.col("__n") * 2, F.lit("0"))
    open_head = F.concat(F.unhex(hexed(F.col("__first"), 1)), cut(data, 1, head["pn_at"] - 1), F.unhex(digits))
    at = head["pn_at"] + F.col("__n")
    sealed = F.concat(nonce_of(head["iv"], F.col("__pn")), cut(data, at, head["end"] - at))
    p = p.withColumn("__plain", F.try_aes_decrypt(sealed, head["key"], F.lit("GCM"), F.lit("DEFAULT"), open_head))
    p = p.withColumn("__c", crypto_frames(F.col("__plain"))).filter("__c is not null")
    told = F.struct(head["version"].alias("version"), head["dcid"].alias("dcid"), head["scid"].alias("scid"), head["token"].alias("token"), F.col("__pn").alias("pn"), F.col("__c").alias("crypto"))
    return p.select(*packets.columns, told.alias("quic"))


def prefix_of(frames: list[tuple[int, bytes]]) -> bytes:
    out = bytearray()
    for at, data in sorted(frames):
        if at > len(out):
            break
        out += data[len(out) - at :] if at + len(data) > len(out) else b""
    return bytes(out)


def quic_hellos(packets: DataFrame, keys: list[str], payload: str = "payload", frames: int = FRAMES, most: int = BYTES, patience_us: int = PATIENCE_US) -> DataFrame:
    """keys, dcid, version, scid, us, first_us, packets, dropped, hello, sni, alpn, ja4: one row for each attempt to connect.

    packets: keys of a flow, us, seq, payload of datagrams in any order of their frames. An attempt's CRYPTO frames are put in
    order until a whole ClientHello is there (then us is that packet's time), or else hello and what comes of it are null.
    Frames beyond `frames` or `most` bytes of an attempt are dropped and counted; `patience_us` without more of the stream
    ends an attempt. Packets that follow a whole ClientHello under the same id begin no new attempt.
    """
    found = initials(packets, payload)
    rows = found.select(*keys, "us", "seq", F.col("quic.dcid").alias("dcid"), F.col("quic.version").alias("version"), F.col("quic.scid").alias("scid"), F.col("quic.crypto").alias("crypto"))

    def fresh(us, version, scid):
        return {"frames": [], "bytes": 0, "prefix": 0, "last": us, "first": us, "packets": 0, "dropped": 0, "version": version, "scid": scid}

    def told(s, us, hello):
        return (s["version"], s["scid"], us, s["first"], s["packets"], s["dropped"], hello)

    def step(state, us, seq, version, scid, crypto):
        out = []
        if state and state[0] is None:  # done
            return out
        if state and us - state[0]["last"] > patience_us:
            out.append(told(state[0], state[0]["last"], None))
            state.clear()
        if not state:
            state.append(fresh(us, version, scid))
        s = state[0]
        s["packets"] += 1
        for f in crypto:
            if len(s["frames"]) >= frames or s["bytes"] + len(f["data"]) > most:
                s["dropped"] += 1
                continue
            s["frames"].append((f["at"], f["data"]))
            s["bytes"] += len(f["data"])
        stream = prefix_of(s["frames"])
        if len(stream) > s["prefix"]:
            s["prefix"], s["last"] = len(stream), us
        if len(stream) >= 4 and stream[0] == 1 and len(stream) >= 4 + int.from_bytes(stream[1:4]):
            out.append(told(s, us, stream[: 4 + int.from_bytes(stream[1:4])]))
            state[0] = None
        return out

    def finish(state):
        return [told(state[0], state[0]["last"], None)] if state and state[0] else []

    schema = "version string, scid binary, us long, first_us long, packets long, dropped long, hello binary"
    got = ordered_fold(rows, [*keys, "dcid"], ["version", "scid", "crypto"], list, step, schema, finish)
    read = got.withColumn("__c", client_hello(F.col("hello")))
    return read.select(*got.columns, F.col("__c.sni").alias("sni"), F.col("__c.alpn").alias("alpn"), F.when(F.col("__c").isNotNull(), ja4(F.col("__c"), "q")).alias("ja4"))
