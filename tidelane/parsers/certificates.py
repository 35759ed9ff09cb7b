"""Certificates of a TLS handshake: the chain that a server shows, and what a certificate says of itself."""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column

from tidelane.functions import wire
from tidelane.sources.headers import colons

#: The handshake type of a certificate message, ASN.1 tags, attributes of names, and the extension of further names.
CERTIFICATE = 11
INTEGER, OBJECT, SEQUENCE, SET, UTC_TIME, LONG_TIME, VERSION, EXTENSIONS, DNS_NAME, ADDRESS = 0x02, 0x06, 0x30, 0x31, 0x17, 0x18, 0xA0, 0xA3, 0x82, 0x87
ATTRIBUTES = {"550403": "CN", "550406": "C", "550407": "L", "550408": "ST", "55040a": "O", "55040b": "OU"}
FURTHER_NAMES = bytes.fromhex("551d11")

FIELDS = "struct<subject:string,issuer:string,serial:string,not_before_us:bigint,not_after_us:bigint,names:array<string>,self_signed:boolean,sha256:string>"


def chain_of(handshakes: bytes) -> list[bytes]:
    """Certificates of the certificate messages, in order; what isn't whole is left out."""
    out, at = [], 0
    while at + 4 <= len(handshakes):
        end = at + 4 + int.from_bytes(handshakes[at + 1 : at + 4])
        if end > len(handshakes):
            break
        if handshakes[at] == CERTIFICATE and end >= at + 7:
            one, upto = at + 7, min(end, at + 7 + int.from_bytes(handshakes[at + 4 : at + 7]))
            while one + 3 <= upto and one + 3 + int.from_bytes(handshakes[one : one + 3]) <= upto:
                size = int.from_bytes(handshakes[one : one + 3])
                out.append(handshakes[one + 3 : one + 3 + size])
                one += 3 + size
        at = end
    return out


def chain(handshakes: Column) -> Column:
    """array<binary>: the certificates of one side's handshake bytes, as web.handshakes gives them, the server's own first."""
    return wire.by_row("array<binary>", chain_of, handshakes)


def elements(data: bytes, whole: bool = False) -> Iterator[tuple[int, bytes]]:
    """(tag, content) of the elements that follow each other; whole: content with its tag and length. ValueError if one isn't whole."""
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("cut off")
        tag, size, start = data[at], data[at + 1], at + 2
        if size >= 128:
            n = size & 127
            if n == 0 or n > 4 or start + n > len(data):
                raise ValueError("length")
            size, start = int.from_bytes(data[start : start + n]), start + n
        if start + size > len(data):
            raise ValueError("cut off")
        yield tag, data[at if whole else start : start + size]
        at = start + size


def name_of(data: bytes) -> str:
    """Attributes of a name, from first to last, as CN=a,O=b."""
    out = []
    for _, each in elements(data):
        for _, pair in elements(each):
            (_, kind), (tag, value) = list(elements(pair))[:2]
            text = value.decode("utf-16-be" if tag == 0x1E else "utf-8", "replace")
            out.append(f"{ATTRIBUTES.get(kind.hex(), kind.hex())}={text}")
    return ",".join(out)


def time_of(tag: int, value: bytes) -> int:
    """Microseconds since 1970 of a time in UTC; two digits of a year are 1950 to 2049."""
    text = value.decode("ascii").removesuffix("Z")
    if tag == UTC_TIME:
        text = ("19" if text[:2] >= "50" else "20") + text
    parts = [int(text[:4]), *(int(text[i : i + 2] or 0) for i in range(4, 14, 2))]
    return calendar.timegm((*parts, 0, 0, 0)) * 1_000_000


def further_names(data: bytes) -> list[str]:
    for _, extension in elements(next(elements(data))[1]):
        parts = list(elements(extension))
        if parts and parts[0] == (OBJECT, FURTHER_NAMES):
            found = elements(next(elements(parts[-1][1]))[1])
            return [v.decode("latin-1") if t == DNS_NAME else ".".join(map(str, v)) if len(v) == 4 else colons(v) for t, v in found if t == DNS_NAME or t == ADDRESS and len(v) in (4, 16)]
    return []


def certificate_of(data: bytes) -> dict | None:
    """Fields of FIELDS; null for bytes that are no certificate."""
    try:
        signed = next(elements(next(elements(data))[1]))[1]
        parts = [p for p in elements(signed) if p[0] != VERSION]
        (number, serial), _, (_, issuer), (_, dates), (_, subject) = parts[:5]
        begins, ends = list(elements(dates))[:2]
        if number != INTEGER:
            return None
        more = [v for t, v in parts[5:] if t == EXTENSIONS]
        return {
            "subject": name_of(subject), "issuer": name_of(issuer), "serial": serial.hex(), "not_before_us": time_of(*begins), "not_after_us": time_of(*ends),
            "names": further_names(more[0]) if more else [], "self_signed": subject == issuer, "sha256": hashlib.sha256(data).hexdigest(),
        }
    except (ValueError, StopIteration, IndexError):
        return None


def certificate(der: Column) -> Column:
    """struct<subject, issuer, serial, not_before_us, not_after_us, names, self_signed, sha256>; null for other bytes.

    self_signed: whether subject and issuer are the same bytes; the signature isn't checked.
    """
    return wire.by_row(FIELDS, certificate_of, der)
