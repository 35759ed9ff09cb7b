"""Column functions over addresses, names and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """The same value, in a form that the optimizer doesn't merge into what reads it, so it is computed once for a row."""
    return let(value, lambda x: x)


def ipv4_hex(address: Column) -> Column:
    """Eight hexadecimal digits of a dotted address."""
    parts = F.split(address, r"\.")
    return F.concat(*[F.lpad(F.hex(parts[i].cast("int")), 2, "0") for i in range(4)])


def address_hex(address: Column) -> Column:
    """8 or 32 hexadecimal digits of an IPv4 or IPv6 address in any usual form, a dotted end included; null for other text."""
    tail = F.regexp_extract(address, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    whole = F.when(address.contains("."), let(ipv4_hex(tail), lambda h: F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))).otherwise(address)
    groups = lambda x: F.array_join(F.transform(F.filter(F.split(x, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")

    def filled(halves: Column) -> Column:
        left, right = groups(halves[0]), F.coalesce(groups(F.get(halves, F.lit(1))), F.lit(""))
        zeros = F.when(F.size(halves) > 1, F.repeat(F.lit("0"), F.lit(32) - F.length(left) - F.length(right))).otherwise("")
        return F.upper(F.concat(left, zeros, right))

    six = let(F.split(whole, "::", 2), filled)
    four = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return F.when(four, ipv4_hex(address)).when(address.contains(":") & ~address.rlike("[0-9A-Fa-f]{5}"), let(six, lambda h: F.when(h.rlike("^[0-9A-F]{32}$"), h)))


def community_id(proto: Column, src: Column, sport: Column, dst: Column, dport: Column, seed: int = 0) -> Column:
    """Community ID, version 1: Base64 of SHA-1 over the seed and the ordered endpoints, both of IPv4 or both of IPv6.

    The smaller (address, port) comes first, by octets; IPv4 before IPv6. Null where an address is none. Types and codes
    of ICMP are taken as ports like any others.
    """
    end = lambda ip, port: F.struct(F.length(ip).alias("size"), ip.alias("ip"), F.lpad(F.hex(port), 4, "0").alias("port"))

    def digest(ends: Column) -> Column:
        low, high = ends[0], ends[1]
        data = F.concat(F.lit(f"{seed:04X}"), low["ip"], high["ip"], F.lpad(F.hex(proto), 2, "0"), F.lit("00"), low["port"], high["port"])
        return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(data)))))

    return let(F.array_sort(F.array(end(address_hex(src), sport), end(address_hex(dst), dport))), digest)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def shannon_entropy(text: Column) -> Column:
    """Bits for each character of a text: - sum p log2 p over its characters; 0 for the empty text."""
    cs, n = characters(text), F.length(text)
    share = lambda c: F.size(F.filter(cs, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(cs)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def looks_base64(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9+/=]{16,}$")


def looks_hex(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]{16,}$")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def registered_domain(name: Column) -> Column:
    """The last two labels; there is no list of public suffixes."""
    return F.substring_index(name, ".", -2)


def second_level(name: Column) -> Column:
    return F.split_part(registered_domain(name), F.lit("."), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two texts differ; null if their lengths do."""
    pairs = F.zip_with(characters(a), characters(b), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def hassh(kex: Column, encryption: Column, mac: Column, compression: Column) -> Column:
    """MD5 of four name lists, joined by commas inside and semicolons between."""
    return F.md5(F.concat_ws(";", *[F.array_join(c, ",") for c in (kex, encryption, mac, compression)]))


def grease(x: Column) -> Column:
    """Whether a 16-bit number is one of the sixteen values that are reserved to be ignored: 0x0A0A, 0x1A1A, ... 0xFAFA."""
    return (F.floor(x / 256) == x % 256) & (x % 16 == 10)


def ja3(version: Column, ciphers: Column, extensions: Column, groups: Column) -> Column:
    """MD5 of version and lists without GREASE values; point formats count as empty."""
    plain = lambda c: F.array_join(F.transform(F.filter(c, lambda x: ~grease(x)), lambda x: x.cast("string")), "-")
    return F.md5(F.concat_ws(",", version.cast("string"), plain(ciphers), plain(extensions), plain(groups), F.lit("")))


def first_bytes(payload: Column) -> Column:
    """Protocol that the first bytes of a stream show."""
    text = lambda *p: [payload.startswith(x) for x in p]
    known = {
        "http2": text("PRI * HTTP/2"),
        "tls": [F.hex(F.substring(payload, 1, 2)) == "1603"],
        "ssh": text("SSH-"),
        "http": text("GET ", "POST ", "PUT ", "HEAD ", "DELETE ", "OPTIONS ", "PATCH ", "HTTP/1."),
    }
    out = F.lit("raw")
    for name, tests in reversed(known.items()):
        any_of = tests[0]
        for t in tests[1:]:
            any_of = any_of | t
        out = F.when(any_of, name).otherwise(out)
    return out


def number(frame: Column, start: int, size: int) -> Column:
    """Unsigned big-endian number of `size` bytes from byte `start` (from 0) of a binary column."""
    return F.conv(F.hex(F.substring(frame, start + 1, size)), 16, 10).cast("long")


def dotted(frame: Column, start: int) -> Column:
    return F.concat_ws(".", *[number(frame, start + i, 1).cast("string") for i in range(4)])


#: First bytes of kinds of files, in hexadecimal.
MAGIC = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "zip": "504B0304", "gzip": "1F8B", "elf": "7F454C46", "pe": "4D5A", "rar": "526172211A07", "7z": "377ABCAF271C", "bzip2": "425A68", "class": "CAFEBABE", "wasm": "0061736D", "rtf": "7B5C727466", "ole": "D0CF11E0A1B11AE1"}


def file_kind(data: Column) -> Column:
    """Kind of a file by its first bytes; unknown without one."""
    head = F.hex(F.substring(data, 1, 8))
    return F.coalesce(*[F.when(head.startswith(m), name) for name, m in MAGIC.items()], F.lit("unknown"))
