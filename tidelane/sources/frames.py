"""Frames to header fields: link layers, tags, addresses, transports and tunnels.

`decode` adds columns to a relation with a binary column `frame`. Frames whose headers end early have nulls there and
`truncated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.scalars import once
from tidelane.functions.wire import bit, bits, cut, ipv4, mac, rest, uint
from tidelane.sources.headers import ICMP, ICMPV6, IPV4, IPV6, TCP, UDP, header_fields

#: EtherTypes, IP protocols, link types of capture files, UDP ports of tunnels.
ARP, BRIDGED, GRE = 0x0806, 0x6558, 47
ETHERNET, SLL, SLL2, RAW, LINK_V4, LINK_V6, NULL, LOOP = 1, 113, 276, (12, 14, 101), 228, 229, 0, 108
VXLAN_PORT, GTPU_PORT = 4789, 2152
BLANK_ETHERNET = "00" * 12


def normalise(frames: DataFrame, link: str = "link_type", column: str = "frame") -> DataFrame:
    """`frames` as Ethernet frames, with `direction` (inbound, outbound or null) and `supported`.

    Cooked captures, raw IP and loopback get an Ethernet header with zero addresses. Frames of other link types stay as
    they are and are not supported.
    """
    f, kind = F.col(column), F.col(link)
    by_version = F.when(bits(uint(f, 0, 1), 4, 4) == 6, "86DD").otherwise("0800")
    family = F.when(kind == LOOP, uint(f, 0, 4)).otherwise(uint(f, 0, 4, little=True))

    def ethernet(type_: Column, at: int) -> Column:
        return F.concat(F.unhex(F.concat(F.lit(BLANK_ETHERNET), type_)), rest(f, at))

    out = (
        F.when(kind == SLL, ethernet(F.hex(cut(f, 14, 2)), 16))
        .when(kind == SLL2, ethernet(F.hex(cut(f, 0, 2)), 20))
        .when(kind.isin(*RAW), ethernet(by_version, 0))
        .when(kind == LINK_V4, ethernet(F.lit("0800"), 0))
        .when(kind == LINK_V6, ethernet(F.lit("86DD"), 0))
        .when(kind.isin(NULL, LOOP), ethernet(F.when(family == 2, "0800").otherwise("86DD"), 4))
        .otherwise(f)
    )
    sent = F.when(kind == SLL, uint(f, 0, 2)).when(kind == SLL2, uint(f, 10, 1))
    direction = F.when(sent == 4, "outbound").when(sent.isNotNull(), "inbound")
    supported = kind.isin(ETHERNET, SLL, SLL2, *RAW, LINK_V4, LINK_V6, NULL, LOOP)
    return frames.select(*[c for c in frames.columns if c != column], out.alias(column), direction.alias("direction"), supported.alias("supported"))


def decode(frames: DataFrame, column: str = "frame") -> DataFrame:
    """`frames` with eth, vlans, mpls, ip, proto, src_ip, dst_ip, src_port, dst_port, tcp, icmp, arp, payload, truncated.

    Numbers and addresses are read in Arrow batches (`headers`); hardware addresses, payloads and other bytes are cut out by
    Spark where a query asks for them. Ports belong to TCP and UDP; later fragments have none. A payload ends where its packet
    does, not with the padding.
    """
    f, h = F.col(column), F.col("__h")
    out = frames.withColumn("__h", header_fields(f))
    is_ip, first = h["version"].isNotNull(), F.coalesce(h["fragment"] == 0, F.lit(False))
    is_tcp, is_icmp = first & (h["proto"] == TCP), first & h["proto"].isin(ICMP, ICMPV6)
    at, l4, end = h["at"], h["l4"], h["l4"] + h["head"]
    arp = F.struct(
        uint(f, at + 6, 2).cast("int").alias("oper"), mac(f, at + 8).alias("sender_mac"), ipv4(f, at + 14).alias("sender_ip"), mac(f, at + 18).alias("target_mac"), ipv4(f, at + 24).alias("target_ip"),
    )
    has_arp = (h["type"] == ARP) & (F.length(f) >= at + 28) & (uint(f, at, 4) == 0x00010800)
    names = F.when(h["proto"] == TCP, "tcp").when(h["proto"] == UDP, "udp").when(h["proto"] == ICMP, "icmp").when(h["proto"] == ICMPV6, "icmp6").when(is_ip, "other")
    wide = h["version"] == 6
    src, dst, size = F.when(wide, at + 8).otherwise(at + 12), F.when(wide, at + 24).otherwise(at + 16), F.when(wide, 16).otherwise(4)
    ip = F.struct(
        h["version"].alias("version"), h["src"].alias("src"), h["dst"].alias("dst"), cut(f, src, size).alias("src_bytes"), cut(f, dst, size).alias("dst_bytes"),
        *[h[c].alias(c) for c in ("proto", "ttl", "dscp", "ecn", "id", "df", "mf", "fragment", "label")], l4.alias("at"), h["end"].alias("end"),
    )
    tcp = F.struct(*[h[c].alias(c) for c in ("seq", "ack", "flags", "window", "options")])
    return out.select(
        *frames.columns,
        F.struct(mac(f, 0).alias("dst"), mac(f, 6).alias("src"), uint(f, 12, 2).cast("int").alias("type")).alias("eth"),
        h["vlans"].alias("vlans"),
        h["mpls"].alias("mpls"),
        F.when(is_ip, ip).alias("ip"),
        names.alias("proto"),
        h["src"].alias("src_ip"),
        h["dst"].alias("dst_ip"),
        h["src_port"].alias("src_port"),
        h["dst_port"].alias("dst_port"),
        F.when(is_tcp & h["seq"].isNotNull(), tcp).alias("tcp"),
        F.when(is_icmp & (F.length(f) >= l4 + 4), F.struct(uint(f, l4, 1).cast("int").alias("type"), uint(f, l4 + 1, 1).cast("int").alias("code"), rest(f, l4).alias("message"))).alias("icmp"),
        F.when(has_arp, arp).alias("arp"),
        F.when(is_ip, cut(f, end, F.greatest(h["end"] - end, F.lit(0)))).alias("payload"),
        F.coalesce(F.length(f) < F.coalesce(end, F.lit(14)), F.lit(False)).alias("truncated"),
    )


def option_value(f: Column, options: Column, kind: int, size: int) -> Column:
    """Number in a TCP option; null without it."""
    return wire.let(wire.found(options, kind), lambda o: F.when(o.isNotNull(), uint(f, o["at"], size)))


def strip_tags(frames: DataFrame, column: str = "frame") -> DataFrame:
    """`frames` without VLAN tags and MPLS labels."""
    f, h = F.col(column), F.col("__h")
    out = F.concat(cut(f, 0, 12), F.unhex(wire.hexed(h["type"], 2)), rest(f, h["at"]))
    return frames.withColumn("__h", header_fields(f)).withColumn(column, F.when(h["at"] > 14, out).otherwise(f)).drop("__h")


def with_ethernet(packet: Column) -> Column:
    """An IP packet behind an Ethernet header with zero addresses; null for what is neither IPv4 nor IPv6."""
    version = bits(uint(packet, 0, 1), 4, 4)
    type_ = F.when(version == 6, "86DD").when(version == 4, "0800")
    return F.concat(F.unhex(F.concat(F.lit(BLANK_ETHERNET), type_)), packet)


def gtp_head_of(data: bytes) -> int | None:
    """Bytes before the packet in a GTP-U message: with any of the flags 4 more, then extension headers until type 0.

    An extension header gives its own length in units of 4 bytes, and the next type in its last byte; null where one has no
    length or doesn't fit.
    """
    flags = data[0] if data else 0
    if not flags & 7:
        return 8
    if not flags & 4:
        return 12
    if len(data) < 12:
        return None
    at, kind = 12, data[11]
    while kind:
        n = 4 * data[at] if at < len(data) else 0
        if not n or at + n > len(data):
            return None
        at += n
        kind = data[at - 1]
    return at


def inner_frame(f: Column, ip: Column, src_port: Column, dst_port: Column, payload: Column) -> dict[str, Column]:
    """kind of tunnel -> (its number, frame inside), null where there is none; arguments are columns of `decode`."""
    vxlan = (dst_port == VXLAN_PORT) & (F.length(payload) > 8) & bit(uint(payload, 0, 1), 8)
    gtp = ((dst_port == GTPU_PORT) | (src_port == GTPU_PORT)) & (bits(uint(payload, 0, 1), 4, 4) == 3) & (uint(payload, 1, 1) == 255)
    # messages alone go through the walk, which is taken once for a row
    carried = once(with_ethernet(once(rest(payload, wire.by_row("int", gtp_head_of, F.when(gtp, payload))))))
    g = uint(f, ip["at"], 2)
    more = lambda mask: F.when(bit(g, mask), 4).otherwise(0)
    gre_head = 4 + more(0x8000) + more(0x2000) + more(0x1000)
    gre_type = uint(f, ip["at"] + 2, 2)
    gre_rest = rest(f, ip["at"] + gre_head)
    gre = (ip["proto"] == GRE) & (ip["fragment"] == 0)
    inside = F.when(gre_type == BRIDGED, gre_rest).when(gre_type.isin(IPV4, IPV6), with_ethernet(gre_rest))
    one = lambda number, frame: F.struct(number.alias("number"), frame.alias("frame"))
    return {
        "vxlan": F.when(vxlan, one(uint(payload, 4, 3), rest(payload, 8))),
        "gtpu": F.when(gtp & carried.isNotNull(), one(uint(payload, 4, 4), carried)),
        "gre": F.when(gre & inside.isNotNull(), one(F.when(bit(g, 0x2000), uint(f, ip["at"] + 4 + more(0x8000), 4)), inside)),
    }


def decapsulate(frames: DataFrame, kinds: tuple[str, ...] = ("vxlan", "gtpu", "gre"), column: str = "frame") -> DataFrame:
    """`frames` with the frame inside of a tunnel of these kinds in place of the outer one, tunnel and tunnel_number.

    The first kind that fits is taken; frames without a tunnel stay. Apply it again for tunnels in tunnels.
    """
    told = decode(frames.select(*frames.columns), column)
    inside = inner_frame(F.col(column), F.col("ip"), F.col("src_port"), F.col("dst_port"), F.col("payload"))
    told = told.select(*frames.columns, *[once(inside[k]).alias(f"__{k}") for k in kinds])
    kind = F.coalesce(*[F.when(F.col(f"__{k}").isNotNull(), k) for k in kinds])
    at = F.coalesce(*[F.col(f"__{k}") for k in kinds])
    return told.select(*[c for c in frames.columns if c != column], F.coalesce(at["frame"], F.col(column)).alias(column), kind.alias("tunnel"), at["number"].alias("tunnel_number"))


def layer_names(decoded: DataFrame) -> Column:
    """The layers of a decoded frame from the outside in."""
    each = [(F.lit(True), "ethernet"), (F.size("vlans") > 0, "vlan"), (F.size("mpls") > 0, "mpls"), (F.col("arp").isNotNull(), "arp"), (F.col("ip.version") == 4, "ipv4"), (F.col("ip.version") == 6, "ipv6"), (F.col("ip.fragment") > 0, "fragment"), (F.col("proto") == "tcp", "tcp"), (F.col("proto") == "udp", "udp"), (F.col("proto") == "icmp", "icmp"), (F.col("proto") == "icmp6", "icmp6"), (F.col("ip.proto") == GRE, "gre")]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in each]))


def decode_ipv4(frames: DataFrame, column: str = "frame") -> DataFrame:
    """`frames` with proto, src_ip, dst_ip, src_port, dst_port, tcp_seq, tcp_flags, payload; others than IPv4 go.

    Frames that end before their transport header count as unmatched and go, too.
    """
    found = decode(frames, column)
    wanted = F.struct("proto", "src_ip", "dst_ip", "src_port", "dst_port", F.col("tcp.seq").alias("tcp_seq"), F.col("tcp.flags").alias("tcp_flags"), "payload")
    # Not a filter, since one on decoded fields is pushed below them and decodes everything again for each field it names.
    fits = (F.col("ip.version") == 4) & ~F.col("truncated")
    return found.select(*frames.columns, F.inline(F.when(fits, F.array(wanted))))


#: Bytes of each header in a row of nprint.
NPRINT = {"eth": 14, "ipv4": 20, "tcp": 20, "udp": 8}


def nprint(decoded: DataFrame, column: str = "frame") -> DataFrame:
    """`decoded` with nprint: 496 numbers for the bits of Ethernet, IPv4, TCP and UDP headers; -1 where there is none."""
    f, ip = F.col(column), F.col("ip")
    v4 = F.coalesce(ip["version"] == 4, F.lit(False))
    at = {"eth": (F.length(f) >= 14, F.lit(0)), "ipv4": (v4, ip["at"] - 20), "tcp": (F.col("tcp").isNotNull() & v4, ip["at"]), "udp": ((F.col("proto") == "udp") & v4, ip["at"])}

    def row(name: str) -> Column:
        there, start = at[name]
        bytes_ = F.transform(F.sequence(F.lit(0), F.lit(NPRINT[name] - 1)), lambda i: F.lpad(F.bin(F.coalesce(uint(f, start + i, 1), F.lit(0))), 8, "0"))
        ones = F.transform(F.filter(F.split(F.array_join(bytes_, ""), ""), lambda c: c != ""), lambda c: c.cast("tinyint"))
        return F.when(F.coalesce(there, F.lit(False)), ones).otherwise(F.array_repeat(F.lit(-1).cast("tinyint"), 8 * NPRINT[name]))

    return decoded.withColumn("nprint", F.concat(*[row(n) for n in NPRINT]))


#: Names of TCP options in signatures.
OPTION_NAMES = {0: "eol", 1: "nop", 2: "mss", 3: "ws", 4: "sok", 5: "sack", 8: "ts"}


def first_ttl(ttl: Column) -> Column:
    """The least usual first value that isn't below a TTL."""
    return F.when(ttl <= 32, 32).when(ttl <= 64, 64).when(ttl <= 128, 128).otherwise(255)


def syn_signature(f: Column, ip: Column, tcp: Column) -> Column:
    """version:first ttl:length of IP options:mss:window,scale:options:quirks:payload class of a SYN."""
    options = tcp["options"]
    names = F.create_map(*[F.lit(x) for p in OPTION_NAMES.items() for x in p])
    layout = F.array_join(F.transform(options, lambda o: F.coalesce(F.try_element_at(names, o["kind"].cast("int")), F.concat(F.lit("?"), o["kind"].cast("string")))), ",")
    quirks = F.array_join(F.array_compact(F.array(F.when(ip["df"], "df"), F.when(ip["df"] & (ip["id"] > 0), "id+"), F.when(~ip["df"] & (ip["id"] == 0), "id-"), F.when(ip["ecn"] > 0, "ecn"), F.when(tcp["seq"] == 0, "seq-"))), ",")
    olen = F.when(ip["version"] == 4, ip["at"] - 34).otherwise(0)
    scale = F.coalesce(option_value(f, options, 3, 1), F.lit(0))
    mss = F.coalesce(option_value(f, options, 2, 2).cast("string"), F.lit("*"))
    return F.concat_ws(":", ip["version"].cast("string"), first_ttl(ip["ttl"]).cast("string"), olen.cast("string"), mss, F.concat_ws(",", tcp["window"].cast("string"), scale.cast("string")), layout, quirks, F.lit("0"))
