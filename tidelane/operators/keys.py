"""Flow keys out of decoded frames, and what can be told from a key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.scalars import address_hex, let, once
from tidelane.functions.wire import hexed


def endpoint(bytes_: Column, ip: Column, port: Column) -> Column:
    """Ordered by address octets, IPv4 before IPv6, then by port."""
    return F.struct(F.length(bytes_).alias("size"), bytes_.alias("bytes"), port.alias("port"), ip.alias("ip"))


def five_tuple(decoded: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Decoded frames with key (proto, a_ip, a_port, b_ip, b_port) and forward: whether the sender is endpoint a.

    bidirectional: a is the smaller endpoint, so both directions have one key; else a is the sender. Frames without an
    IP header have no key and are left out.
    """
    src = endpoint(F.col("ip.src_bytes"), F.col("src_ip"), F.coalesce("src_port", F.lit(0)))
    dst = endpoint(F.col("ip.dst_bytes"), F.col("dst_ip"), F.coalesce("dst_port", F.lit(0)))
    forward = (src <= dst) if bidirectional else F.lit(True)
    out = decoded.withColumn("__f", once(forward)).withColumn("__a", once(F.when(F.col("__f"), src).otherwise(dst))).withColumn("__b", once(F.when(F.col("__f"), dst).otherwise(src)))
    key = F.struct("proto", F.col("__a.ip").alias("a_ip"), F.col("__a.port").alias("a_port"), F.col("__b.ip").alias("b_ip"), F.col("__b.port").alias("b_port"))
    # Not a filter: see decode_ipv4.
    return out.select(*decoded.columns, F.inline(F.when(F.col("ip").isNotNull(), F.array(F.struct(key.alias("key"), F.col("__f").alias("forward"))))))


def ip_pair(decoded: DataFrame) -> DataFrame:
    """Decoded frames with key (a, b): both addresses, the smaller first."""
    src, dst = (F.struct(F.length(f"ip.{s}_bytes").alias("size"), F.col(f"ip.{s}_bytes").alias("bytes"), F.col(f"{s}_ip").alias("ip")) for s in ("src", "dst"))
    return decoded.filter(F.col("ip").isNotNull()).withColumn("key", once(F.struct(F.least(src, dst)["ip"].alias("a"), F.greatest(src, dst)["ip"].alias("b"))))


def mac_pair(decoded: DataFrame) -> DataFrame:
    """Decoded frames with key (a, b): both hardware addresses, the smaller first."""
    return decoded.withColumn("key", F.struct(F.least("eth.src", "eth.dst").alias("a"), F.greatest("eth.src", "eth.dst").alias("b")))


def tagged(keyed: DataFrame, tag: Column) -> DataFrame:
    """`keyed` with the tag (a tenant, a VLAN, an interface) as part of the key."""
    return keyed.withColumn("key", F.struct(tag.alias("tag"), F.col("key").alias("key")))


def with_flow_label(keyed: DataFrame) -> DataFrame:
    """`keyed` with the flow label of IPv6 as part of the key; 0 for IPv4."""
    return tagged(keyed, F.coalesce("ip.label", F.lit(0)))


def canonical(proto: Column, a_ip: Column, a_port: Column, b_ip: Column, b_port: Column) -> Column:
    """A key of addresses as text with its smaller endpoint first: by octets, IPv4 before IPv6, then by port."""
    order = lambda ip, port: let(address_hex(ip), lambda h: F.struct(F.length(h).alias("size"), h.alias("ip"), port.alias("port")))
    pick = lambda swap, x, y: F.when(swap, y).otherwise(x)
    return let(order(a_ip, a_port) > order(b_ip, b_port), lambda s: F.struct(proto.alias("proto"), pick(s, a_ip, b_ip).alias("a_ip"), pick(s, a_port, b_port).alias("a_port"), pick(s, b_ip, a_ip).alias("b_ip"), pick(s, b_port, a_port).alias("b_port")))


def directed(key: Column, forward: Column) -> Column:
    """The key as (src_ip, src_port, dst_ip, dst_port): from endpoint a if forward, else from endpoint b."""
    pick = lambda x, y: F.when(forward, key[x]).otherwise(key[y])
    return F.struct(pick("a_ip", "b_ip").alias("src_ip"), pick("a_port", "b_port").alias("src_port"), pick("b_ip", "a_ip").alias("dst_ip"), pick("b_port", "a_port").alias("dst_port"))


def fnv1a(data: Column) -> Column:
    """FNV-1a of 64 bits over a binary column as 16 hexadecimal digits.

    Products are taken in halves of 32 bits, so nothing overflows.
    """
    low = (1 << 32) - 1
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    # each byte is a character, and its code the number
    bytes_ = F.filter(F.split(F.decode(F.coalesce(data, F.lit(b"")), "ISO-8859-1"), ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        x = s["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        product = x * 0x1B3
        hi = (s["hi"] * 0x1B3 + F.shiftright(product, 32) + x.bitwiseAND(F.lit((1 << 24) - 1)) * 256).bitwiseAND(F.lit(low))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    return F.aggregate(bytes_, start, step, lambda s: F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0")))


def stable_hash(key: Column) -> Column:
    """FNV-1a over the protocol's name and both endpoints of a canonical key, IPv4 or IPv6, as 16 hexadecimal digits."""
    # the key is named once, or it would be made again for each of its fields
    data = let(key, lambda k: F.unhex(F.concat(F.hex(k["proto"].cast("binary")), address_hex(k["a_ip"]), hexed(k["a_port"], 2), address_hex(k["b_ip"]), hexed(k["b_port"], 2))))
    return let(data, fnv1a)


def shard_index(hash_: Column, n: int) -> Column:
    """The hash modulo n; 0 for n = 0."""
    if not n:
        return F.lit(0).cast("bigint")
    half = lambda at: F.conv(F.substring(hash_, at, 8), 16, 10).cast("bigint")
    return ((half(1) % n) * ((1 << 32) % n) + half(9) % n) % n


def mac_kind(mac: Column) -> Column:
    """struct<broadcast, multicast, local>: what the first byte of a hardware address says."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")
    return let(first, lambda b: F.struct((mac == "ff:ff:ff:ff:ff:ff").alias("broadcast"), (b.bitwiseAND(F.lit(1)) > 0).alias("multicast"), (b.bitwiseAND(F.lit(2)) > 0).alias("local")))


#: Names of well-known ports by transport.
WELL_KNOWN = {
    "tcp": {20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 88: "kerberos", 110: "pop3", 143: "imap", 179: "bgp", 389: "ldap", 443: "https", 445: "smb", 502: "modbus", 587: "submission", 636: "ldaps", 853: "dot", 993: "imaps", 995: "pop3s", 1433: "mssql", 1883: "mqtt", 3306: "mysql", 3389: "rdp", 5432: "postgres", 6379: "redis", 8080: "http-alt", 20000: "dnp3"},
    "udp": {53: "dns", 67: "dhcp", 68: "dhcp", 69: "tftp", 88: "kerberos", 123: "ntp", 137: "netbios-ns", 161: "snmp", 162: "snmp-trap", 443: "quic", 500: "ike", 514: "syslog", 1812: "radius", 1813: "radius-acct", 1900: "ssdp", 2152: "gtp-u", 3478: "stun", 4789: "vxlan", 5353: "mdns", 51820: "wireguard"},
}


def labels(spark, own: dict[tuple[str, int], str | None] | None = None, standalone: bool = False) -> DataFrame:
    """(transport, port, label): the well-known ports with `own` entries over them (None removes one), or those alone."""
    table = {} if standalone else {(t, p): n for t, ports in WELL_KNOWN.items() for p, n in ports.items()}
    table |= own or {}
    return spark.createDataFrame([(t, p, n) for (t, p), n in table.items() if n], "transport string, port int, label string")


def labelled(flows: DataFrame, table: DataFrame, transport: str = "proto", ports: tuple[str, str] = ("src_port", "dst_port")) -> DataFrame:
    """`flows` with label: that of the lower port, else of the higher one. The table is a dimension of a few hundred rows."""
    out = flows.withColumn("__lo", F.least(*ports)).withColumn("__hi", F.greatest(*ports))
    for side in ("lo", "hi"):
        names = F.broadcast(table.select(F.col("transport").alias(f"__{side}_t"), F.col("port").alias(f"__{side}_p"), F.col("label").alias(f"__{side}_label")))
        out = out.join(names, (F.col(transport) == F.col(f"__{side}_t")) & (F.col(f"__{side}") == F.col(f"__{side}_p")), "left")
    return out.withColumn("label", F.coalesce("__lo_label", "__hi_label")).select(*flows.columns, "label")


#: Names that application protocols have in a TLS hello, and hosts known to resolve names over HTTPS.
ALPN = {"h2": "http", "http/1.1": "http", "http/1.0": "http", "h3": "http3", "dot": "dot", "doq": "doq", "imap": "imap", "smtp": "smtp", "mqtt": "mqtt"}
RESOLVERS = ("dns.google", "cloudflare-dns.com", "dns.quad9.net", "doh.opendns.com")


def application(alpn: Column, sni: Column, transport: Column, port: Column) -> Column:
    """The first known ALPN name; port 853 is encrypted DNS, and HTTP to a known resolver is DNS over HTTPS."""
    names = F.create_map(*[F.lit(x) for pair in ALPN.items() for x in pair])
    known = F.get(F.filter(F.transform(alpn, lambda a: F.try_element_at(names, a)), lambda n: n.isNotNull()), F.lit(0))
    return let(known, lambda k: F.when((port == 853) & ~F.coalesce(k.isin("dot", "doq"), F.lit(False)), F.when(transport == "udp", "doq").otherwise("dot")).when(k.isin("http", "http3") & F.lower(sni).isin(*RESOLVERS), "doh").otherwise(k))
