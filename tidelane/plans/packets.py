"""Queries over frames. Frames are put together out of the event table, so its columns are what decoders have to give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions import scalars, wire
from tidelane.functions.wire import frame_of, hexed
from tidelane.operators import keys
from tidelane.plans.registry import query
from tidelane.sources import frames

ETHERNET = "000000000001" + "000000000002"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def low_address() -> Column:
    """10.0.x.y of the user, in hexadecimal."""
    return F.concat(F.lit("0A00"), hexed(F.floor(F.col("user_id") / 256) % 256, 1), hexed(F.col("user_id") % 256, 1))


def ipv4(proto: int, body: Column, src: Column | None = None, dst: str | Column = "C0A80001", flags: str | Column = "0000", tos: str = "00", ident: str | Column = "0000", ttl: str = "40") -> Column:
    dst = F.lit(dst) if isinstance(dst, str) else dst
    parts = [x if isinstance(x, Column) else F.lit(x) for x in ("45" + tos, hexed(20 + F.length(body) / 2, 2), ident, flags, f"{ttl}{proto:02X}0000", src if src is not None else low_address(), dst, body)]
    return F.concat(*parts)


def source_port() -> Column:
    return 1024 + F.col("event_id") % 60000


def udp(body: Column, port: str = "0035") -> Column:
    return F.concat(hexed(source_port(), 2), F.lit(port), hexed(8 + F.length(body) / 2, 2), F.lit("0000"), body)


def said() -> Column:
    return wire.text_hex(F.col("event_type"))


#: The addresses and ports of these frames, in SQL.
SRC = "'10.0.' || (user_id // 256) % 256 || '.' || user_id % 256"
PORT = "CAST(1024 + event_id % 60000 AS INTEGER)"


def plain_udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "0800", ipv4(17, udp(said()))))


@query(f"SELECT event_id, CAST(user_id % 4096 AS BIGINT) AS vid, CAST(event_id % 8 AS BIGINT) AS pcp, 7 AS outer_vid, {SRC} AS src_ip, {PORT} AS src_port, event_type AS payload FROM events")
def decode_vlan(spark, sf_dir):
    """Two VLAN tags before IPv4."""
    tci = F.col("user_id") % 4096 + (F.col("event_id") % 8) * 8192
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "88A8", "0007", "8100", hexed(tci, 2), "0800", ipv4(17, udp(said()))))
    return frames.decode(f).select("event_id", F.col("vlans")[1]["vid"].alias("vid"), F.col("vlans")[1]["pcp"].alias("pcp"), F.col("vlans")[0]["vid"].cast("int").alias("outer_vid"), "src_ip", "src_port", F.col("payload").cast("string").alias("payload"))


@query(f"SELECT event_id, CAST(user_id % 1048576 AS BIGINT) AS label, 2 AS depth, {SRC} AS src_ip, 53 AS dst_port FROM events")
def decode_mpls(spark, sf_dir):
    """Two labels before IPv4, the second at the bottom of the stack."""
    label = (F.col("user_id") % 1048576) * 4096 + 0x1FF
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "8847", "000100FF", hexed(label, 4), ipv4(17, udp(said()))))
    return frames.decode(f).select("event_id", F.col("mpls")[1]["label"].alias("label"), F.size("mpls").alias("depth"), "src_ip", "dst_port")


@query(f"SELECT event_id, '2001:db8::' || printf('%x', user_id % 65535 + 1) AS src_ip, 'fe80::1:0:0:2' AS dst_ip, CAST(event_id % 1048576 AS BIGINT) AS label, 'udp' AS proto, {PORT} AS src_port, CAST(64 AS BIGINT) AS ttl, event_type AS payload FROM events")
def decode_ipv6(spark, sf_dir):
    """IPv6 with a hop-by-hop header before UDP."""
    body = F.concat(F.lit("1100010400000000"), udp(said()))
    head = F.concat(hexed(F.lit(6 << 28).cast("long") + F.col("event_id") % 1048576, 4), hexed(F.length(body) / 2, 2), F.lit("0040"), F.lit("20010DB8" + "00" * 10), hexed(F.col("user_id") % 65535 + 1, 2), F.lit("FE80000000000000" + "0001000000000002"))
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "86DD", head, body))
    return frames.decode(f).select("event_id", "src_ip", "dst_ip", F.col("ip.label").alias("label"), "proto", "src_port", F.col("ip.ttl").alias("ttl"), F.col("payload").cast("string").alias("payload"))


@query(f"SELECT event_id, {PORT} AS src_port, CAST(event_id * 7919 % 4294967296 AS BIGINT) AS tcp_seq, CAST(user_id AS BIGINT) AS ack, CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 ELSE 24 END AS flags, CAST(user_id % 65536 AS INTEGER) AS win, CAST(1460 AS BIGINT) AS mss, CAST(event_id % 15 AS BIGINT) AS scale, '2,1,3' AS kinds, event_type AS payload FROM events")
def decode_tcp(spark, sf_dir):
    """TCP with options: largest segment, padding, window scale."""
    flags = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 16).otherwise(24)
    head = F.concat(hexed(source_port(), 2), F.lit("0050"), hexed(F.col("event_id") * 7919 % (1 << 32), 4), hexed(F.col("user_id"), 4), F.lit("70"), hexed(flags, 1), hexed(F.col("user_id") % 65536, 2), F.lit("00000000"), F.lit("020405B4" + "01" + "0303"), hexed(F.col("event_id") % 15, 1))
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "0800", ipv4(6, F.concat(head, said()))))
    d, opts = frames.decode(f), F.col("tcp.options")
    return d.select("event_id", "src_port", F.col("tcp.seq").alias("tcp_seq"), F.col("tcp.ack").alias("ack"), F.col("tcp.flags").alias("flags"), F.col("tcp.window").alias("win"), frames.option_value(F.col("frame"), opts, 2, 2).alias("mss"), frames.option_value(F.col("frame"), opts, 3, 1).alias("scale"), F.array_join(F.transform(opts, lambda o: o["kind"].cast("string")), ",").alias("kinds"), F.col("payload").cast("string").alias("payload"))


@query("SELECT event_id, CAST(46 AS BIGINT) AS dscp, CAST(1 AS BIGINT) AS ecn, CAST(user_id % 65536 AS BIGINT) AS id, event_id % 2 = 1 AS mf, CAST(event_id % 100 * 8 AS BIGINT) AS frag_at, CASE WHEN event_id % 100 = 0 THEN 53 END AS dst_port FROM events")
def decode_fragment_fields(spark, sf_dir):
    """Service bits, identification and fragment offsets; later fragments have no ports."""
    word = (F.col("event_id") % 2) * 0x2000 + F.col("event_id") % 100
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "0800", ipv4(17, udp(said()), flags=hexed(word, 2), tos="B9", ident=hexed(F.col("user_id") % 65536, 2))))
    return frames.decode(f).select("event_id", F.col("ip.dscp").alias("dscp"), F.col("ip.ecn").alias("ecn"), F.col("ip.id").alias("id"), F.col("ip.mf").alias("mf"), F.col("ip.fragment").alias("frag_at"), "dst_port")


def tunnelled(spark, sf_dir, kind: str) -> DataFrame:
    inner = ipv4(17, udp(said()))
    number = F.col("user_id") % 65536
    # a sequence number alone, or one of 4 bytes and one of 8 in front of the packet
    extended = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "00070000").when(F.col("event_id") % 4 == 2, "00000085" + "01001E00").otherwise("00000085" + "01001EC0" + "02AAAAAAAAAAAA00")
    body = {
        "vxlan": lambda: ipv4(17, F.concat(F.lit("C00012B5"), F.lit("0000" * 2), F.lit("0800000000"), hexed(number, 2), F.lit("00"), F.lit(ETHERNET + "0800"), inner), src=F.lit("AC100001")),
        "gtpu": lambda: ipv4(17, F.concat(F.when(F.col("event_id") % 2 == 0, "08689C40").otherwise("9C400868"), F.lit("00000000"), F.when(F.col("event_id") % 4 == 0, "30").when(F.col("event_id") % 4 == 1, "32").otherwise("34"), F.lit("FF0000"), hexed(number, 4), extended, inner), src=F.lit("AC100001")),
        "gre": lambda: ipv4(47, F.concat(F.lit("20000800"), hexed(number, 4), inner), src=F.lit("AC100001")),
    }[kind]()
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "0800", body))
    out = frames.decode(frames.decapsulate(f))
    return out.select("event_id", "tunnel", F.when(F.col("tunnel") == "vxlan", F.floor(F.col("tunnel_number"))).otherwise(F.col("tunnel_number")).cast("long").alias("number"), "src_ip", "src_port", F.col("payload").cast("string").alias("payload"))


def tunnel_sql(kind: str) -> str:
    return f"SELECT event_id, '{kind}' AS tunnel, CAST(user_id % 65536 AS BIGINT) AS number, {SRC} AS src_ip, {PORT} AS src_port, event_type AS payload FROM events"


@query(tunnel_sql("vxlan"))
def decap_vxlan(spark, sf_dir):
    return tunnelled(spark, sf_dir, "vxlan")


@query(tunnel_sql("gtpu"))
def decap_gtpu(spark, sf_dir):
    return tunnelled(spark, sf_dir, "gtpu")


@query(tunnel_sql("gre"))
def decap_gre(spark, sf_dir):
    return tunnelled(spark, sf_dir, "gre")


@query(f"SELECT event_id, 0 AS n_tags, {SRC} AS src_ip, CAST(NULL AS VARCHAR) AS tunnel FROM events")
def decap_tags(spark, sf_dir):
    """VLAN tags and MPLS labels stripped; what is no tunnel stays as it is."""
    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "8100", "0007", "8847", "000101FF", ipv4(17, udp(said()))))
    out = frames.decode(frames.decapsulate(frames.strip_tags(f)))
    return out.select("event_id", (F.size("vlans") + F.size("mpls")).alias("n_tags"), "src_ip", "tunnel")


@query(f"SELECT event_id, {SRC} AS src_ip, CASE event_id % 5 WHEN 0 THEN 'outbound' WHEN 1 THEN 'inbound' END AS direction, event_id % 5 < 4 AS supported FROM events WHERE event_id % 5 < 4")
def link_types(spark, sf_dir):
    """Cooked, raw and loopback frames as Ethernet; one link type that isn't supported has no address to decode."""
    packet, n = ipv4(17, udp(said())), F.col("event_id") % 5
    frame = F.when(n == 0, F.concat(F.lit("0004000100060000000000010000" + "0800"), packet)).when(n == 1, F.concat(F.lit("0800" + "0000000000010001" + "0006" + "0000000000010000"), packet)).when(n == 2, packet).when(n == 3, F.concat(F.lit("02000000"), packet)).otherwise(F.lit("00"))
    kind = F.when(n == 0, 113).when(n == 1, 276).when(n == 2, 101).when(n == 3, 0).otherwise(999)
    f = events(spark, sf_dir).select("event_id", kind.alias("link_type"), F.unhex(frame).alias("frame"))
    return frames.decode(frames.normalise(f)).filter("supported").select("event_id", "src_ip", "direction", "supported")


@query("SELECT event_id, 1 AS oper, '00:00:00:00:00:02' AS sender_mac, '10.0.' || (user_id // 256) % 256 || '.' || user_id % 256 AS sender_ip, '10.0.0.1' AS target_ip, (user_id // 256) % 256 = 0 AND user_id % 256 = 1 AS gratuitous FROM events")
def arp_messages(spark, sf_dir):
    from tidelane.parsers.link import arp_flags

    f = events(spark, sf_dir).withColumn("frame", frame_of(ETHERNET, "0806", "0001080006040001", "000000000002", low_address(), "000000000000", "0A000001"))
    return frames.decode(f).select("event_id", F.col("arp.oper").alias("oper"), F.col("arp.sender_mac").alias("sender_mac"), F.col("arp.sender_ip").alias("sender_ip"), F.col("arp.target_ip").alias("target_ip"), arp_flags(F.col("arp"))["gratuitous"].alias("gratuitous"))


def both_ways(spark, sf_dir) -> DataFrame:
    """Frames from users to a server (even events) and back (odd ones); the server's address lies between the users'."""
    there, back = ipv4(17, F.concat(hexed(source_port(), 2), F.lit("0035000C0000"), F.lit("00000000")), dst="0A000064"), ipv4(17, F.concat(F.lit("0035"), hexed(source_port(), 2), F.lit("000C0000"), F.lit("00000000")), src=F.lit("0A000064"), dst=low_address())
    return events(spark, sf_dir).withColumn("frame", frame_of("02" + ETHERNET[2:], "0800", F.when(F.col("event_id") % 2 == 0, there).otherwise(back)))


#: Endpoints of both_ways in SQL: n numbers the user's address, s says that the user is the smaller endpoint, f that a sends.
WAYS = f"w AS (SELECT event_id, {SRC} AS u, {PORT} AS p, (user_id % 65536, 1024 + event_id % 60000) <= (100, 53) AS s, (event_id % 2 = 0) AS t FROM events)"


@query(f"WITH {WAYS} SELECT event_id, 'udp' AS proto, CASE WHEN s THEN u ELSE '10.0.0.100' END AS a_ip, CASE WHEN s THEN p ELSE 53 END AS a_port, CASE WHEN s THEN '10.0.0.100' ELSE u END AS b_ip, CASE WHEN s THEN 53 ELSE p END AS b_port, s = t AS forward FROM w")
def five_tuple_keys(spark, sf_dir):
    return keys.five_tuple(frames.decode(both_ways(spark, sf_dir))).select("event_id", "key.*", "forward")


@query(f"WITH {WAYS} SELECT event_id, u AS src_ip, p AS src_port, '10.0.0.100' AS dst_ip, 53 AS dst_port FROM w")
def directed_keys(spark, sf_dir):
    """Keys turned so that the user, who began, is the source."""
    k = keys.five_tuple(frames.decode(both_ways(spark, sf_dir)))
    begun = F.col("forward") == (F.col("event_id") % 2 == 0)
    return k.withColumn("d", keys.directed(F.col("key"), begun)).select("event_id", "d.*")


@query(f"WITH {WAYS}, x AS (SELECT *, list_transform(string_split(u, '.'), lambda y: CAST(y AS INTEGER)) <= [10, 0, 0, 100] AS l FROM w) SELECT event_id, CASE WHEN l THEN u ELSE '10.0.0.100' END AS ip_a, CASE WHEN l THEN '10.0.0.100' ELSE u END AS ip_b, '00:00:00:00:00:02' AS mac_a, '02:00:00:00:00:01' AS mac_b FROM x")
def pair_keys(spark, sf_dir):
    d = frames.decode(both_ways(spark, sf_dir))
    return keys.mac_pair(keys.ip_pair(d).withColumnRenamed("key", "ips")).select("event_id", F.col("ips.a").alias("ip_a"), F.col("ips.b").alias("ip_b"), F.col("key.a").alias("mac_a"), F.col("key.b").alias("mac_b"))


@query(f"WITH {WAYS} SELECT event_id, CAST(event_id % 3 AS BIGINT) AS tag, CAST(0 AS BIGINT) AS label, CASE WHEN s THEN u ELSE '10.0.0.100' END AS a_ip FROM w")
def tagged_keys(spark, sf_dir):
    """Keys with a tenant, and with the flow label, which IPv4 doesn't have."""
    k = keys.with_flow_label(keys.five_tuple(frames.decode(both_ways(spark, sf_dir))))
    return keys.tagged(k, F.col("event_id") % 3).select("event_id", F.col("key.tag").alias("tag"), F.col("key.key.tag").alias("label"), F.col("key.key.key.a_ip").alias("a_ip"))


@query("""WITH t AS (SELECT event_id, 'udp' AS proto, [10, 0, 0, 1, (1024 + event_id % 60000) // 256, (1024 + event_id % 60000) % 256, 10, 1, (user_id // 256) % 256, user_id % 256, 0, 53] AS rest FROM events), b AS (SELECT event_id, list_concat([117, 100, 112], rest) AS bytes FROM t),
h AS (SELECT event_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(bytes, lambda x: x::HUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM b) SELECT event_id, printf('%016X', h::UBIGINT) AS hash, CAST(h % 16 AS BIGINT) AS shard FROM h""")
def stable_hashes(spark, sf_dir):
    b = F.concat_ws(".", F.lit("10.1"), (F.floor(F.col("user_id") / 256) % 256).cast("string"), (F.col("user_id") % 256).cast("string"))
    key = keys.canonical(F.lit("udp"), b, F.lit(53).cast("long"), F.lit("10.0.0.1"), source_port())
    out = events(spark, sf_dir).select("event_id", keys.stable_hash(key).alias("hash"))
    return out.withColumn("shard", keys.shard_index(F.col("hash"), 16))


#: Endpoints of IPv6 in SQL: in hexadecimal, with the port behind the address.
SIX = "s AS (SELECT event_id, '20010DB8' || repeat('0', 20) || printf('%04X', user_id % 65535 + 1) AS a, printf('%04X', 1024 + event_id % 60000) AS p, CASE WHEN event_id % 2 = 0 THEN '20010DB8' || repeat('0', 20) || '0064' ELSE repeat('0', 20) || 'FFFF0A000001' END AS b FROM events), o AS (SELECT *, a || p <= b || '0035' AS f FROM s)"


def six_key() -> Column:
    """The key of a user's IPv6 address and a server's, which is mapped IPv4 in odd events."""
    user = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("user_id") % 65535 + 1)))
    server = F.when(F.col("event_id") % 2 == 0, "2001:DB8:0:0::64").otherwise("::ffff:10.0.0.1")
    return keys.canonical(F.lit("udp"), server, F.lit(53).cast("long"), user, source_port())


@query(f"WITH {SIX} SELECT event_id, CASE WHEN f THEN p ELSE '0035' END AS a_port, '1:' || to_base64(unhex(sha1(unhex('0000' || least(a, b) || greatest(a, b) || '1100' || CASE WHEN f THEN p || '0035' ELSE '0035' || p END)))) AS community_id FROM o")
def community_ids_six(spark, sf_dir):
    """Keys and Community IDs of IPv6, shortened and mapped addresses included."""
    k = events(spark, sf_dir).select("event_id", six_key().alias("k"))
    return k.select("event_id", hexed(F.col("k.a_port"), 2).alias("a_port"), scalars.community_id(F.lit(17), F.col("k.a_ip"), F.col("k.a_port"), F.col("k.b_ip"), F.col("k.b_port")).alias("community_id"))


@query(f"""WITH {SIX}, t AS (SELECT event_id, '756470' || CASE WHEN f THEN a || p || b || '0035' ELSE b || '0035' || a || p END AS h FROM o), y AS (SELECT event_id, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substring(h, i, 2) AS HUGEINT)) AS bytes FROM t)
SELECT event_id, printf('%016X', list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS hash FROM y""")
def stable_hashes_six(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", keys.stable_hash(six_key()).alias("hash"))


#: Values of events as ports, in SQL and as columns.
def ports(ev: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(p) for p in (53, 80, 123, 443, 8080, 20000, 40001, 50001)])
    pick = lambda c, k: F.element_at(known, (c % k + 1).cast("int"))
    return ev.withColumn("src_port", pick(F.col("event_id"), 8)).withColumn("dst_port", pick(F.col("user_id"), 7)).withColumn("proto", F.when(F.col("event_id") % 2 == 0, "tcp").otherwise("udp"))


PORTS = "p AS (SELECT event_id, [53, 80, 123, 443, 8080, 20000, 40001, 50001][event_id % 8 + 1] AS a, [53, 80, 123, 443, 8080, 20000, 40001, 50001][user_id % 7 + 1] AS b, CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto FROM events)"
LABELS = "l(t, p, n) AS (VALUES ('tcp', 53, 'dns'), ('tcp', 80, 'http'), ('tcp', 443, 'https'), ('tcp', 8080, 'http-alt'), ('tcp', 20000, 'dnp3'), ('udp', 53, 'dns'), ('udp', 123, 'ntp'), ('udp', 443, 'quic'))"


@query(f"WITH {PORTS}, {LABELS} SELECT event_id, coalesce(x.n, y.n) AS label FROM p LEFT JOIN l x ON x.t = proto AND x.p = least(a, b) LEFT JOIN l y ON y.t = proto AND y.p = greatest(a, b)")
def well_known_labels(spark, sf_dir):
    return keys.labelled(ports(events(spark, sf_dir)), keys.labels(spark)).select("event_id", "label")


@query(f"WITH {PORTS}, {LABELS}, o AS (SELECT * FROM l WHERE (t, p) NOT IN (('tcp', 80), ('udp', 53)) UNION ALL SELECT 'tcp', 80, 'intranet' UNION ALL SELECT 'tcp', 40001, 'game') SELECT event_id, coalesce(x.n, y.n) AS label FROM p LEFT JOIN o x ON x.t = proto AND x.p = least(a, b) LEFT JOIN o y ON y.t = proto AND y.p = greatest(a, b)")
def custom_labels(spark, sf_dir):
    """A label changed, one added and one removed."""
    own = {("tcp", 80): "intranet", ("tcp", 40001): "game", ("udp", 53): None}
    return keys.labelled(ports(events(spark, sf_dir)), keys.labels(spark, own)).select("event_id", "label")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'doh' ELSE 'http' END WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'dot' END WHEN 'signup' THEN 'doq' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'dot' ELSE 'imap' END ELSE CASE WHEN event_id % 3 = 0 THEN 'dot' END END AS app FROM events WHERE NOT (event_type = 'click' AND event_id % 3 = 0)""")
def app_protocols(spark, sf_dir):
    kind = F.col("event_type")
    alpn = F.when(kind == "click", F.array(F.lit("x"), F.lit("h2"))).when(kind == "signup", F.array(F.lit("doq"))).when(kind == "purchase", F.array(F.lit("imap"))).otherwise(F.array(F.lit("unknown")))
    ev = events(spark, sf_dir).filter("not (event_type = 'click' and event_id % 3 = 0)").withColumn("sni", F.when(F.col("user_id") % 2 == 0, "DNS.google").otherwise("example.org")).withColumn("port", F.when(F.col("event_id") % 3 == 0, 853).otherwise(443))
    return ev.select("event_id", keys.application(alpn, F.col("sni"), F.lit("tcp"), F.col("port")).alias("app"))


@query("SELECT event_id, user_id % 4 = 3 AS broadcast, user_id % 4 IN (1, 3) AS multicast, user_id % 4 IN (2, 3) AS local FROM events")
def mac_kinds(spark, sf_dir):
    mac = F.when(F.col("user_id") % 4 == 3, "ff:ff:ff:ff:ff:ff").otherwise(F.concat(F.lit("0"), (F.col("user_id") % 4).cast("string"), F.lit(":00:00:00:00:01")))
    return events(spark, sf_dir).select("event_id", keys.mac_kind(mac).alias("k")).select("event_id", "k.*")


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ethernet,vlan,ipv4,udp' ELSE 'ethernet,ipv4,gre' END AS layers FROM events")
def layer_walk(spark, sf_dir):
    f = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(ETHERNET + "81000007" + "0800"), ipv4(17, udp(said())))).otherwise(F.concat(F.lit(ETHERNET + "0800"), ipv4(47, F.lit("00000800"))))
    d = frames.decode(events(spark, sf_dir).select("event_id", F.unhex(f).alias("frame")))
    return d.select("event_id", F.array_join(frames.layer_names(d), ",").alias("layers"))


@query(f"""WITH t AS (SELECT event_id, printf('%02X%02X', (user_id // 256) % 256, user_id % 256) AS u, printf('%04X', 1024 + event_id % 60000) AS p, length(event_type) AS n FROM events),
h AS (SELECT event_id, '0000000000010000000000020800' AS e, '4500' || printf('%04X', 28 + n) || '000000004011' || '00000A00' || u || 'C0A80001' AS i, p || '0035' || printf('%04X', 8 + n) || '0000' AS d FROM t)
SELECT event_id, CAST(unhex(e || i) AS BIT)::VARCHAR || repeat('x', 160) || CAST(unhex(d) AS BIT)::VARCHAR AS bits FROM h""")
def nprint_rows(spark, sf_dir):
    rows = frames.nprint(frames.decode(plain_udp(spark, sf_dir)))
    return rows.select("event_id", F.array_join(F.transform("nprint", lambda b: F.when(b < 0, "x").otherwise(b.cast("string"))), "").alias("bits"))
