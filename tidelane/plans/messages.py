"""Queries over application messages. Payloads are put together out of table columns, which parsers have to give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions import scalars
from tidelane.functions.scalars import once
from tidelane.functions.wire import ber_tree, frame_of, hexed, text_hex
from tidelane.parsers import enterprise, link, names, web
from tidelane.plans.packets import SRC, events, low_address
from tidelane.plans.registry import query

EID, USER = F.col, F.col


def h(value: Column | int, size: int) -> Column:
    return hexed(F.lit(value) if isinstance(value, int) else value, size)


def n(hex_: Column) -> Column:
    """Bytes of a hexadecimal text."""
    return (F.length(hex_) / 2).cast("long")


def made(spark, sf_dir, *parts: Column | str) -> DataFrame:
    """Events with `payload`."""
    return events(spark, sf_dir).withColumn("payload", frame_of(*parts))


def trees(frame: DataFrame) -> DataFrame:
    """The elements of each payload beside it."""
    return frame.withColumn("tree", ber_tree(F.col("payload")))


def fields(frame: DataFrame, message: Column, **columns: str) -> DataFrame:
    """event_id and fields of a message under names of their own."""
    out = frame.select("event_id", message.alias("m"))
    return out.select("event_id", *[F.expr(c).alias(a) for a, c in columns.items()])


def tlv(kind: int, body: Column | str, head: int = 1, whole: bool = False) -> Column:
    """kind, length and body, each of the first two in `head` bytes; whole: the length counts all of it."""
    b = F.lit(body) if isinstance(body, str) else body
    return F.concat(h(kind, head), h(n(b) + (2 * head if whole else 0), head), b)


def said() -> Column:
    return text_hex(F.col("event_type"))


def host_hex() -> Column:
    """A name out of the event's kind and user, in hexadecimal."""
    return text_hex(host())


def host() -> Column:
    return F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string"))


HOST = "event_type || '-' || user_id"
XID = "CAST(event_id AS BIGINT)"


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'neighbor_advertisement' ELSE 'neighbor_solicitation' END AS kind, 'fe80::1:0:0:2' AS target, '00:00:00:00:00:02' AS lladdr, user_id % 2 = 0 AND event_id % 2 = 0 AS spoof FROM events")
def ndp_messages(spark, sf_dir):
    even = F.col("user_id") % 2 == 0
    flags = F.when(~even, "00000000").when(F.col("event_id") % 2 == 0, "20000000").otherwise("60000000")
    p = made(spark, sf_dir, F.when(even, "88000000").otherwise("87000000"), flags, "FE80000000000000" + "0001000000000002", F.when(even, "0201").otherwise("0101"), "000000000002")
    return fields(p, link.ndp(F.col("payload")), kind="m.kind", target="m.target", lladdr="m.lladdr", spoof="m.spoof")


@query(f"SELECT event_id, 'dest_unreachable' AS kind, 'fragmentation_needed' AS unreachable, TRUE AS is_error, CAST(user_id % 9000 AS BIGINT) AS mtu, 'udp' AS proto, {SRC} AS src_ip, CAST(1024 + event_id % 60000 AS INTEGER) AS src_port, 53 AS dst_port FROM events")
def icmp_errors(spark, sf_dir):
    inner = F.concat(F.lit("4500001C" + "00000000" + "4011" + "0000"), low_address(), F.lit("C0A80001"), h(1024 + F.col("event_id") % 60000, 2), F.lit("0035" + "00080000"))
    p = made(spark, sf_dir, "03040000" + "0000", h(F.col("user_id") % 9000, 2), inner)
    return fields(p, link.icmp(F.col("payload")), kind="m.kind", unreachable="m.unreachable", is_error="m.is_error", mtu="m.mtu", proto="m.inner.proto", src_ip="m.inner.src_ip", src_port="m.inner.src_port", dst_port="m.inner.dst_port")


@query(f"SELECT event_id, 'request' AS kind, {XID} AS xid, '00:00:00:00:00:02' AS mac, {HOST} AS host_name, {SRC} AS requested_ip, CAST(3600 AS BIGINT) AS lease_s, '1,3,6|' || event_type AS fingerprint FROM events")
def dhcp_messages(spark, sf_dir):
    options = F.concat(tlv(53, "03"), tlv(12, host_hex()), tlv(50, low_address()), tlv(51, "00000E10"), tlv(55, "010306"), tlv(60, said()), F.lit("FF"))
    p = made(spark, sf_dir, "01010600", h(F.col("event_id"), 4), "00000000" + "00000000" * 4, "000000000002" + "00" * 10, "00" * 192, "63825363", options)
    return fields(p, link.dhcp(F.col("payload")), kind="m.kind", xid="m.xid", mac="m.mac", host_name="m.host_name", requested_ip="m.requested_ip", lease_s="m.lease_s", fingerprint="m.fingerprint")


def lldp_unit(kind: int, body: Column | str) -> Column:
    b = F.lit(body) if isinstance(body, str) else body
    return F.concat(h(kind * 512 + n(b), 2), b)


@query(f"SELECT event_id, '00:00:00:00:00:02' AS chassis_id, event_type AS port_id, CAST(user_id % 2 * 120 AS BIGINT) AS ttl, {HOST} AS system_name, {SRC} AS management, user_id % 2 = 0 AS shutdown FROM events")
def lldp_units(spark, sf_dir):
    p = made(spark, sf_dir, lldp_unit(1, "04000000000002"), lldp_unit(2, F.concat(F.lit("05"), said())), lldp_unit(3, h(F.col("user_id") % 2 * 120, 2)), lldp_unit(5, host_hex()), lldp_unit(8, F.concat(F.lit("0501"), low_address(), F.lit("020000000100"))), "0000")
    return fields(p, link.lldp(F.col("payload")), chassis_id="m.chassis_id", port_id="m.port_id", ttl="m.ttl", system_name="m.system_name", management="m.management", shutdown="m.shutdown")


@query(f"SELECT event_id, {HOST} AS device_id, {SRC} AS address, event_type AS platform, CAST(user_id % 4096 AS BIGINT) AS native_vlan, TRUE AS full_duplex FROM events")
def cdp_units(spark, sf_dir):
    unit = lambda kind, body: tlv(kind, body, 2, whole=True)
    p = made(spark, sf_dir, "02B40000", unit(1, host_hex()), unit(2, F.concat(F.lit("00000001" + "0101CC0004"), low_address())), unit(6, said()), unit(10, h(F.col("user_id") % 4096, 2)), unit(11, "01"))
    return fields(p, link.cdp(F.col("payload")), device_id="m.device_id", address="m.address", platform="m.platform", native_vlan="m.native_vlan", full_duplex="m.full_duplex")


@query("SELECT event_id, CAST(4 AS BIGINT) AS version, CAST(4 AS BIGINT) AS mode, CAST(event_id % 3 + 1 AS BIGINT) AS stratum, CASE WHEN event_id % 3 = 0 THEN 'GPS' ELSE '71.80.83.0' END AS reference_id, CAST(1600000000 + user_id AS DOUBLE) + 0.5 AS transmit_s FROM events")
def ntp_packets(spark, sf_dir):
    p = made(spark, sf_dir, "24", h(F.col("event_id") % 3 + 1, 1), "06EC" + "00" * 8 + "47505300" + "00" * 24, h(1_600_000_000 + link.NTP_EPOCH + F.col("user_id"), 4), "80000000")
    return fields(p, link.ntp(F.col("payload")), version="m.version", mode="m.mode", stratum="m.stratum", reference_id="m.reference_id", transmit_s="m.transmit_s")


@query(f"SELECT event_id, 'read' AS opcode, {HOST} || '-confg' AS file, 'octet' AS mode, TRUE AS config FROM events")
def tftp_requests(spark, sf_dir):
    p = made(spark, sf_dir, "0001", host_hex(), text_hex("-confg"), "00", text_hex("OCTET"), "00")
    return fields(p, link.tftp(F.col("payload")), opcode="m.opcode", file="m.file", mode="m.mode", config="m.config")


@query(f"SELECT event_id, 'success' AS class, CAST(1 AS BIGINT) AS method, {SRC} || ':' || CAST(1024 + event_id % 60000 AS INTEGER) AS mapped, event_type AS software FROM events")
def stun_messages(spark, sf_dir):
    masked = F.concat(*[hexed(F.conv(F.substring(low_address(), 2 * i + 1, 2), 16, 10).cast("long").bitwiseXOR(F.lit(m)), 1) for i, m in enumerate((0x21, 0x12, 0xA4, 0x42))])
    padded = F.rpad(said(), 24, "0")
    address = F.concat(F.lit("0020" + "0008" + "0001"), h((1024 + F.col("event_id") % 60000).bitwiseXOR(F.lit(0x2112)), 2), masked)
    software = F.concat(F.lit("8022"), h(n(said()), 2), F.substring(padded, F.lit(1), (F.ceil(n(said()) / 4) * 8).cast("int")))
    p = made(spark, sf_dir, "0101", h(n(address) + n(software), 2), "2112A442" + "0102030405060708090A0B0C", address, software)
    return fields(p, link.stun(F.col("payload")), **{"class": "m.class"}, method="m.method", mapped="m.mapped", software="m.software")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'initiation' ELSE 'data' END AS kind, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS BIGINT) END AS sender, CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS BIGINT) END AS receiver, event_id % 2 = 0 AS handshake FROM events")
def wireguard_messages(spark, sf_dir):
    little = F.concat(*[F.substring(h(F.col("user_id"), 4), 7 - 2 * i, 2) for i in range(4)])
    p = made(spark, sf_dir, F.when(F.col("event_id") % 2 == 0, "01000000").otherwise("04000000"), little, "00" * 40)
    return fields(p, link.wireguard(F.col("payload")), kind="m.kind", sender="m.sender", receiver="m.receiver", handshake="m.handshake")


@query("SELECT event_id, CAST(event_id % 65536 AS BIGINT) AS transaction, CAST(CASE WHEN user_id % 3 = 0 THEN 3 ELSE 16 END AS BIGINT) AS function, user_id % 2 = 1 AS is_exception, CASE WHEN user_id % 2 = 1 THEN CAST(2 AS BIGINT) END AS exception, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 65536 AS BIGINT) END AS address, CASE WHEN user_id % 3 = 0 THEN 'read' ELSE 'write' END AS access FROM events")
def modbus_messages(spark, sf_dir):
    odd = F.col("user_id") % 2 == 1
    function = F.when(F.col("user_id") % 3 == 0, 3).otherwise(16) + F.when(odd, 128).otherwise(0)
    p = made(spark, sf_dir, h(F.col("event_id") % 65536, 2), "0000" + "0006" + "01", h(function, 1), F.when(odd, "02").otherwise(F.concat(h(F.col("user_id") % 65536, 2), F.lit("0002"))))
    return fields(p, link.modbus(F.col("payload")), transaction="m.transaction", function="m.function", is_exception="m.is_exception", exception="m.exception", address="m.address", access="m.access")


@query("SELECT event_id, CAST(user_id % 65536 AS BIGINT) AS source, CAST(1 AS BIGINT) AS destination, CAST(129 AS BIGINT) AS function, CAST(event_id % 16 AS BIGINT) AS sequence, CAST(4096 AS BIGINT) AS iin, TRUE AS is_response FROM events")
def dnp3_frames(spark, sf_dir):
    swapped = F.concat(F.substring(h(F.col("user_id") % 65536, 2), 3, 2), F.substring(h(F.col("user_id") % 65536, 2), 1, 2))
    p = made(spark, sf_dir, "0564" + "0A" + "44" + "0100", swapped, "0000" + "C0", h(0xC0 + F.col("event_id") % 16, 1), "81" + "1000")
    return fields(p, link.dnp3(F.col("payload")), source="m.source", destination="m.destination", function="m.function", sequence="m.sequence", iin="m.iin", is_response="m.is_response")


def label(text: Column | str) -> Column:
    b = text_hex(text)
    return F.concat(h(n(b), 1), b)


def dns_hex(response: bool = True) -> Column:
    """A question for <kind>.example.org, and an alias and an address in answer, with pointers to earlier names."""
    question = F.concat(label(F.col("event_type")), label("example"), label("org"), F.lit("00" + "0001" + "0001"))
    if not response:
        return F.concat(h(F.col("event_id") % 65536, 2), F.lit("0100" + "0001" + "0000" * 3), question)
    alias = F.concat(F.lit("C00C" + "0005" + "0001"), h(300 + F.col("user_id") % 100, 4), h(6, 2), label("www"), F.lit("C0"), h(12 + 1 + F.length("event_type"), 1))
    # The alias' own name begins after its twelve bytes of head.
    address = F.concat(F.lit("C0"), h(12 + n(question) + 12, 1), F.lit("0001" + "0001" + "0000012C" + "0004"), low_address())
    return F.concat(h(F.col("event_id") % 65536, 2), F.when(F.col("user_id") % 10 == 0, "8183").otherwise("8180"), F.lit("0001" + "0002" + "0000" * 2), question, alias, address)


@query(f"SELECT event_id, CAST(event_id % 65536 AS BIGINT) AS id, TRUE AS is_response, CASE WHEN user_id % 10 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode, event_type || '.example.org' AS qname, 'A' AS qtype, 'www.example.org' AS alias, CAST(300 + user_id % 100 AS BIGINT) AS alias_ttl, 'www.example.org' AS owner, {SRC} AS address FROM events")
def dns_messages(spark, sf_dir):
    p = made(spark, sf_dir, dns_hex())
    return fields(p, names.dns(F.col("payload")), id="m.id", is_response="m.is_response", rcode="m.rcode", qname="m.questions[0].name", qtype="m.questions[0].type", alias="m.records[0].value", alias_ttl="m.records[0].ttl", owner="m.records[1].name", address="m.records[1].value")


@query(f"SELECT event_id, CAST(event_id % 65536 AS BIGINT) AS id, event_type || '.example.org' AS qname, i AS is_response FROM events, (VALUES (TRUE), (FALSE)) v(i)")
def dns_tcp_messages(spark, sf_dir):
    """Two messages in one stream over TCP, each behind its length."""
    a, b = dns_hex(False), dns_hex()
    p = made(spark, sf_dir, h(n(a), 2), a, h(n(b), 2), b).select("event_id", F.explode(names.dns_stream(F.col("payload"))).alias("payload"))
    return fields(p, names.dns(F.col("payload")), id="m.id", qname="m.questions[0].name", is_response="m.is_response")


@query(f"SELECT event_id, '_ipp._tcp.local' AS service, event_type || '._ipp._tcp.local' AS instance, TRUE AS device FROM events")
def mdns_services(spark, sf_dir):
    service = F.concat(label("_ipp"), label("_tcp"), label("local"), F.lit("00"))
    instance = F.concat(label(F.col("event_type")), F.lit("C00C"))
    p = made(spark, sf_dir, "0000" + "8400" + "0000" + "0001" + "0000" * 2, service, "000C" + "0001" + "00000078", h(n(instance), 2), instance)
    return p.select("event_id", F.explode(names.services(names.dns(F.col("payload")))).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, CAST(event_id % 65536 AS BIGINT) AS id, 'registration' AS opcode, upper(event_type) AS name, CAST(32 AS BIGINT) AS suffix FROM events")
def nbns_names(spark, sf_dir):
    padded = F.rpad(F.upper("event_type"), 15, " ")
    digits = F.concat(F.hex(padded.cast("binary")), F.lit("20"))
    letters = F.translate(digits, "0123456789ABCDEF", "ABCDEFGHIJKLMNOP")
    p = made(spark, sf_dir, h(F.col("event_id") % 65536, 2), "2910" + "0001" + "0000" * 3 + "20", text_hex(letters), "00" + "0020" + "0001")
    return fields(p, names.nbns(F.col("payload")), id="m.id", opcode="m.opcode", name="m.name", suffix="cast(m.suffix as bigint)")


@query(f"SELECT event_id, 'notify' AS kind, event_type AS nt, 'uuid:' || user_id AS usn, CAST(1800 AS BIGINT) AS max_age, TRUE AS alive FROM events")
def ssdp_messages(spark, sf_dir):
    text = F.concat(F.lit("NOTIFY * HTTP/1.1\r\nHost: 239.255.255.250:1900\r\nCache-Control: max-age = 1800\r\nnt: "), F.col("event_type"), F.lit("\r\nNTS: ssdp:alive\r\nUSN: uuid:"), F.col("user_id").cast("string"), F.lit("\r\n\r\n"))
    return fields(events(spark, sf_dir).withColumn("payload", text.cast("binary")), names.ssdp(F.col("payload")), kind="m.kind", nt="m.nt", usn="m.usn", max_age="m.max_age", alive="m.alive")


#: Queries are the even events of a user, answers the odd ones; the number is the user's.
EXCHANGE = "m AS (SELECT user_id AS client, epoch_us(ts) AS us, event_id AS seq, event_id % 2 = 1 AS r, CASE WHEN event_id % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode FROM events), w AS (SELECT *, lag(r) OVER k AS pr, lag(us) OVER k AS pus, lead(r) OVER k AS nr, lead(us) OVER k AS nus, lead(seq) OVER k AS ns, lead(rcode) OVER k AS nc FROM m WINDOW k AS (PARTITION BY client ORDER BY us, seq))"
PATIENCE = 3 * 86_400_000_000


def dns_rows(spark, sf_dir) -> DataFrame:
    from tidelane.sources.events import packets

    ev = packets(spark, sf_dir)
    return ev.select(F.col("src").alias("client"), F.col("src").alias("id"), "us", "seq", (F.col("seq") % 2 == 1).alias("is_response"), F.when(F.col("seq") % 7 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"))


@query(f"""WITH {EXCHANGE}, x AS (SELECT *, NOT r AND coalesce(nr, FALSE) AND nus - us < {PATIENCE} AS answered, r AND coalesce(NOT pr AND us - pus < {PATIENCE}, FALSE) AS taken FROM w)
SELECT client, CASE WHEN NOT r THEN seq END AS query_seq, CASE WHEN answered THEN ns WHEN r THEN seq END AS response_seq, CASE WHEN answered THEN nus - us END AS elapsed_us,
CASE WHEN answered AND nc = 'NOERROR' THEN 'completed' WHEN answered THEN 'failed' WHEN NOT r AND NOT nr AND nus - us < {PATIENCE} THEN 'replaced' WHEN NOT r THEN 'no_response' ELSE 'orphan' END AS outcome FROM x WHERE NOT taken""")
def dns_exchanges(spark, sf_dir):
    return names.exchanges(dns_rows(spark, sf_dir), ["client"], "id", PATIENCE).select("client", "query_seq", "response_seq", "elapsed_us", "outcome")


@query(f"""WITH c AS (SELECT user_id AS client, {SRC} AS ip, event_type || '.example.org' AS name, epoch_us(ts) AS us, event_id AS seq, epoch_us(ts) + 360 * 1000000 AS expires_us FROM events WHERE user_id % 10 <> 0)
SELECT client, ip, name, us, expires_us, coalesce(lag(expires_us) OVER (PARTITION BY client, ip, name ORDER BY us, seq) < us, TRUE) AS new FROM c""")
def passive_names(spark, sf_dir):
    """The least time to live is that of the address (300 s); answers with an error are left out here."""
    from tidelane.sources.events import micros

    ev = events(spark, sf_dir).filter("user_id % 10 <> 0").withColumn("payload", frame_of(dns_hex()))
    responses = ev.select(micros("ts").alias("us"), F.col("event_id").alias("seq"), F.col("user_id").alias("client"), names.dns(F.col("payload")).alias("message"))
    return names.name_claims(responses).select("client", "ip", "name", "us", "expires_us", "new")


def http_bytes() -> Column:
    """A request with a body, and one without, in one stream."""
    body = F.concat(F.lit("v="), F.col("value").cast("int").cast("string"))
    first = F.concat(F.lit("POST /buy/"), F.col("user_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: Shop.example\r\nUser-Agent: "), F.col("event_type"), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return F.concat(first, F.lit("GET /"), F.col("event_type"), F.lit(" HTTP/1.1\r\nhost: other.example\r\n\r\n")).cast("binary")


@query("""SELECT event_id, 'POST' AS method, '/buy/' || user_id AS path, 'Shop.example' AS host, event_type AS agent, 'v=' || CAST(trunc(value) AS INTEGER) AS body FROM events UNION ALL SELECT event_id, 'GET', '/' || event_type, 'other.example', NULL, '' FROM events""")
def http_messages(spark, sf_dir):
    m = events(spark, sf_dir).select("event_id", F.explode(web.http(http_bytes())).alias("m"))
    return m.select("event_id", "m.method", "m.path", web.header(F.col("m.headers"), "host").alias("host"), web.header(F.col("m.headers"), "user-agent").alias("agent"), "m.body")


@query("""SELECT event_id, CAST(200 + event_id % 3 * 101 AS INTEGER) AS status, event_type || user_id AS body, CAST((200 + event_id % 3 * 101) // 100 AS INTEGER) AS class FROM events""")
def http_chunked(spark, sf_dir):
    """Responses with a chunked body in two chunks."""
    size = lambda c: F.lower(F.hex(F.length(c).cast("long")))
    user = F.col("user_id").cast("string")
    stream = F.concat(F.lit("HTTP/1.1 "), (200 + F.col("event_id") % 3 * 101).cast("string"), F.lit(" X\r\nTransfer-Encoding: chunked\r\n\r\n"), size(F.col("event_type")), F.lit("\r\n"), F.col("event_type"), F.lit("\r\n"), size(user), F.lit("\r\n"), user, F.lit("\r\n0\r\n\r\n")).cast("binary")
    m = events(spark, sf_dir).select("event_id", F.explode(web.http(stream)).alias("m"))
    return m.select("event_id", "m.status", "m.body", web.status_class(F.col("m.status")).alias("class"))


@query("""SELECT event_id, ['both_framings', 'content_lengths_differ', 'hosts_differ', 'folded_line', NULL][event_id % 5 + 1] AS poison FROM events""")
def http_poison(spark, sf_dir):
    """Heads whose framing is doubtful, as request smuggling uses them."""
    extra = F.element_at(F.array(*[F.lit(x) for x in ("Content-Length: 3\r\nTransfer-Encoding: chunked\r\n", "Content-Length: 0\r\nContent-Length: 1\r\n", "Host: b\r\n", "X: a\r\n b\r\n", "X: a\r\n")]), (F.col("event_id") % 5 + 1).cast("int"))
    stream = F.concat(F.lit("GET / HTTP/1.1\r\nHost: a\r\n"), extra, F.lit("\r\n"), F.when(F.col("event_id") % 5 == 0, "0\r\n\r\n").otherwise("")).cast("binary")
    return events(spark, sf_dir).select("event_id", F.explode(web.http(stream)).alias("m")).select("event_id", "m.poison")


#: Requests are the purchases and clicks of a user, responses the rest; errors reset.
HTTP = "m AS (SELECT user_id AS flow, epoch_us(ts) AS us, event_id AS seq, event_type IN ('purchase', 'click') AS q, CASE WHEN event_type IN ('purchase', 'click') THEN NULL WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status FROM events), x AS (SELECT *, row_number() OVER (PARTITION BY flow, q ORDER BY us, seq) AS n FROM m), e AS (SELECT a.flow, a.n, a.seq AS request, b.seq AS response, b.status FROM x a LEFT JOIN x b ON NOT b.q AND b.flow = a.flow AND b.n = a.n WHERE a.q)"


def http_rows(spark, sf_dir) -> DataFrame:
    from tidelane.sources.events import packets

    request = F.col("svc").isin("purchase", "click")
    status = F.when(request, None).when(F.col("svc") == "error", 500).when(F.col("seq") % 11 == 0, 404).otherwise(200)
    return packets(spark, sf_dir).select(F.col("src").alias("flow"), "us", "seq", request.alias("is_request"), status.cast("int").alias("status"), F.lit(False).alias("reset"), "bytes", F.concat(F.lit("h"), F.col("src") % 5).alias("host"))


@query(f"WITH {HTTP} SELECT flow, CAST(n AS INTEGER) AS n, request, response, CASE WHEN response IS NULL THEN 'no_response' ELSE 'completed' END AS outcome FROM e")
def http_exchanges(spark, sf_dir):
    return web.http_exchanges(http_rows(spark, sf_dir), "flow").select("flow", "n", "request", "response", "outcome")


@query(f"WITH {HTTP} SELECT 'h' || flow % 5 AS host, count(*) FILTER (status < 300) AS ok, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status >= 500) AS server_errors, round(count(*) FILTER (status >= 400) / count(*), 6) AS error_rate FROM e GROUP BY 1")
def http_error_rate(spark, sf_dir):
    """Responses of each host by class, over paired exchanges."""
    x = web.http_exchanges(http_rows(spark, sf_dir), "flow").withColumn("host", F.concat(F.lit("h"), F.col("flow") % 5))
    c = web.status_class(F.col("status"))
    return x.groupBy("host").agg(F.count_if(c == 2).alias("ok"), F.count_if(c == 4).alias("client_errors"), F.count_if(c == 5).alias("server_errors"), F.round(F.count_if(c >= 4) / F.count("*"), 6).alias("error_rate"))


@query(f"WITH {HTTP}, b AS (SELECT user_id AS flow, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS bytes FROM events) SELECT e.flow, CAST(n AS INTEGER) AS n, q.bytes AS request_bytes, coalesce(r.bytes, 0) AS response_bytes, CASE WHEN response IS NULL THEN 'no_response' ELSE 'completed' END AS outcome FROM e JOIN b q ON q.seq = request LEFT JOIN b r ON r.seq = response")
def http_access_log(spark, sf_dir):
    """One line for each exchange with the body bytes of both sides."""
    rows = http_rows(spark, sf_dir)
    x = web.http_exchanges(rows, "flow")
    size = lambda side: rows.select(F.col("seq").alias(side), F.col("bytes").alias(f"{side}_bytes"))
    return x.join(size("request"), "request").join(size("response"), "response", "left").select("flow", "n", "request_bytes", F.coalesce("response_bytes", F.lit(0)).alias("response_bytes"), "outcome")


def client_hello_hex() -> Column:
    """A hello with reserved values among its ciphers, extensions and groups; the ciphers depend on the event."""
    sni = F.concat(F.col("event_type"), F.lit(".example.org"))
    name = F.concat(F.lit("00"), h(F.length(sni), 2), text_hex(sni))
    ext = lambda kind, body: F.concat(F.lit(kind), h(n(body), 2), body)
    extensions = F.concat(
        F.lit("3A3A0000"), ext("0000", F.concat(h(n(name), 2), name)), ext("000A", F.lit("0006" + "9A9A" + "001D" + "0017")), ext("000B", F.lit("0100")), ext("0010", F.lit("000C" + "02" + "6832" + "08" + "687474702F312E31")), ext("002B", F.lit("06" + "7A7A" + "0304" + "0303")), ext("0033", F.lit("000B" + "11EC" + "0001" + "00" + "001D" + "0002" + "0000")),
    )
    ciphers = F.concat(F.lit("FAFA" + "1301"), h(0xC000 + F.col("user_id") % 256, 2))
    body = F.concat(F.lit("0303" + "00" * 32 + "00"), h(n(ciphers), 2), ciphers, F.lit("0100"), h(n(extensions), 2), extensions)
    message = F.concat(F.lit("01"), h(n(body), 3), body)
    return F.concat(F.lit("160301"), h(n(message), 2), message)


def server_hello_hex() -> Column:
    extensions = F.lit("002B00020304")
    body = F.concat(F.lit("0303" + "00" * 32 + "00" + "1301" + "00"), h(n(extensions), 2), extensions)
    message = F.concat(F.lit("02"), h(n(body), 3), body)
    return F.concat(F.lit("160303"), h(n(message), 2), message)


@query("SELECT event_id, CAST(771 AS BIGINT) AS version, event_type || '.example.org' AS sni, 'h2,http/1.1' AS alpn, 3 AS n_ciphers, 7 AS n_extensions, '4588,29' AS shares FROM events")
def tls_hellos(spark, sf_dir):
    hello = web.client_hello(web.handshakes(F.col("payload")))
    return fields(made(spark, sf_dir, client_hello_hex()), hello, version="m.version", sni="m.sni", alpn="array_join(m.alpn, ',')", n_ciphers="size(m.ciphers)", n_extensions="size(m.extensions)", shares="array_join(transform(m.key_shares, x -> string(x)), ',')")


@query("SELECT event_id, md5('771,4865-' || (49152 + user_id % 256) || ',0-10-11-16-43-51,29-23,') AS ja3 FROM events")
def ja3_hashes(spark, sf_dir):
    return made(spark, sf_dir, client_hello_hex()).select("event_id", web.client_hello(web.handshakes(F.col("payload"))).alias("m")).select("event_id", web.ja3(F.col("m")).alias("ja3"))


@query("SELECT event_id, 't13d0206h2_' || substring(sha256('1301,' || printf('%04x', 49152 + user_id % 256)), 1, 12) || '_' || substring(sha256('0000,000a,000b,0010,002b,0033'), 1, 12) AS ja4 FROM events")
def ja4_hashes(spark, sf_dir):
    return made(spark, sf_dir, client_hello_hex()).select("event_id", web.client_hello(web.handshakes(F.col("payload"))).alias("m")).select("event_id", web.ja4(F.col("m")).alias("ja4"))


@query("SELECT event_id, event_type || '.example.org' AS sni, 'h2' AS alpn, 'TLS1.3' AS version, CAST(4865 AS BIGINT) AS cipher, 'X25519MLKEM768' AS pq_group, FALSE AS weak_cipher, FALSE AS obsolete_version FROM events")
def tls_handshakes(spark, sf_dir):
    p = events(spark, sf_dir).withColumn("client", frame_of(client_hello_hex())).withColumn("server", frame_of(server_hello_hex()))
    return fields(p, web.tls_handshake(F.col("client"), F.col("server")), sni="m.sni", alpn="m.alpn", version="m.version", cipher="m.cipher", pq_group="m.pq_group", weak_cipher="m.weak_cipher", obsolete_version="m.obsolete_version")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, 'initial' AS kind, printf('%08x', user_id) AS dcid, TRUE AS initial FROM events")
def quic_headers(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    p = made(spark, sf_dir, F.when(even, "C300000001").otherwise("D36B3343CF"), "04", h(F.col("user_id"), 4), "00" + "00" * 16)
    return fields(p, web.quic(F.col("payload")), version="m.version", kind="m.kind", dcid="m.dcid", initial="m.initial")


@query("SELECT event_id, unnest(['settings', 'headers', 'rst_stream']) AS kind, unnest([0, CAST(user_id * 2 + 1 AS BIGINT), CAST(user_id * 2 + 1 AS BIGINT)]) AS stream, unnest([FALSE, TRUE, FALSE]) AS end_stream, unnest([NULL, NULL, CAST(8 AS BIGINT)]) AS error FROM events")
def http2_frames(spark, sf_dir):
    stream = h(F.col("user_id") * 2 + 1, 4)
    p = made(spark, sf_dir, F.hex(F.lit(web.PREFACE)), "000000" + "0400" + "00000000", "000001" + "0105", stream, "82", "000004" + "0300", stream, "00000008")
    return p.select("event_id", F.explode(web.http2_frames(F.col("payload"))).alias("m")).select("event_id", "m.kind", "m.stream", "m.end_stream", "m.error")


@query("SELECT event_id, 'shop.Cart' AS service, event_type AS method, CAST(user_id % 17 AS INTEGER) AS code, ['ok', 'cancelled', 'unknown', 'invalid_argument', 'deadline_exceeded', 'not_found', 'already_exists', 'permission_denied', 'resource_exhausted', 'failed_precondition', 'aborted', 'out_of_range', 'unimplemented', 'internal', 'unavailable', 'data_loss', 'unauthenticated'][user_id % 17 + 1] AS status, TRUE AS grpc FROM events")
def grpc_calls(spark, sf_dir):
    trailers = F.array(F.struct(F.lit("grpc-status").alias("name"), (F.col("user_id") % 17).cast("string").alias("value")))
    m = web.grpc_method(F.concat(F.lit("/shop.Cart/"), F.col("event_type")))
    s = web.grpc_status(trailers)
    return events(spark, sf_dir).select("event_id", m["service"].alias("service"), m["method"].alias("method"), s["code"].alias("code"), s["name"].alias("status"), web.is_grpc(F.lit("application/grpc+proto")).alias("grpc"))


@query("SELECT event_id, 'SSH-2.0-' || event_type AS banner, 'k1,k2' AS kex, md5('k1,k2;' || event_type || ';m1;none,zlib') AS hassh FROM events")
def ssh_hellos(spark, sf_dir):
    listed = lambda c: F.concat(h(n(c), 4), c)
    lists = F.concat(*[listed(text_hex(x)) for x in ("k1,k2", "ssh-ed25519")], listed(said()), *[listed(text_hex(x)) for x in ("other", "m1", "m2", "none,zlib", "none", "", "")])
    packet = F.concat(F.lit("0414" + "00" * 16), lists, F.lit("0000000000" + "00000000"))
    p = made(spark, sf_dir, text_hex("SSH-2.0-"), said(), "0D0A", h(n(packet), 4), packet)
    return fields(p, web.ssh(F.col("payload")), banner="m.banner", kex="array_join(m.kex, ',')", hassh="m.hassh")


@query("SELECT event_id, unnest(['credentials', 'transfer', 'command']) AS kind, unnest(['USER', 'RETR', 'QUIT']) AS verb, unnest([event_type, '/f/' || user_id, NULL]) AS argument FROM events")
def ftp_commands(spark, sf_dir):
    stream = F.concat(F.lit("USER "), F.col("event_type"), F.lit("\r\nretr /f/"), F.col("user_id").cast("string"), F.lit("\r\nQUIT\r\n")).cast("binary")
    return events(spark, sf_dir).select("event_id", F.explode(enterprise.ftp(stream, True)).alias("m")).select("event_id", "m.kind", "m.verb", "m.argument")


@query("SELECT event_id, unnest(['banner', 'reply']) AS kind, unnest([CAST(220 AS INTEGER), 331]) AS code, unnest(['completion', 'intermediate']) AS class FROM events")
def ftp_replies(spark, sf_dir):
    stream = F.concat(F.lit("220-hello\r\n220 "), F.col("event_type"), F.lit("\r\n331 more\r\n")).cast("binary")
    m = events(spark, sf_dir).select("event_id", F.explode(enterprise.ftp(stream, False)).alias("m"))
    return m.select("event_id", "m.kind", "m.code", enterprise.reply_class(F.col("m.code")).alias("class"))


@query("SELECT event_id, unnest(['helo', 'credentials', 'mail_from', 'rcpt_to', 'data_begin', 'data_end', 'command']) AS kind, unnest(['me', 'joe ' || event_type, 'a@' || user_id, 'b@c', NULL, NULL, NULL]) AS argument FROM events")
def smtp_commands(spark, sf_dir):
    secret = F.base64(F.concat(F.lit("\0joe\0"), F.col("event_type")).cast("binary"))
    stream = F.concat(F.lit("EHLO me\r\nAUTH PLAIN "), secret, F.lit("\r\nMAIL FROM:<a@"), F.col("user_id").cast("string"), F.lit(">\r\nRCPT TO:<b@c>\r\nDATA\r\nSubject: x\r\n\r\nQUIT\r\n.\r\nQUIT\r\n")).cast("binary")
    return events(spark, sf_dir).select("event_id", F.explode(enterprise.smtp(stream)).alias("m")).select("event_id", "m.kind", "m.argument")


def utf16_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16LE"))


def little(value: Column, size: int) -> Column:
    d = hexed(value, size)
    return F.concat(*[F.substring(d, 2 * size - 2 * i - 1, 2) for i in range(size)])


@query(r"SELECT event_id, 'tree_connect' AS command, CAST(event_id AS BIGINT) AS message_id, '\\srv' || user_id || '\' || CASE WHEN user_id % 2 = 0 THEN 'ADMIN$' ELSE 'data' END AS tree, user_id % 2 = 0 AS admin_share FROM events")
def smb_messages(spark, sf_dir):
    return fields(smb_payloads(spark, sf_dir), enterprise.smb(F.col("payload")), command="m.command", message_id="m.message_id", tree="m.tree", admin_share="m.admin_share")


def smb_payloads(spark, sf_dir) -> DataFrame:
    """Events as connections to shares."""
    path = F.concat(F.lit("\\\\srv"), F.col("user_id").cast("string"), F.lit("\\"), F.when(F.col("user_id") % 2 == 0, "ADMIN$").otherwise("data"))
    made_ = made(spark, sf_dir, "00000000" + "FE534D42" + "4000" + "0000" + "00000000" + "0300" + "0000" + "00000000" + "00000000", little(F.col("event_id"), 8), "00" * 8 + "00" * 8 + "00" * 16, "0900" + "0000" + "4800", little(F.length(path) * 2, 2), utf16_hex(path))
    return made_.withColumn("payload", once(F.col("payload")))


Part = tuple[Column, int]


def fixed(value: Column | str, size: int | None = None) -> Part:
    """Hexadecimal text with the number of its bytes."""
    return (F.lit(value), len(value) // 2) if isinstance(value, str) else (value, size)


def element(tag: str, *body: Part | str) -> Part:
    """An element of ASN.1's basic encoding around parts of known size."""
    parts = [fixed(x) if isinstance(x, str) else x for x in body]
    size = sum(k for _, k in parts)
    head = f"{tag}{size:02X}" if size < 128 else f"{tag}81{size:02X}"
    return F.concat(F.lit(head), *[c for c, _ in parts]), size + len(head) // 2


def ascii_part(value: str) -> Part:
    return fixed(value.encode().hex().upper())


def kind8() -> Part:
    """The event's kind, filled up to eight letters."""
    return text_hex(F.rpad("event_type", 8, "_")), 8


KIND8 = "rpad(event_type, 8, '_')"


@query(f"SELECT event_id, CAST(event_id % 127 AS BIGINT) AS message_id, 'search_request' AS operation, 'dc=' || {KIND8} AS base, 'subtree' AS scope, user_id % 2 = 0 AS spn_query, 'cn,' || {KIND8} AS attributes FROM events")
def ldap_messages(spark, sf_dir):
    asked = F.when(F.col("user_id") % 2 == 0, "servicePrincipalName").otherwise("objectClassObjectCla")
    request = element("63", element("04", ascii_part("dc="), kind8()), "0A0102" + "0A0100" + "020100" + "020100" + "010100", element("87", (text_hex(asked), 20)), element("30", element("04", ascii_part("cn")), element("04", kind8())))
    p = trees(made(spark, sf_dir, element("30", "0201", (h(F.col("event_id") % 127, 1), 1), request)[0]))
    return fields(p, enterprise.ldap(F.col("tree")), message_id="m.message_id", operation="m.operation", base="m.base", scope="m.scope", spn_query="m.spn_query", attributes="array_join(m.attributes, ',')")


def ticket_request() -> Part:
    """A request for a ticket of a service; every third event asks for RC4."""
    service = element("30", "A003020102", element("A1", element("30", element("1B", ascii_part("http")), element("1B", kind8()))))
    etypes = element("30", (F.when(F.col("event_id") % 3 == 0, "020117").otherwise("020112"), 3), "020111")
    body = element("30", "A00703050040810000", element("A2", element("1B", ascii_part("EXAMPLE"))), element("A3", service), element("A8", etypes))
    return element("6C", element("30", "A103020105" + "A20302010C", element("A4", body)))


@query(f"SELECT event_id, 'tgs_req' AS kind, 'EXAMPLE' AS realm, 'http/' || {KIND8} AS service, CASE WHEN event_id % 3 = 0 THEN '23,17' ELSE '18,17' END AS etypes, event_id % 3 = 0 AS kerberoast FROM events")
def kerberos_messages(spark, sf_dir):
    return fields(trees(made(spark, sf_dir, ticket_request()[0])), enterprise.kerberos(F.col("tree")), kind="m.kind", realm="m.realm", service="m.service", etypes="array_join(transform(m.etypes, x -> string(x)), ',')", kerberoast="m.kerberoast")


@query(f"SELECT event_id, 'tgs_req' AS kind, 'http/' || {KIND8} AS service, i FROM events, (VALUES (0), (1)) v(i)")
def kerberos_tcp_messages(spark, sf_dir):
    t, size = ticket_request()
    p = made(spark, sf_dir, f"{size:08X}", t, f"{size:08X}", t).select("event_id", F.posexplode(enterprise.kerberos_stream(F.col("payload"))).alias("i", "payload"))
    return trees(p).select("event_id", "i", enterprise.kerberos(F.col("tree")).alias("m")).select("event_id", "m.kind", "m.service", "i")


@query(f"SELECT event_id, 'access_request' AS code, CAST(event_id % 256 AS BIGINT) AS identifier, {HOST} AS user_name, {SRC} AS nas_ip, TRUE AS has_password FROM events")
def radius_messages(spark, sf_dir):
    unit = lambda kind, body: tlv(kind, body, 1, whole=True)
    pairs = F.concat(unit(1, host_hex()), unit(2, "00" * 16), unit(4, low_address()))
    p = made(spark, sf_dir, "01", h(F.col("event_id") % 256, 1), h(20 + n(pairs), 2), "00" * 16, pairs)
    return fields(p, enterprise.radius(F.col("payload")), code="m.code", identifier="m.identifier", user_name="m.user", nas_ip="m.nas_ip", has_password="m.has_password")


@query(f"SELECT event_id, 'v2c' AS version, {KIND8} AS community, 'get' AS pdu, CAST(event_id % 32768 AS BIGINT) AS request_id, '1.3.6.1.2.1.1.' || (128 + user_id % 1000) AS oid FROM events")
def snmp_messages(spark, sf_dir):
    arc = 128 + F.col("user_id") % 1000
    oid = F.concat(F.lit("2B0601020101"), h(128 + F.floor(arc / 128), 1), h(arc % 128, 1))
    pdu = element("A0", element("02", (h(F.col("event_id") % 32768, 2), 2)), "020100" + "020100", element("30", element("30", element("06", (oid, 8)), "0500")))
    p = trees(made(spark, sf_dir, element("30", "020101", element("04", kind8()), pdu)[0]))
    return fields(p, enterprise.snmp(F.col("tree")), version="m.version", community="m.community", pdu="m.pdu", request_id="m.request_id", oid="m.oids[0]")


@query("SELECT event_id, 'request' AS kind, event_type AS cookie, 'ssl,hybrid' AS protocols FROM events")
def rdp_requests(spark, sf_dir):
    cookie = F.concat(text_hex("Cookie: mstshash="), said(), F.lit("0D0A"))
    p = made(spark, sf_dir, "0300", h(19 + n(cookie), 2), h(14 + n(cookie), 1), "E0" + "0000000000", cookie, "01000800" + "03000000")
    return fields(p, enterprise.rdp(F.col("payload")), kind="m.kind", cookie="m.cookie", protocols="array_join(m.protocols, ',')")


@query("""SELECT event_id, ['http2', 'tls', 'ssh', 'http', 'raw', 'http'][event_id % 6 + 1] AS protocol FROM events""")
def classify_first_bytes(spark, sf_dir):
    starts = F.array(*[F.lit(x) for x in (web.PREFACE, b"\x16\x03\x01\x00", b"SSH-2.0-x", b"POST / HTTP/1.1", b"\x00\x01\x02", b"HTTP/1.1 200")])
    first = F.element_at(starts, (F.col("event_id") % 6 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", scalars.first_bytes(F.concat(first, F.col("event_type").cast("binary"))).alias("protocol"))
