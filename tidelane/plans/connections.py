"""Queries over whole connections: bytes of both sides, put together out of table columns, and what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.scalars import let
from tidelane.functions.wire import frame_of, text_hex
from tidelane.operators import enrich, folds, sessions
from tidelane.parsers import certificates, http2, quic, web
from tidelane.plans.messages import HOST, client_hello_hex, h, host, host_hex, n
from tidelane.plans.packets import ETHERNET, SRC, events, ipv4, low_address, source_port
from tidelane.plans.registry import query


def h2_frame(kind: str, flags: str | Column, stream: Column, body: Column) -> Column:
    return F.concat(h(n(body), 3), F.lit(kind), F.lit(flags) if isinstance(flags, str) else flags, h(stream, 4), body)


def literal(name: str, value: Column | str, added: bool = False) -> Column:
    """A field with a name and a value of its own (under 127 bytes each), added to the header table or not."""
    v = text_hex(value)
    return F.concat(F.lit("40" if added else "00"), h(len(name), 1), text_hex(name), h(n(v), 1), v)


def h2_chunks(spark, sf_dir) -> DataFrame:
    """A connection for each user, a stream for each event: numbered by place, so that blocks refer to fields of earlier streams.

    The first request adds authority and a name to the table; later ones refer to both. Every third block goes on in a
    continuation, every second data frame is padded, answers come after the next request, and each chunk is cut in two.
    """
    ev = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    ev = ev.withColumn("i", F.expr("row_number() over (partition by user_id order by at, event_id)"))
    stream, path = F.col("i") * 2 - 1, F.concat(F.lit("/shop.Cart/"), F.col("event_type"))
    # :authority by code, as the static table's first name; then 62 and 63 stand for both
    added = F.concat(F.lit("418C" + "F1E3C2E5F23A6BA0AB90F4FF"), literal("x-user", F.col("user_id").cast("string"), added=True))
    known = F.when(F.col("i") == 1, added).otherwise("BFBE")
    block = F.concat(F.lit("8386"), F.lit("04"), h(n(text_hex(path)), 1), text_hex(path), known, literal("content-type", F.lit("application/grpc")))
    cut = F.when(F.col("event_id") % 3 == 0, 6).otherwise(F.length(block)).cast("int")
    rest = F.substring(block, cut + 1, F.length(block))
    head = F.when(F.col("event_id") % 3 == 0, F.concat(h2_frame("01", "00", stream, F.substring(block, F.lit(1), cut)), h2_frame("09", "04", stream, rest))).otherwise(h2_frame("01", "04", stream, block))
    body = text_hex(F.col("event_type"))
    data = F.when(F.col("event_id") % 2 == 0, h2_frame("00", "09", stream, F.concat(F.lit("03"), body, F.lit("000000")))).otherwise(h2_frame("00", "01", stream, body))
    code = (F.col("user_id") % 17).cast("string")
    full = F.concat(h2_frame("01", "04", stream, F.lit("88")), h2_frame("00", "00", stream, F.concat(body, body)), h2_frame("01", "05", stream, literal("grpc-status", code)))
    alone = h2_frame("01", "05", stream, F.concat(F.lit("88"), literal("grpc-status", code), literal("grpc-message", F.lit("none"))))
    reset = h2_frame("03", "00", stream, F.lit("00000008"))
    answer = F.when(F.col("event_id") % 7 == 0, reset).when(F.col("event_id") % 5 == 0, alone).otherwise(full)
    opening = F.when(F.col("i") == 1, F.concat(text_hex(web.PREFACE.decode()), F.lit("000000" + "0400" + "00000000"))).otherwise("")
    sent = F.array(F.struct((F.col("i") * 4).alias("us"), F.lit("initiator").alias("side"), frame_of(opening, head, data).alias("payload")), F.struct((F.col("i") * 4 + 6).alias("us"), F.lit("responder").alias("side"), frame_of(answer).alias("payload")))
    each = ev.select("user_id", F.explode(sent).alias("c")).select("user_id", "c.us", "c.side", "c.payload")
    halves = F.array(F.struct(F.lit(0).alias("seq"), F.expr("substr(payload, 1, 11)").alias("payload")), F.struct(F.lit(1).alias("seq"), F.expr("substr(payload, 12)").alias("payload")))
    return each.select("user_id", "us", "side", F.explode(halves).alias("p")).select("user_id", "us", (F.col("p.seq") + F.when(F.col("side") == "initiator", 0).otherwise(2)).cast("long").alias("seq"), "side", "p.payload")


def h2_parts(spark, sf_dir) -> int:
    """Partitions for the chunks, of which there are four for each event."""
    return folds.parts_for(spark, 4 * events(spark, sf_dir).count())


H2 = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH {H2} SELECT CAST(user_id AS BIGINT) AS user_id, CAST(2 * i - 1 AS BIGINT) AS stream, 'POST' AS method, 'http' AS scheme, 'www.example.com' AS authority, '/shop.Cart/' || event_type AS path, CAST(user_id AS VARCHAR) AS name,
CASE WHEN event_id % 7 > 0 THEN 200 END AS status, CAST(length(event_type) AS BIGINT) AS request_bytes, CAST(CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0 ELSE 2 * length(event_type) END AS BIGINT) AS response_bytes, CASE WHEN event_id % 7 = 0 THEN 'reset' ELSE 'completed' END AS outcome FROM e""")
def http2_streams(spark, sf_dir):
    """Requests and answers of all streams of each connection."""
    parts = h2_parts(spark, sf_dir)
    got = http2.h2_exchanges(http2.h2_events(h2_chunks(spark, sf_dir), ["user_id"], parts=parts), ["user_id"], parts)
    return got.select("user_id", "stream", "method", "scheme", "authority", "path", http2.value(F.col("request"), "x-user").alias("name"), "status", "request_bytes", "response_bytes", "outcome")


@query(f"""WITH {H2}, k AS (SELECT user_id, side, event, s FROM e, LATERAL (SELECT unnest(['initiator', 'initiator', 'initiator']) AS side, unnest(['head', 'body', 'end']) AS event, 1 AS s UNION ALL SELECT 'responder', unnest(CASE WHEN event_id % 7 = 0 THEN ['reset'] WHEN event_id % 5 = 0 THEN ['head', 'end'] ELSE ['head', 'body', 'trailers', 'end'] END), 1))
SELECT CAST(user_id AS BIGINT) AS user_id, side, event, count(*) AS events FROM k GROUP BY ALL""")
def http2_event_counts(spark, sf_dir):
    """How often each thing happens on a connection; none of them fails."""
    return http2.h2_events(h2_chunks(spark, sf_dir), ["user_id"], parts=h2_parts(spark, sf_dir)).groupBy("user_id", "side", "event").agg(F.count("*").alias("events"))


@query(f"""WITH {H2} SELECT CAST(user_id AS BIGINT) AS user_id, CAST(2 * i - 1 AS BIGINT) AS stream, 'shop.Cart' AS service, event_type AS method, CASE WHEN event_id % 7 > 0 THEN CAST(user_id % 17 AS INTEGER) END AS code,
CASE WHEN event_id % 7 > 0 THEN ['ok', 'cancelled', 'unknown', 'invalid_argument', 'deadline_exceeded', 'not_found', 'already_exists', 'permission_denied', 'resource_exhausted', 'failed_precondition', 'aborted', 'out_of_range', 'unimplemented', 'internal', 'unavailable', 'data_loss', 'unauthenticated'][user_id % 17 + 1] END AS status, CASE WHEN event_id % 7 > 0 AND event_id % 5 = 0 THEN 'none' END AS message FROM e""")
def grpc_streams(spark, sf_dir):
    """Calls with the status of their trailers, or of the only block of an answer."""
    parts = h2_parts(spark, sf_dir)
    got = http2.grpc_calls(http2.h2_exchanges(http2.h2_events(h2_chunks(spark, sf_dir), ["user_id"], parts=parts), ["user_id"], parts))
    return got.select("user_id", "stream", "service", F.col("grpc_method").alias("method"), F.col("grpc_status").alias("code"), F.col("grpc_status_name").alias("status"), F.col("grpc_message").alias("message"))


def sealed(plain: Column, pn: Column) -> Column:
    """An Initial packet of a row's dcid, version (v2) and keys (k), with a number of two bytes; each part is made once."""
    first, keys = F.when(F.col("v2"), 0xD1).otherwise(0xC1), F.col("k")
    version = F.when(F.col("v2"), F.lit("6B3343CF")).otherwise("00000001")
    head = lambda b, p, size: F.unhex(F.concat(h(b, 1), version, F.lit("08"), F.hex("dcid"), F.lit("00" + "00"), h(size + 18 + 0x4000, 2), h(p, 2)))
    boxed = lambda x: F.substring(F.aes_encrypt(x, keys["key"], F.lit("GCM"), F.lit("DEFAULT"), quic.nonce_of(keys["iv"], pn), head(first, pn, F.length(x))), 13, 1 << 20)
    masked = lambda b: let(quic.mask_of(F.substring(b, 3, 16), keys["hp"]), lambda m: F.concat(head(first.bitwiseXOR(wire.uint(m, 0, 1).bitwiseAND(F.lit(15))), pn.bitwiseXOR(wire.uint(m, 1, 2)), F.length(b) - 16), b))
    return let(plain, lambda x: let(boxed(x), masked))


def quic_packets(spark, sf_dir) -> DataFrame:
    """Two Initial packets for each event that share its ClientHello, the second half first; every fifth event lacks one half."""
    message = F.substring(client_hello_hex(), 11, 1 << 20)
    ev = events(spark, sf_dir).select("event_id", F.unhex(message).alias("hello"), (F.col("event_id") % 2 == 1).alias("v2"), F.unhex(h(F.col("event_id"), 8)).alias("dcid"))
    ev = ev.withColumn("k", quic.keys_of(F.col("dcid"), F.when(F.col("v2"), 0x6B3343CF).otherwise(1)))
    half = (30 + F.col("event_id") % 50).cast("int")
    crypto = lambda at, data: F.concat(F.unhex(F.concat(F.lit("06"), h(at + 0x4000, 2), h(F.length(data) + 0x4000, 2))), data)
    front = F.concat(crypto(F.lit(0), wire.cut(F.col("hello"), 0, half)), F.unhex(F.lit("00" * 40)))
    back = F.concat(F.unhex(F.lit("01" + "0200000000")), crypto(half, wire.rest(F.col("hello"), half)))
    sent = ev.withColumn("i", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    payload = sealed(F.when(F.col("i") == 0, back).otherwise(front), 1 - F.col("i"))
    return sent.select("event_id", F.col("i").cast("long").alias("us"), F.col("i").cast("long").alias("seq"), payload.alias("payload"))


@query("""SELECT event_id, printf('%016x', event_id) AS dcid, CASE WHEN event_id % 2 = 1 THEN 'v2' ELSE 'v1' END AS version, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS packets, CASE WHEN event_id % 5 > 0 THEN event_type || '.example.org' END AS sni, CASE WHEN event_id % 5 > 0 THEN 'h2,http/1.1' END AS alpn,
CASE WHEN event_id % 5 > 0 THEN 'q13d0206h2_' || substring(sha256('1301,' || printf('%04x', 49152 + user_id % 256)), 1, 12) || '_' || substring(sha256('0000,000a,000b,0010,002b,0033'), 1, 12) END AS ja4 FROM events""")
def quic_hellos(spark, sf_dir):
    """Names and fingerprints of encrypted hellos that two packets share."""
    got = quic.quic_hellos(quic_packets(spark, sf_dir), ["event_id"])
    return got.select("event_id", F.lower(F.hex("dcid")).alias("dcid"), "version", "packets", "sni", F.array_join("alpn", ",").alias("alpn"), "ja4")


def captured(spark, sf_dir) -> DataFrame:
    """Frames of a flow for each event: an HTTP exchange of even ones, a DNS exchange of odd ones, as one capture file.

    The request comes in two segments, the second first; both sides close. Sequence numbers wrap within the request of some events.
    What frames share is made once for each event, and a frame's headers after its bytes, which they count.
    """
    id_, kind, text = F.col("event_id"), F.col("event_type"), lambda *parts: F.hex(F.concat(*parts).cast("binary"))
    web_ = id_ % 2 == 0
    name = F.concat(h(n(host_hex()), 1), host_hex(), F.lit("03636F6D00" + "0001" + "0001"))
    ev = events(spark, sf_dir).select(
        "event_id", h(source_port(), 2).alias("port"), F.concat(F.lit("C0A8"), h(F.floor(id_ / 60000), 2)).alias("server"), low_address().alias("client"), (id_ * 977 + (1 << 32) - 40).alias("c"), (id_ * 31).alias("s"),
        F.when(web_, text(F.lit("GET /"), kind)).alias("one"), F.when(web_, text_hex(F.concat(F.lit("for "), kind))).alias("body"), F.concat(F.lit("HTTP/1.1 "), (200 + F.col("user_id") % 300).cast("string"), F.lit(" ok\r\nContent-Length: ")).alias("top"),
        h(id_ % 65536, 2).alias("id"), F.when(~web_, name).alias("name"),
    )
    ev = ev.withColumn("answer", F.when(web_, F.concat(text(F.col("top"), n(F.col("body")).cast("string"), F.lit("\r\n\r\n")), F.col("body"))))
    two, said = F.lit(b" HTTP/1.1\r\nHost: shop.example\r\n\r\n".hex().upper()), n(F.col("answer"))
    ev = ev.withColumn("first", F.col("c") + 1 + n(F.col("one"))).withColumn("asked", F.col("first") + n(two)).withColumn("said", F.col("s") + 1 + said)
    c, s, first, asked, told = (F.col(x) for x in ("c", "s", "first", "asked", "said"))
    sent = lambda forward, seq, ack, flags, data="": F.struct(F.lit(forward).alias("forward"), seq.alias("seq"), ack.alias("ack"), F.lit(flags).alias("flags"), (F.lit(data) if isinstance(data, str) else data).alias("data"))
    tcp = F.array(
        sent(True, c, s * 0, "02"), sent(False, s, c + 1, "12"), sent(True, c + 1, s + 1, "10"), sent(True, first, s + 1, "18", two), sent(True, c + 1, s + 1, "18", F.col("one")), sent(False, s + 1, asked, "18", F.col("answer")),
        sent(True, asked, told, "11"), sent(False, told, asked + 1, "11"), sent(True, asked + 1, told + 1, "10"),
    )
    none = F.lit(None).cast("long")
    question = F.concat(F.col("id"), F.lit("0100" + "0001" + "0000" * 3), F.col("name"))
    reply = F.concat(F.col("id"), F.lit("8180" + "0001" + "0001" + "0000" * 2), F.col("name"), F.lit("C00C" + "0001" + "0001" + "0000003C" + "0004"), F.col("client"))
    udp_ = F.array(sent(True, none, none, "", question), sent(False, none, none, "", reply))
    each = ev.select("event_id", "port", "server", "client", F.posexplode(F.when(web_, tcp).otherwise(udp_)).alias("i", "p"))
    forward, data = F.col("p.forward"), F.col("p.data")
    ports = lambda of: F.when(forward, F.concat(F.col("port"), F.lit(of))).otherwise(F.concat(F.lit(of), F.col("port")))
    number = lambda x: h(F.col(x) % (1 << 32), 4)
    segment = F.concat(ports("0050"), number("p.seq"), number("p.ack"), F.lit("50"), F.col("p.flags"), F.lit("FFFF" + "00000000"), data)
    carried = each.select("event_id", "i", F.when(web_, segment).otherwise(F.concat(ports("0035"), h(8 + n(data), 2), F.lit("0000"), data)).alias("body"), F.when(web_, "06").otherwise("11").alias("proto"), F.when(forward, F.concat("client", "server")).otherwise(F.concat("server", "client")).alias("ends"))
    frame = F.concat(F.lit(ETHERNET + "0800" + "4500"), h(20 + n(F.col("body")), 2), F.lit("00000000" + "40"), F.col("proto"), F.lit("0000"), F.col("ends"), F.col("body"))
    return carried.select(F.lit("events").alias("path"), (id_ * 16 + F.col("i")).alias("seq"), F.col("i").cast("long").alias("us"), F.unhex(frame).alias("frame"))


#: The event of a flow, out of its key: the client's port, and how often 60,000 events came before.
FLOW_EVENT = "cast(60000 * (256 * cast(split_part(k.server, '.', 3) as long) + cast(split_part(k.server, '.', 4) as long)) + (k.port - 1024) as long)"


def by_event(rows: DataFrame) -> DataFrame:
    """`rows` of flows with event_id in place of their key."""
    rows, k = rows.withColumn("k", sessions.key_fields(F.col("key"))), F.col("k")
    first = k["a_ip"].startswith("10.")
    named = rows.withColumn("k", F.struct(F.when(first, k["b_ip"]).otherwise(k["a_ip"]).alias("server"), F.when(first, k["a_port"]).otherwise(k["b_port"]).alias("port")))
    return named.withColumn("event_id", F.expr(FLOW_EVENT))


@query("SELECT event_id, unnest([TRUE, FALSE]) AS is_request, unnest(['initiator', 'responder']) AS side, unnest(['/' || event_type, NULL]) AS path, unnest([NULL, CAST(200 + user_id % 300 AS INTEGER)]) AS status, unnest(['', CASE WHEN user_id % 300 IN (4, 104) THEN '' ELSE 'for ' || event_type END]) AS body, unnest([CAST(4 AS BIGINT), 5]) AS us FROM events WHERE event_id % 2 = 0")
def capture_http(spark, sf_dir):
    """HTTP messages of a capture's flows, from frames on; answers with 204 and 304 have no body."""
    m = by_event(sessions.http_messages(sessions.tracked(captured(spark, sf_dir))))
    return m.select("event_id", F.col("message.is_request").alias("is_request"), "side", F.col("message.path").alias("path"), F.col("message.status").alias("status"), F.col("message.body").alias("body"), "us")


@query(f"SELECT event_id, unnest([FALSE, TRUE]) AS is_response, {HOST} || '.com' AS qname, unnest([NULL, {SRC}]) AS address, CAST(event_id % 65536 AS BIGINT) AS id FROM events WHERE event_id % 2 = 1")
def capture_dns(spark, sf_dir):
    """DNS messages of a capture's flows, from frames on."""
    m = by_event(sessions.dns_messages(sessions.tracked(captured(spark, sf_dir))))
    return m.select("event_id", F.col("message.is_response").alias("is_response"), F.get(F.col("message.questions"), F.lit(0))["name"].alias("qname"), F.get(F.col("message.records"), F.lit(0))["value"].alias("address"), F.col("message.id").alias("id"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'started,established,GET /' || event_type || ',' || (200 + user_id % 300) || ',ended fin' ELSE 'started,asks,answers,ended idle_timeout' END AS pulses FROM events""")
def capture_pulses(spark, sf_dir):
    """Lifecycle and messages of each flow in the order in which they happened on the wire."""
    parts = folds.parts_for(spark, 9 * events(spark, sf_dir).count())
    p = sessions.captured_pulses(captured(spark, sf_dir), http="struct<method:string,path:string,status:int>", dns="struct<is_response:boolean>", parts=parts)
    http, dns = F.col("http"), F.col("dns")
    said = F.when(F.col("pulse") == "ended", F.concat_ws(" ", "pulse", "reason")).when(F.col("protocol") == "http", F.coalesce(F.concat_ws(" ", http["method"], http["path"]), F.lit(""))).when(F.col("protocol") == "dns", F.when(dns["is_response"], "answers").otherwise("asks")).otherwise(F.col("pulse"))
    said = F.when(http["status"].isNotNull(), http["status"].cast("string")).otherwise(said)
    rows = p.select("key", F.struct("us", "seq", "n", said.alias("t")).alias("r")).groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return by_event(rows).select("event_id", F.array_join("rs.t", ",").alias("pulses"))


def der(tag: str, body: Column) -> Column:
    """An element around `body`, which is named once, as elements hold elements."""

    def around(b: Column) -> Column:
        size = n(b)
        return F.concat(F.lit(tag), F.when(size < 128, h(size, 1)).when(size < 256, F.concat(F.lit("81"), h(size, 1))).otherwise(F.concat(F.lit("82"), h(size, 2))), b)

    return let(body, around)


def named_hex(common: Column) -> Column:
    """A name of one organization and a common name, in hexadecimal."""
    attribute = lambda kind, value: der("31", der("30", F.concat(F.lit("0603" + kind), der("0C", text_hex(value)))))
    return der("30", F.concat(attribute("55040A", "Shop"), attribute("550403", common)))


@query(f"""SELECT event_id, CAST(2 AS BIGINT) AS n, 'O=Shop,CN=' || {HOST} AS subject, 'O=Shop,CN=' || CASE WHEN event_id % 3 = 0 THEN {HOST} ELSE 'authority' END AS issuer, printf('%08x', event_id) AS serial, CASE WHEN user_id % 2 = 0 THEN '2010-03-04 05:06:07' ELSE '2060-03-04 05:06:07' END AS not_after, {HOST} || '.example,10.0.0.1' AS names,
concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'tls_self_signed' END, CASE WHEN user_id % 2 = 0 THEN 'tls_expired_cert' END) AS risks FROM events""")
def tls_certificates(spark, sf_dir):
    """A server's own certificate out of a chain of two: names, validity, and the risks in them."""
    subject = named_hex(host())
    issuer = F.when(F.col("event_id") % 3 == 0, subject).otherwise(named_hex(F.lit("authority")))
    ends = F.when(F.col("user_id") % 2 == 0, der("17", text_hex("100304050607Z"))).otherwise(der("18", text_hex("20600304050607Z")))
    further = der("30", F.concat(der("82", text_hex(F.concat(host(), F.lit(".example")))), F.lit("87040A000001")))
    extensions = der("A3", der("30", F.concat(der("30", F.lit("0603551D13" + "04023000")), der("30", F.concat(F.lit("0603551D11"), der("04", further))))))
    fields_ = F.concat(F.lit("A003020102" + "0204"), h(F.col("event_id"), 4), F.lit("300D06092A864886F70D01010B0500"), issuer, der("30", F.concat(der("17", text_hex("991231235959Z")), ends)), subject, F.lit("3003030100"), extensions)
    one = der("30", F.concat(der("30", fields_), F.lit("300D06092A864886F70D01010B0500" + "03020000")))
    body = let(one, lambda c: F.concat(h(n(c), 3), c, F.lit("000003" + "300100")))
    message = let(body, lambda b: F.concat(F.lit("0B"), h(n(b) + 3, 3), h(n(b), 3), b))
    p = events(spark, sf_dir).withColumn("payload", F.unhex(let(message, lambda m: F.concat(F.lit("160303"), h(n(m), 2), m)))).withColumn("chain", certificates.chain(web.handshakes(F.col("payload"))))
    p = p.withColumn("c", certificates.certificate(F.get("chain", F.lit(0))))
    risks = enrich.risk_summary(enrich.risk_of_certificate(F.col("c"), F.lit(1_700_000_000_000_000)))["names"]
    return p.select("event_id", F.size("chain").cast("long").alias("n"), "c.subject", "c.issuer", "c.serial", F.date_format(F.timestamp_micros("c.not_after_us"), "yyyy-MM-dd HH:mm:ss").alias("not_after"), F.array_join("c.names", ",").alias("names"), F.array_join(risks, ",").alias("risks"))
