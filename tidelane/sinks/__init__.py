"""Lines for other tools: each sink is a column of text, written with Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso(us: Column) -> Column:
    """ISO 8601 with six decimals, in UTC whatever the session's zone."""
    seconds = F.floor(us / 1_000_000)
    base = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.lit("."), F.lpad((us - seconds * 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def delimited(frame: DataFrame, columns: list[str], mark: str = ",") -> DataFrame:
    """line: the columns as text, null as nothing; texts with the mark, a quote or a line end are quoted."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        risky = text.contains(mark) | text.contains('"') | text.contains("\n")
        return F.when(risky, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return frame.select(F.concat_ws(mark, *[cell(c) for c in columns]).alias("line"))


def zeek(frame: DataFrame, columns: list[str]) -> DataFrame:
    """line: tab-separated fields, a hyphen for null."""
    return frame.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("line"))


def ndjson(frame: DataFrame, kind: str) -> DataFrame:
    """line: one JSON object for each row, its type first; nulls are left out."""
    return frame.select(F.to_json(F.struct(F.lit(kind).alias("type"), *frame.columns)).alias("line"))


def eve(frame: DataFrame, event_type: str, us: str) -> DataFrame:
    """line: a JSON event with timestamp, event_type and the rest under the name of that type."""
    rest = [c for c in frame.columns if c != us]
    return frame.select(F.to_json(F.struct(iso(F.col(us)).alias("timestamp"), F.lit(event_type).alias("event_type"), F.struct(*rest).alias(event_type))).alias("line"))


#: Columns of flow lines and of connection logs.
FLOW_COLUMNS = "start_sec end_sec duration_sec proto src_ip src_port dst_ip dst_port pkts_init pkts_resp bytes_init bytes_resp retransmits_init retransmits_resp end_reason ip_bytes_init ip_bytes_resp".split()
ZEEK_COLUMNS = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto duration orig_bytes resp_bytes conn_state history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes".split()


def seconds(us: Column) -> Column:
    """Seconds with six decimals, as text."""
    return F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def flow_lines(flows: DataFrame, mark: str = ",", kind: Column | None = None) -> DataFrame:
    """line: the seventeen columns of each ended flow (start_us, end_us and the columns' own names); kind comes first if given."""
    cells = [seconds(F.col("start_us")), seconds(F.col("end_us")), seconds(F.col("end_us") - F.col("start_us")), *[F.col(c).cast("string") for c in FLOW_COLUMNS[3:]]]
    return flows.select(F.concat_ws(mark, *([kind] if kind is not None else []), *[F.coalesce(c, F.lit("")) for c in cells]).alias("line"))


def zeek_conn(flows: DataFrame) -> DataFrame:
    """line: the sixteen tab-separated columns of each ended flow. uid is a hash of the flow, so it doesn't depend on the writer."""
    uid = F.concat(F.lit("C"), F.lower(F.lpad(F.hex(F.xxhash64("proto", "src_ip", "src_port", "dst_ip", "dst_port", "start_us")), 16, "0")))
    cells = [seconds(F.col("start_us")), uid, F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.lower("proto"), seconds(F.col("end_us") - F.col("start_us")), *[F.col(c) for c in ("bytes_init", "bytes_resp", "conn_state", "history", "pkts_init", "ip_bytes_init", "pkts_resp", "ip_bytes_resp")]]
    return flows.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cells]).alias("line"))


def zeek_header() -> list[str]:
    """Lines before those of zeek_conn."""
    kinds = "time string addr port addr port enum interval count count string string count count count count".split()
    return ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tconn", "\t".join(["#fields", *ZEEK_COLUMNS]), "\t".join(["#types", *kinds])]


SEVERITY = {"critical": 1, "error": 2, "warning": 3, "info": 4}


def eve_anomalies(found: DataFrame) -> DataFrame:
    """line: JSON events of anomalies (us, kind, severity, technique, src)."""
    number = F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p]), F.col("severity"))
    body = F.struct(F.col("kind").alias("event"), number.alias("severity"), "technique", "src")
    return found.select(F.to_json(F.struct(iso(F.col("us")).alias("timestamp"), F.lit("anomaly").alias("event_type"), body.alias("anomaly"))).alias("line"))


#: Number and size of each element of a flow record, by template; element 8 or 27 is the source address.
TEMPLATES = {
    256: ((4, 1), (7, 2), (8, 4), (11, 2), (12, 4), (1, 8), (2, 8), (85, 8), (86, 8), (152, 8), (153, 8), (6, 2), (136, 1)),
    257: ((4, 1), (7, 2), (27, 16), (11, 2), (28, 16), (1, 8), (2, 8), (85, 8), (86, 8), (152, 8), (153, 8), (6, 2), (136, 1)),
}
ELEMENTS = {1: "octetDeltaCount", 2: "packetDeltaCount", 4: "protocolIdentifier", 6: "tcpControlBits", 7: "sourceTransportPort", 8: "sourceIPv4Address", 11: "destinationTransportPort", 12: "destinationIPv4Address", 27: "sourceIPv6Address", 28: "destinationIPv6Address", 85: "octetTotalCount", 86: "packetTotalCount", 136: "flowEndReason", 152: "flowStartMilliseconds", 153: "flowEndMilliseconds"}


def element_name(number: Column) -> Column:
    """Name of an element of flow records; null for other numbers."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in ELEMENTS.items() for x in p]), number.cast("int"))


def element_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, e in ELEMENTS.items() for x in (e, n)]), name)


def template_set(template: int) -> str:
    """The set that announces a template, in hexadecimal."""
    fields = "".join(f"{i:04X}{n:04X}" for i, n in TEMPLATES[template])
    return f"0002{8 + len(fields) // 2:04X}{template:04X}{len(TEMPLATES[template]):04X}{fields}"


def ipfix_record(template: int = 256) -> Column:
    """A flow's record in hexadecimal. Columns: proto_number, src_port, dst_port, src_hex, dst_hex, octets, packets, start_ms, end_ms, control, end_reason."""
    value = {4: "proto_number", 7: "src_port", 11: "dst_port", 1: "octets", 2: "packets", 85: "octets", 86: "packets", 152: "start_ms", 153: "end_ms", 6: "control", 136: "end_reason"}
    address = {8: "src_hex", 12: "dst_hex", 27: "src_hex", 28: "dst_hex"}
    return F.concat(*[F.col(address[i]) if i in address else F.lpad(F.hex(F.col(value[i]).cast("long")), 2 * n, "0") for i, n in TEMPLATES[template]])


def ipfix_messages(flows: DataFrame, export_s: int, domain: int, template: int = 256, most: int = 20) -> DataFrame:
    """number, message: binary messages of RFC 7011 with the template and up to `most` records each.

    Records are numbered within partitions, so that building messages needs no order over all flows. A partition is an
    observation domain of its own (`domain` and the partition's number), and stands in the upper half of `number`; the sequence
    number counts the records before a message in its domain, so collectors see no loss.
    """
    size = sum(n for _, n in TEMPLATES[template])
    each = flows.select(F.monotonically_increasing_id().alias("n"), ipfix_record(template).alias("r"))
    place = F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    each = each.select(F.shiftright("n", 33).alias("p"), F.floor(place / most).alias("m"), "n", "r")
    packed = each.groupBy("p", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]), "").alias("data"), F.count("*").alias("records"))
    head = template_set(template)
    h = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    total = 16 + len(head) // 2 + 4 + F.col("records") * size
    message = F.concat(F.lit("000A"), h(total, 2), F.lit(f"{export_s:08X}"), h(F.col("m") * most, 4), h(F.lit(domain) + F.col("p"), 4), F.lit(f"{head}{template:04X}"), h(4 + F.col("records") * size, 2), F.col("data"))
    return packed.select((F.shiftleft("p", 32) + F.col("m")).alias("number"), F.col("records"), F.unhex(message).alias("message"))
