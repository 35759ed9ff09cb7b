"""What is made of flows and messages: records, feature vectors, risks, assets, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.wire import bit, words_of_flags
from tidelane.operators.flows import in_order

#: Flags of the TCP header by bit, and how the reasons of ends are numbered and named in exports.
CONTROL = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
END_REASONS = {"idle_timeout": 1, "active_timeout": 2, "fin": 3, "rst": 3, "parser_done": 3, "force_closed": 4, "evicted": 5, "buffer_overflow": 5, "parse_error": 5, "stream_gap": 5}
ZEEK_STATES = {"fin": "SF", "parser_done": "SF", "rst": "RSTO", "buffer_overflow": "S0", "parse_error": "REJ"}
GRACEFUL, TRANSPORT, PARSER = ("fin", "parser_done"), ("fin", "rst", "idle_timeout"), ("parse_error", "parser_done", "stream_gap")
#: Risks by bit, with severity and weight.
RISKS = {
    0: ("known_proto_nonstd_port", "low", 10), 1: ("port_proto_mismatch", "medium", 50), 2: ("tls_self_signed", "medium", 50), 3: ("tls_expired_cert", "medium", 50), 4: ("tls_weak_cipher", "medium", 60),
    5: ("tls_obsolete_version", "medium", 50), 6: ("sni_dns_mismatch", "medium", 50), 7: ("dga_domain", "high", 100), 8: ("cleartext_credentials", "high", 100), 9: ("obsolete_protocol", "medium", 50),
    10: ("suspicious_ja4", "high", 100), 11: ("binary_transfer", "medium", 50), 12: ("punycode_idn", "medium", 50), 13: ("malformed_packet", "low", 10),
}
SEVERITIES = ("low", "medium", "high", "severe")


def table_of(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key)


def control_bits(**flags: Column) -> Column:
    """Named flags (fin, syn, ...) as one number."""
    return sum((F.when(flags[name], 1 << i).otherwise(0) for i, name in enumerate(CONTROL) if name in flags), F.lit(0))


def zeek_state(reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.coalesce(table_of(ZEEK_STATES, reason), F.lit("OTH")))


def end_kind(reason: Column) -> Column:
    """struct<graceful, transport, parser>: what kind of end a reason is."""
    return F.struct(reason.isin(*GRACEFUL).alias("graceful"), reason.isin(*TRANSPORT).alias("transport"), reason.isin(*PARSER).alias("parser"))


def flow_records(tracked: DataFrame, key: str) -> DataFrame:
    """One row for each flow, from initiator to responder: counts, milliseconds, control bits of either side, end reason.

    tracked: packets with their lifecycle (flow_no, side, reason), flags and bytes.
    """
    side = lambda name, f, c: f(F.when(F.col("side") == name, c))
    each = tracked.groupBy(key, "flow_no").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.coalesce(F.max("reason"), F.lit("idle_timeout")).alias("reason"),
        *[side(s, F.count, F.lit(1)).alias(f"packets_{s}") for s in ("initiator", "responder")],
        *[F.coalesce(side(s, F.sum, F.col("bytes")), F.lit(0)).alias(f"bytes_{s}") for s in ("initiator", "responder")],
        *[F.coalesce(side(s, F.bit_or, F.col("flags")), F.lit(0)).cast("int").alias(f"flags_{s}") for s in ("initiator", "responder")],
    )
    return each.withColumn("start_ms", F.floor(F.col("start_us") / 1000)).withColumn("end_ms", F.floor(F.col("end_us") / 1000)).withColumn("end_reason", table_of(END_REASONS, F.col("reason")))


def feature_vectors(records: DataFrame, gaps: DataFrame, activity: DataFrame, key: str) -> DataFrame:
    """Features of each flow record: totals, means, rates, ratio, presence of flags, state, gaps, active and idle times.

    gaps: of `side_gaps`; activity: of `active_idle_stats`. Times are in microseconds; what can't be told is 0.
    """
    none = lambda c: F.coalesce(c, F.lit(0.0))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    fp, bp, fb, bb = (F.col(c) for c in ("packets_initiator", "packets_responder", "bytes_initiator", "bytes_responder"))
    us = (F.col("end_ms") - F.col("start_ms")) * 1000
    flags = [F.shiftright(F.col(f"flags_{s}"), i).bitwiseAND(F.lit(1)).alias(f"{p}_{n}") for s, p in (("initiator", "fwd"), ("responder", "bwd")) for i, n in enumerate(CONTROL)]
    state = F.when(F.col("end_reason") == 3, "SF").otherwise("OTH")
    joined = records.join(gaps, [key, "flow_no"], "left").join(activity, [key, "flow_no"], "left")
    stats = [none(F.col(f"{c}_{n}")).alias(f"{c}_iat_{n}_us") for c in ("flow", "fwd", "bwd") for n in ("mean", "std", "min", "max")]
    times = [none(F.col(f"{c}_{n}")).alias(f"{c}_{n}_us") for c in ("active", "idle") for n in ("mean", "std", "min", "max")]
    return joined.select(
        key, "flow_no", us.alias("flow_duration_us"), fp.alias("total_fwd_packets"), bp.alias("total_bwd_packets"), fb.alias("total_fwd_bytes"), bb.alias("total_bwd_bytes"),
        per(fb, fp).alias("fwd_packet_length_mean"), per(bb, bp).alias("bwd_packet_length_mean"), per(fb + bb, fp + bp).alias("mean_packet_length"),
        per(fb + bb, us / 1e6).alias("flow_bytes_per_sec"), per(fp + bp, us / 1e6).alias("flow_packets_per_sec"), per(bb, fb).alias("down_up_ratio"),
        F.struct(*flags).alias("tcp_flags"), state.alias("conn_state"), *stats, *times,
    )


def active_idle_stats(tracked: DataFrame, key: str, threshold_us: int = 1_000_000) -> DataFrame:
    """key, flow_no, mean, std, min, max of a flow's active periods and of the gaps over the threshold between them.

    The period that is open at the end doesn't count.
    """
    gap = F.col("us") - F.lag("us").over(in_order(key, "flow_no"))
    runs = tracked.withColumn("gap", gap).withColumn("run", F.sum(F.coalesce(F.col("gap") > threshold_us, F.lit(False)).cast("long")).over(in_order(key, "flow_no")))
    each = runs.groupBy(key, "flow_no", "run").agg((F.max("us") - F.min("us")).alias("active"), F.max(F.when(F.col("gap") > threshold_us, F.col("gap"))).alias("idle"))
    each = each.withColumn("active", F.when(F.col("run") < F.max("run").over(Window.partitionBy(key, "flow_no")), F.col("active")))
    return each.groupBy(key, "flow_no").agg(*[f(c).alias(f"{c}_{n}") for c in ("active", "idle") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def risk_bits(**risks: Column) -> Column:
    """Risks (by name) as one number."""
    at = {name: i for i, (name, _, _) in RISKS.items()}
    return sum((F.when(c, 1 << at[name]).otherwise(0) for name, c in risks.items()), F.lit(0))


def risk_of_tls(version: Column, cipher: Column) -> Column:
    from tidelane.parsers.web import WEAK_CIPHERS

    return risk_bits(tls_obsolete_version=version < 0x0303, tls_weak_cipher=cipher.isin(*WEAK_CIPHERS))


def risk_of_certificate(certificate: Column, us: Column) -> Column:
    """Of a server's own certificate (parsers.certificates) at a time."""
    return risk_bits(tls_self_signed=F.coalesce(certificate["self_signed"], F.lit(False)), tls_expired_cert=F.coalesce(certificate["not_after_us"] < us, F.lit(False)))


def risk_of_name(name: Column, generated: Column) -> Column:
    """generated: whether the second-level label looks generated."""
    return risk_bits(punycode_idn=F.lower(name).rlike(r"(^|\.)xn--"), dga_domain=generated)


def risk_of_port(label: Column, detected: Column) -> Column:
    """A protocol on a port that has another name, or no name at all; labels may list several names between slashes."""
    known = detected.isNotNull() & (F.trim(detected) != "")
    fits = F.array_contains(F.split(F.lower(label), "/"), F.lower(detected))
    return risk_bits(port_proto_mismatch=known & label.isNotNull() & ~fits, known_proto_nonstd_port=known & label.isNull())


def risk_summary(bits: Column) -> Column:
    """struct<names, score, severity, count>: the score is the sum of weights, 255 at most."""
    weights = sum((F.when(bit(bits, 1 << i), w).otherwise(0) for i, (_, _, w) in RISKS.items()), F.lit(0))
    worst = F.coalesce(*[F.when(sum((bit(bits, 1 << i).cast("int") for i, (_, v, _) in RISKS.items() if v == s), F.lit(0)) > 0, s) for s in reversed(SEVERITIES)])
    return F.struct(words_of_flags(bits, {1 << i: n for i, (n, _, _) in RISKS.items()}).alias("names"), F.least(weights, F.lit(255)).alias("score"), worst.alias("severity"), F.bit_count(bits).alias("count"))


#: Bits of what a neighbour says that it is.
ROUTER, SWITCH, BRIDGE, ACCESS_POINT, PHONE, UPNP, STATION = 1, 2, 4, 8, 16, 32, 64


def role(capabilities: Column) -> Column:
    """router, switch, bridge, access_point, phone, iot, host or unknown: the first that fits, in this order."""
    order = {ROUTER: "router", SWITCH: "switch", BRIDGE: "bridge", ACCESS_POINT: "access_point", PHONE: "phone", UPNP: "iot", STATION: "host"}
    return F.coalesce(*[F.when(bit(capabilities, m), n) for m, n in order.items()], F.lit("unknown"))


def partial_asset(messages: DataFrame, mac: Column, **facts: Column) -> DataFrame:
    """us, seq, mac, ip, name, vendor, capabilities, source of messages about a device; what isn't given is null."""
    kinds = {"ip": "string", "name": "string", "vendor": "string", "capabilities": "int", "source": "string"}
    return messages.select("us", "seq", mac.alias("mac"), *[facts.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).filter(F.col("mac").isNotNull())


def merged_assets(facts: DataFrame, most_ips: int = 16, most_names: int = 8) -> DataFrame:
    """mac, first_us, last_us, vendor, capabilities, role, ips, names: partial assets of a device put together.

    The last known scalar holds, flags add up, and of addresses and names the newest stay, by their first sighting.
    """
    stamp = F.struct("us", "seq")
    each = facts.groupBy("mac").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("vendor", F.when(F.col("vendor").isNotNull(), stamp)).alias("vendor"), F.coalesce(F.bit_or("capabilities"), F.lit(0)).alias("capabilities"))
    for column, most in (("ip", most_ips), ("name", most_names)):
        first = facts.filter(F.col(column).isNotNull()).groupBy("mac", column).agg(F.min(stamp).alias("at"))
        newest = first.withColumn("__r", F.row_number().over(Window.partitionBy("mac").orderBy(F.desc("at"), column))).filter(F.col("__r") <= most)
        listed = newest.groupBy("mac").agg(F.array_sort(F.collect_list(F.struct("at", column))).alias("v")).select("mac", F.transform("v", lambda x: x[column]).alias(f"{column}s"))  # noqa: B023
        each = each.join(listed, "mac", "left")
    return each.withColumn("role", role(F.col("capabilities")))


def l7_summaries(facts: DataFrame, key: str, most: int = 16) -> DataFrame:
    """key, server_name, ja4, names: TLS values of the last hello; an HTTP host only where no server name is known; first names asked for.

    facts: us, seq, kind (tls, http or dns), server_name, ja4, name.
    """
    stamp = F.struct("us", "seq")
    last = lambda c, kind: F.max_by(c, F.when((F.col("kind") == kind) & F.col(c).isNotNull(), stamp))
    first_host = F.min_by("server_name", F.when((F.col("kind") == "http") & F.col("server_name").isNotNull(), stamp))
    each = facts.groupBy(key).agg(F.coalesce(last("server_name", "tls"), first_host).alias("server_name"), last("ja4", "tls").alias("ja4"))
    asked = facts.filter((F.col("kind") == "dns") & F.col("name").isNotNull()).groupBy(key, "name").agg(F.min(stamp).alias("at"))
    early = asked.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("at", "name"))).filter(F.col("__r") <= most)
    listed = early.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("v")).select(key, F.transform("v", lambda x: x["name"]).alias("names"))
    return each.join(listed, key, "left")


def feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """kind, value, reputation, source of a feed of lines `value[,reputation[,source]]`; comments and bad lines are left out.

    Domains and hashes are in lower case. A reputation that isn't a number makes a line bad.
    """
    return feed_lines(spark.read.text(path), kind)


def feed_lines(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    parts = F.split(F.trim(F.col(column)), ",", 3)
    told = lines.filter(~F.trim(F.col(column)).startswith("#") & (F.trim(F.col(column)) != ""))
    value, number = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    out = told.select(F.lit(kind).alias("kind"), (value if kind == "ip" else F.lower(value)).alias("value"), number.try_cast("int").alias("reputation"), F.trim(F.get(parts, F.lit(2))).alias("source"), number.alias("said"))
    right = {"ip": F.col("value").rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"), "hash": F.col("value").rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), "domain": F.col("value").rlike(r"^[^\s/]+\.[^\s/]+$")}
    return out.filter(right.get(kind, F.col("value") != "") & (F.col("said").isNull() | (F.col("said") == "") | F.col("reputation").isNotNull())).drop("said").dropDuplicates(["kind", "value"])


def equal_indicators(rows: DataFrame, indicators: DataFrame, **columns: str) -> DataFrame:
    """`rows` with indicator_kind and indicator of the first kind, in the order given (kind=column), that has the row's value.

    Joins by equality, one for each kind, in the same plan; lists of indicators may be of any size.
    """
    out = rows
    for kind, column in columns.items():
        own = indicators.filter(F.col("kind") == kind).select(F.col("value").alias(f"__{kind}")).distinct()
        value = F.col(column) if kind == "ip" else F.lower(F.col(column))
        out = out.join(own, value == F.col(f"__{kind}"), "left")
    hit = F.coalesce(*[F.when(F.col(f"__{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("value"))) for k in columns])
    return out.withColumn("__hit", hit).filter("__hit is not null").select(*rows.columns, F.col("__hit.kind").alias("indicator_kind"), F.col("__hit.value").alias("indicator"))


def explained_by_errors(flows: DataFrame, errors: DataFrame) -> DataFrame:
    """ICMP errors (us, inner: five-tuple) with the flow (key, start_us, end_us, flow_no) that they quote, live at that time.

    Both sides are joined by the canonical key; an error may come up to its flow's end.
    """
    on = (errors["key"] == flows["key"]) & (errors["us"] >= flows["start_us"]) & (errors["us"] <= flows["end_us"])
    return errors.join(flows, on).select(errors["seq"], errors["us"], flows["key"], flows["flow_no"])
