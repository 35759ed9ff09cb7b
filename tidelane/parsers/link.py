"""Messages of the link and network layers and of small services with fixed layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.wire import bit, bits, cut, found, ipv4, ipv6, mac, named, records, rest, text, uint, value_of

#: Names of ICMP and ICMPv6 types, and of the codes of "destination unreachable".
ICMP_KINDS = {0: "echo_reply", 3: "dest_unreachable", 4: "source_quench", 5: "redirect", 8: "echo_request", 11: "time_exceeded", 12: "parameter_problem", 13: "timestamp", 14: "timestamp_reply"}
ICMP6_KINDS = {1: "dest_unreachable", 2: "packet_too_big", 3: "time_exceeded", 4: "parameter_problem", 128: "echo_request", 129: "echo_reply", 133: "router_solicitation", 134: "router_advertisement", 135: "neighbor_solicitation", 136: "neighbor_advertisement", 137: "redirect"}
UNREACHABLE = {0: "network", 1: "host", 2: "protocol", 3: "port", 4: "fragmentation_needed", 9: "network_prohibited", 10: "host_prohibited", 13: "admin_prohibited"}
UNREACHABLE6 = {0: "no_route", 1: "admin_prohibited", 3: "address", 4: "port"}
DHCP_KINDS = {1: "discover", 2: "offer", 3: "request", 4: "decline", 5: "ack", 6: "nak", 7: "release", 8: "inform"}
DHCP_MAGIC = 0x63825363
NTP_EPOCH = 2_208_988_800


def arp_flags(arp: Column) -> Column:
    """struct<gratuitous, spoof> of the arp column of `decode`: an announcement of one's own address, and one sent as a reply."""
    own = arp["sender_ip"] == arp["target_ip"]
    return F.struct(own.alias("gratuitous"), (own & (arp["oper"] == 2)).alias("spoof"))


def icmp(message: Column, v6: bool = False) -> Column:
    """struct<kind, code, is_error, unreachable, mtu, inner>: inner is the five-tuple of a packet quoted by an error."""
    kind, code = uint(message, 0, 1), uint(message, 1, 1)
    errors = (1, 2, 3, 4) if v6 else (3, 4, 5, 11, 12)
    is_error = kind.isin(*errors)
    at = 8 + (F.lit(40) if v6 else bits(uint(message, 8, 1), 0, 4) * 4)
    proto = uint(message, 14, 1) if v6 else uint(message, 17, 1)
    address = ipv6 if v6 else ipv4
    src, dst = (address(message, 16), address(message, 32)) if v6 else (address(message, 20), address(message, 24))
    inner = F.struct(F.when(proto == 6, "tcp").when(proto == 17, "udp").otherwise("other").alias("proto"), src.alias("src_ip"), uint(message, at, 2).cast("int").alias("src_port"), dst.alias("dst_ip"), uint(message, at + 2, 2).cast("int").alias("dst_port"))
    too_big = (kind == 2) if v6 else ((kind == 3) & (code == 4))
    mtu = F.when(too_big, uint(message, 4, 4) if v6 else uint(message, 6, 2))
    return F.struct(
        named(kind, ICMP6_KINDS if v6 else ICMP_KINDS).alias("kind"),
        code.cast("int").alias("code"),
        is_error.alias("is_error"),
        F.when(kind == (1 if v6 else 3), named(code, UNREACHABLE6 if v6 else UNREACHABLE)).alias("unreachable"),
        mtu.alias("mtu"),
        F.when(is_error & (F.length(message) >= at + 4), inner).alias("inner"),
    )


def ndp(message: Column) -> Column:
    """struct<kind, target, lladdr, router, solicited, override, spoof> of a neighbor message; null for other ICMPv6.

    spoof: an advertisement that nobody asked for and that overrides what is known.
    """
    kind = uint(message, 0, 1)
    flags = uint(message, 4, 1)
    options = records(message, 24, F.length(message), 2, lambda at: uint(message, at + 1, 1) * 8 - 2)
    lladdr = F.when(kind == 135, value_of(message, options, 1)).otherwise(value_of(message, options, 2))
    advert = kind == 136
    return F.when(
        kind.isin(135, 136) & (F.length(message) >= 24),
        F.struct(
            named(kind, ICMP6_KINDS).alias("kind"),
            ipv6(message, 8).alias("target"),
            F.when(lladdr.isNotNull(), mac(lladdr, 0)).alias("lladdr"),
            (advert & bit(flags, 0x80)).alias("router"),
            (advert & bit(flags, 0x40)).alias("solicited"),
            (advert & bit(flags, 0x20)).alias("override"),
            (advert & ~bit(flags, 0x40) & bit(flags, 0x20)).alias("spoof"),
        ),
    )


def dhcp(payload: Column) -> Column:
    """struct of a DHCP message; null without its magic number. fingerprint: requested parameters, a bar, the vendor class."""
    options = records(payload, 240, F.length(payload), 2, lambda at: F.when(uint(payload, at, 1) != 255, uint(payload, at + 1, 1)))

    def message(o: Column) -> Column:
        value = lambda kind: value_of(payload, o, kind)
        asked = F.array_join(F.transform(wire.let(found(o, 55), lambda r: wire.numbers(payload, r["at"], F.coalesce(r["size"], F.lit(0)), 1)), lambda x: x.cast("string")), ",")
        vendor = text(value(60))
        return F.struct(
            F.when(uint(payload, 0, 1) == 1, "request").otherwise("reply").alias("op"),
            named(uint(value(53), 0, 1), DHCP_KINDS).alias("kind"),
            uint(payload, 4, 4).alias("xid"),
            mac(payload, 28).alias("mac"),
            ipv4(payload, 12).alias("client_ip"),
            ipv4(payload, 16).alias("your_ip"),
            text(value(12)).alias("host_name"),
            ipv4(value(50), 0).alias("requested_ip"),
            uint(value(51), 0, 4).alias("lease_s"),
            ipv4(value(54), 0).alias("server"),
            vendor.alias("vendor_class"),
            F.concat(asked, F.lit("|"), F.coalesce(vendor, F.lit(""))).alias("fingerprint"),
        )

    return F.when(uint(payload, 236, 4) == DHCP_MAGIC, wire.let(options, message))


def lldp(payload: Column) -> Column:
    """struct<chassis_id, port_id, ttl, system_name, system_description, capabilities, management, shutdown> of an LLDP unit."""
    units = records(payload, 0, F.length(payload), 2, lambda at: F.when(uint(payload, at, 2) != 0, bits(uint(payload, at, 2), 0, 9)), kind=lambda at: bits(uint(payload, at, 2), 9, 7))

    def message(u: Column) -> Column:
        value = lambda kind: value_of(payload, u, kind)
        name = lambda v: F.when(uint(v, 0, 1).isin(4, 3), F.when(F.length(v) == 7, mac(v, 1)).otherwise(text(rest(v, 1)))).otherwise(text(rest(v, 1)))
        address = value(8)
        return F.struct(
            name(value(1)).alias("chassis_id"),
            name(value(2)).alias("port_id"),
            uint(value(3), 0, 2).alias("ttl"),
            text(value(5)).alias("system_name"),
            text(value(6)).alias("system_description"),
            uint(value(7), 2, 2).alias("capabilities"),
            F.when(uint(address, 1, 1) == 1, ipv4(address, 2)).alias("management"),
            (uint(value(3), 0, 2) == 0).alias("shutdown"),
        )

    return wire.let(units, message)


def cdp(payload: Column) -> Column:
    """struct<version, ttl, device_id, address, port_id, capabilities, software, platform, native_vlan, full_duplex, vtp>."""
    units = records(payload, 4, F.length(payload), 4, lambda at: uint(payload, at + 2, 2) - 4, kind=lambda at: uint(payload, at, 2))

    def message(u: Column) -> Column:
        value = lambda kind: value_of(payload, u, kind)
        address = value(2)
        return F.struct(
            uint(payload, 0, 1).cast("int").alias("version"),
            uint(payload, 1, 1).cast("int").alias("ttl"),
            text(value(1)).alias("device_id"),
            F.when(uint(address, 6, 1) == 0xCC, ipv4(address, 9)).alias("address"),
            text(value(3)).alias("port_id"),
            uint(value(4), 0, 4).alias("capabilities"),
            text(value(5)).alias("software"),
            text(value(6)).alias("platform"),
            uint(value(10), 0, 2).alias("native_vlan"),
            (uint(value(11), 0, 1) == 1).alias("full_duplex"),
            text(value(9)).alias("vtp"),
        )

    return wire.let(units, message)


def ntp_seconds(data: Column, at: int) -> Column:
    """Seconds since 1970 of an NTP timestamp; null for zero."""
    whole = uint(data, at, 4)
    return F.when(whole > 0, whole - NTP_EPOCH + uint(data, at + 4, 4) / float(1 << 32))


def ntp(payload: Column) -> Column:
    """struct of an NTP packet. amplification: a monitoring request of mode 7, whose answer is far larger."""
    first = uint(payload, 0, 1)
    stratum, reference = uint(payload, 1, 1), cut(payload, 12, 4)
    mode = bits(first, 0, 3)
    times = [ntp_seconds(payload, at).alias(name) for name, at in (("reference_s", 16), ("origin_s", 24), ("receive_s", 32), ("transmit_s", 40))]
    return F.when(
        F.length(payload) >= 8,
        F.struct(
            bits(first, 6, 2).alias("leap"),
            bits(first, 3, 3).alias("version"),
            mode.alias("mode"),
            stratum.alias("stratum"),
            F.when(stratum <= 1, F.rtrim(F.translate(text(reference), "\0", " "))).otherwise(ipv4(payload, 12)).alias("reference_id"),
            *times,
            ((mode == 7) & (uint(payload, 3, 1) == 42)).alias("amplification"),
        ),
    )


def tftp(payload: Column) -> Column:
    """struct<opcode, file, mode, block, error, config>; config: a device fetches its configuration."""
    opcode = uint(payload, 0, 2)
    parts = F.split(text(rest(payload, 2)), "\0")
    file = F.when(opcode.isin(1, 2), F.get(parts, F.lit(0)))
    return F.struct(
        named(opcode, {1: "read", 2: "write", 3: "data", 4: "ack", 5: "error", 6: "option_ack"}).alias("opcode"),
        file.alias("file"),
        F.when(opcode.isin(1, 2), F.lower(F.get(parts, F.lit(1)))).alias("mode"),
        F.when(opcode.isin(3, 4), uint(payload, 2, 2)).alias("block"),
        F.when(opcode == 5, F.get(F.split(text(rest(payload, 4)), "\0"), F.lit(0))).alias("error"),
        F.coalesce((opcode == 1) & F.lower(file).rlike(r"(confg|\.cfg|\.conf|startup-config|running-config)"), F.lit(False)).alias("config"),
    )


def stun(payload: Column) -> Column:
    """struct<class, method, transaction_id, mapped, username, software>; null without the magic cookie."""
    kind = uint(payload, 0, 2)
    attributes = records(payload, 20, F.length(payload), 4, lambda at: F.ceil(uint(payload, at + 2, 2) / 4) * 4, kind=lambda at: uint(payload, at, 2))

    def message(a: Column) -> Column:
        plain, hidden = value_of(payload, a, 1), value_of(payload, a, 0x20)
        port = F.coalesce(uint(hidden, 2, 2).bitwiseXOR(F.lit(0x2112)), uint(plain, 2, 2))
        masked = F.concat_ws(".", *[uint(hidden, 4 + i, 1).bitwiseXOR(F.lit(m)).cast("string") for i, m in enumerate((0x21, 0x12, 0xA4, 0x42))])
        said = lambda kind: wire.let(found(a, kind), lambda r: F.when(r.isNotNull(), text(cut(payload, r["at"], uint(payload, r["at"] - 2, 2)))))
        return F.struct(
            named(bits(kind, 4, 1) + 2 * bits(kind, 8, 1), {0: "request", 1: "indication", 2: "success", 3: "error"}).alias("class"),
            (bits(kind, 0, 4) + bits(kind, 5, 3) * 16 + bits(kind, 9, 5) * 128).alias("method"),
            F.lower(F.hex(cut(payload, 8, 12))).alias("transaction_id"),
            F.when(port.isNotNull(), F.concat_ws(":", F.when(hidden.isNotNull(), masked).otherwise(ipv4(plain, 4)), port.cast("string"))).alias("mapped"),
            said(6).alias("username"),
            said(0x8022).alias("software"),
        )

    return F.when((uint(payload, 4, 4) == 0x2112A442) & (kind < 0x4000), wire.let(attributes, message))


def wireguard(payload: Column) -> Column:
    """struct<kind, sender, receiver, size, handshake>; null for other first bytes."""
    kind = uint(payload, 0, 4, little=True)
    first, second = uint(payload, 4, 4, little=True), uint(payload, 8, 4, little=True)
    names = {1: "initiation", 2: "response", 3: "cookie", 4: "data"}
    return F.when(
        kind.isin(*names),
        F.struct(
            named(kind, names).alias("kind"),
            F.when(kind.isin(1, 2), first).alias("sender"),
            F.when(kind == 2, second).when(kind.isin(3, 4), first).alias("receiver"),
            F.when(kind == 4, F.length(payload) - 16).alias("size"),
            kind.isin(1, 2).alias("handshake"),
        ),
    )


#: Modbus functions that read and that write.
MODBUS_READ, MODBUS_WRITE = (1, 2, 3, 4), (5, 6, 15, 16, 22, 23)


def modbus(payload: Column) -> Column:
    """struct<transaction, unit, function, is_exception, exception, address, quantity, access>; null for another protocol number."""
    raw = uint(payload, 7, 1)
    function = raw.bitwiseAND(F.lit(0x7F))
    failed = raw >= 0x80
    plain = ~failed & function.isin(*MODBUS_READ, *MODBUS_WRITE)
    return F.when(
        (uint(payload, 2, 2) == 0) & (F.length(payload) >= 8),
        F.struct(
            uint(payload, 0, 2).alias("transaction"),
            uint(payload, 6, 1).alias("unit"),
            function.alias("function"),
            failed.alias("is_exception"),
            F.when(failed, uint(payload, 8, 1)).alias("exception"),
            F.when(plain, uint(payload, 8, 2)).alias("address"),
            F.when(plain & ~function.isin(5, 6), uint(payload, 10, 2)).alias("quantity"),
            F.when(function.isin(*MODBUS_READ), "read").when(function.isin(*MODBUS_WRITE), "write").otherwise("other").alias("access"),
        ),
    )


def dnp3_crc(data: Column, at: int, size: int) -> Column:
    """CRC-16 of DNP3 (reflected polynomial 0xA6BC, all bits inverted at the end) of `size` bytes."""

    def bit_step(c: Column, _: Column) -> Column:
        half = F.shiftright(c, 1)
        return F.when(bit(c, 1), half.bitwiseXOR(F.lit(0xA6BC).cast("bigint"))).otherwise(half)

    def step(c: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(uint(data, at + i, 1)), bit_step)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("bigint"), step, lambda c: c.bitwiseXOR(F.lit(0xFFFF).cast("bigint")))


def dnp3(payload: Column) -> Column:
    """struct<source, destination, link_function, from_master, primary, crc_ok, function, sequence, iin, is_response>."""
    control = uint(payload, 3, 1)
    has_app = uint(payload, 2, 1) > 5
    function = F.when(has_app, uint(payload, 12, 1))
    answer = function.isin(129, 130)
    return F.when(
        (uint(payload, 0, 2) == 0x0564) & (F.length(payload) >= 10),
        F.struct(
            uint(payload, 6, 2, little=True).alias("source"),
            uint(payload, 4, 2, little=True).alias("destination"),
            bits(control, 0, 4).alias("link_function"),
            bit(control, 0x80).alias("from_master"),
            bit(control, 0x40).alias("primary"),
            (dnp3_crc(payload, 0, 8) == uint(payload, 8, 2, little=True)).alias("crc_ok"),
            function.alias("function"),
            F.when(has_app, bits(uint(payload, 11, 1), 0, 4)).alias("sequence"),
            F.when(answer, uint(payload, 13, 2)).alias("iin"),
            F.coalesce(answer, F.lit(False)).alias("is_response"),
        ),
    )
