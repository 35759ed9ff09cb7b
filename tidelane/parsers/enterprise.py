"""Directory, file, mail and management protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelane.functions import wire
from tidelane.functions.wire import at_path, ber_number, bit, cut, first_at, found, ipv4, named, records, rest, text, uint, value_of


def utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


#: SMB2 commands, interfaces reached over named pipes, shares for administrators.
SMB_COMMANDS = dict(enumerate("negotiate session_setup logoff tree_connect tree_disconnect create close flush read write lock ioctl cancel echo query_directory change_notify query_info set_info oplock_break".split()))
DIALECTS = {0x0202: "2.0.2", 0x0210: "2.1", 0x0300: "3.0", 0x0302: "3.0.2", 0x0311: "3.1.1", 0x02FF: "2.?"}
INTERFACES = {"367abb81-9844-35f1-ad32-98f038001003": "svcctl", "12345778-1234-abcd-ef00-0123456789ac": "samr", "12345778-1234-abcd-ef00-0123456789ab": "lsarpc", "4b324fc8-1670-01d3-1278-5a47bf6ee188": "srvsvc", "86d35949-83c9-4044-b424-db363231fd0c": "atsvc", "e3514235-4b06-11d1-ab04-00c04fc2dcd2": "drsuapi"}


def uuid(data: Column, at) -> Column:
    """Text form of a UUID whose first three parts are little-endian."""
    digits = F.lower(F.hex(cut(data, at, 16)))
    byte = lambda i: F.substring(digits, 2 * i + 1, 2)
    part = lambda order: F.concat(*[byte(i) for i in order])
    return F.concat_ws("-", part((3, 2, 1, 0)), part((5, 4)), part((7, 6)), part((8, 9)), part(range(10, 16)))


def interface_name(uuid_text: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in INTERFACES.items() for x in p]), F.lower(uuid_text))


def smb(payload: Column) -> Column:
    """struct<command, is_response, status, message_id, session_id, dialect, tree, admin_share, pipe, user, domain, interface>.

    payload: one message behind its four bytes of length. user and domain come from NTLM, interface from a binding to a
    named pipe. Null without the SMB2 mark.
    """
    base = 4
    command = uint(payload, base + 12, 2, little=True)
    response = bit(uint(payload, base + 16, 4, little=True), 1)
    body = base + 64
    u16 = lambda at: uint(payload, at, 2, little=True)
    path = F.when((command == 3) & ~response, utf16(cut(payload, base + u16(body + 4), u16(body + 6))))
    name = F.when((command == 5) & ~response, utf16(cut(payload, base + u16(body + 44), u16(body + 46))))
    mark = F.call_function("locate", F.lit("4E544C4D5353500003000000"), F.hex(payload))
    ntlm = F.when((command == 1) & ~response & (mark > 0), ((mark - 1) / 2).cast("int"))
    field = lambda at: utf16(cut(payload, ntlm + uint(payload, ntlm + at + 4, 4, little=True), uint(payload, ntlm + at, 2, little=True)))
    bind = F.call_function("locate", F.lit("05000B"), F.hex(payload))
    bind_at = F.when((command.isin(9, 11)) & ~response & (bind % 2 == 1), ((bind - 1) / 2).cast("int"))
    share = F.upper(F.substring_index(path, "\\", -1))
    return F.when(
        (uint(payload, base, 4) == 0xFE534D42) & (F.length(payload) >= body),
        F.struct(
            named(command, SMB_COMMANDS).alias("command"),
            response.alias("is_response"),
            F.when(response, uint(payload, base + 8, 4, little=True)).alias("status"),
            uint(payload, base + 24, 4, little=True).alias("message_id"),
            uint(payload, base + 40, 4, little=True).alias("session_id"),
            F.when((command == 0) & response, named(u16(body + 4), DIALECTS)).alias("dialect"),
            path.alias("tree"),
            F.coalesce(share.rlike(r"^(ADMIN|[A-Z])\$$"), F.lit(False)).alias("admin_share"),
            F.coalesce((share == "IPC$") | name.isin("svcctl", "samr", "lsarpc", "srvsvc", "atsvc", "winreg"), F.lit(False)).alias("pipe"),
            name.alias("file"),
            field(36).alias("user"),
            field(28).alias("domain"),
            F.when(bind_at.isNotNull(), interface_name(uuid(payload, bind_at + 32))).alias("interface"),
        ),
    )


#: LDAP operations and result codes.
LDAP_OPERATIONS = {0x60: "bind_request", 0x61: "bind_response", 0x42: "unbind", 0x63: "search_request", 0x64: "search_entry", 0x65: "search_done", 0x66: "modify", 0x67: "modify_response", 0x68: "add", 0x69: "add_response", 0x4A: "delete", 0x6B: "delete_response", 0x77: "extended", 0x78: "extended_response"}
SCOPES = {0: "base", 1: "one", 2: "subtree"}


def ldap(tree: Column) -> Column:
    """struct<message_id, operation, version, name, simple_bind, base, scope, attributes, spn_query, result, success> of a message's elements.

    tree: a column made by `ber_tree`.
    """
    tag = F.conv(F.split_part(F.get(F.filter(F.transform(tree, lambda e: e["path"]), lambda p: p.rlike("^30/(4[2-9a]|6|7)")), F.lit(0)), F.lit("/"), F.lit(2)), 16, 10).cast("int")
    result = ber_number(first_at(tree, *[f"30/{t}/0a" for t in ("61", "65", "67", "69", "6b", "78")]))
    search = tag == 0x63
    inside = F.exists(tree, lambda e: e["path"].startswith("30/63/") & F.lower(text(e["value"])).contains("serviceprincipalname"))
    return F.when(
        tag.isNotNull(),
        F.struct(
            ber_number(first_at(tree, "30/02")).alias("message_id"),
            named(tag, LDAP_OPERATIONS).alias("operation"),
            ber_number(first_at(tree, "30/60/02")).alias("version"),
            text(first_at(tree, "30/60/04")).alias("name"),
            F.when(tag == 0x60, first_at(tree, "30/60/80").isNotNull()).alias("simple_bind"),
            text(first_at(tree, "30/63/04")).alias("base"),
            F.when(search, named(ber_number(first_at(tree, "30/63/0a")), SCOPES)).alias("scope"),
            F.when(search, F.transform(at_path(tree, "30/63/30/04"), text)).alias("attributes"),
            F.coalesce(search & inside, F.lit(False)).alias("spn_query"),
            result.alias("result"),
            (result == 0).alias("success"),
        ),
    )


#: Kerberos messages, encryption types, and errors of wrong passwords.
KERBEROS_KINDS = {0x6A: "as_req", 0x6B: "as_rep", 0x6C: "tgs_req", 0x6D: "tgs_rep", 0x7E: "error"}
AES, RC4, DES = (17, 18), (23, 24), (1, 2, 3)
GUESSING = (18, 24)


def kerberos(tree: Column) -> Column:
    """struct<kind, realm, client, service, etypes, preauth, weak, kerberoast, error, guessing> of a message's elements.

    tree: a column made by `ber_tree`. kerberoast: a ticket for a service is asked for with RC4 or DES first. guessing:
    an error of a wrong password.
    """
    kind = F.conv(F.get(F.transform(tree, lambda e: e["path"]), F.lit(0)), 16, 10).cast("int")
    ask, answer, error = ("6a/30", "6c/30"), ("6b/30", "6d/30"), "7e/30"
    name = lambda paths: F.nullif(F.array_join(F.transform(at_path(tree, *[f"{p}/30/a1/30/1b" for p in paths]), text), "/"), F.lit(""))
    of = lambda asked, failed, replied: [*(f"{p}/a4/30/{asked}" for p in ask), f"{error}/{failed}", *(f"{p}/{replied}" for p in answer)]
    etypes = F.transform(at_path(tree, *[f"{p}/a4/30/a8/30/02" for p in ask]), ber_number)
    service = name(of("a3", "aa", "-"))
    code = ber_number(first_at(tree, f"{error}/a6/02"))
    first = F.get(etypes, F.lit(0))
    return F.when(
        kind.isin(*KERBEROS_KINDS),
        F.struct(
            named(kind, KERBEROS_KINDS).alias("kind"),
            text(first_at(tree, *[f"{p}/1b" for p in of("a2", "a9", "a3")])).alias("realm"),
            name(of("a1", "a8", "a4")).alias("client"),
            service.alias("service"),
            etypes.alias("etypes"),
            F.transform(at_path(tree, *[f"{p}/a3/30/30/a1/02" for p in ask]), ber_number).alias("preauth"),
            F.exists(etypes, lambda e: e.isin(*RC4, *DES)).alias("weak"),
            F.coalesce((kind == 0x6C) & first.isin(*RC4, *DES) & ~service.startswith("krbtgt"), F.lit(False)).alias("kerberoast"),
            code.alias("error"),
            F.coalesce(code.isin(*GUESSING), F.lit(False)).alias("guessing"),
        ),
    )


def kerberos_stream(stream: Column) -> Column:
    """array<binary>: the messages of a Kerberos stream over TCP, each behind its length of four bytes."""
    return F.transform(records(stream, 0, F.length(stream), 4, lambda at: uint(stream, at, 4), kind=lambda at: F.lit(0)), lambda r: cut(stream, r["at"], r["size"]))


RADIUS_CODES = {1: "access_request", 2: "access_accept", 3: "access_reject", 4: "accounting_request", 5: "accounting_response", 11: "access_challenge"}


def radius(payload: Column) -> Column:
    """struct<code, identifier, user, calling, called, nas_ip, framed_ip, has_password>."""
    end = F.least(uint(payload, 2, 2), F.length(payload))
    pairs = records(payload, 20, end, 2, lambda at: uint(payload, at + 1, 1) - 2)

    def message(p: Column) -> Column:
        said = lambda kind: text(value_of(payload, p, kind))
        address = lambda kind: wire.let(value_of(payload, p, kind), lambda v: F.when(v.isNotNull(), ipv4(v, 0)))
        return F.struct(named(uint(payload, 0, 1), RADIUS_CODES).alias("code"), uint(payload, 1, 1).alias("identifier"), said(1).alias("user"), said(31).alias("calling"), said(30).alias("called"), address(4).alias("nas_ip"), address(8).alias("framed_ip"), found(p, 2).isNotNull().alias("has_password"))

    return F.when((F.length(payload) >= 20) & (uint(payload, 2, 2) >= 20), wire.let(pairs, message))


SNMP_PDUS = {0xA0: "get", 0xA1: "get_next", 0xA2: "response", 0xA3: "set", 0xA4: "trap_v1", 0xA5: "get_bulk", 0xA6: "inform", 0xA7: "trap_v2"}


def oid(data: Column) -> Column:
    """Dotted text of an object identifier."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("arcs"))

    def step(s: Column, i: Column) -> Column:
        byte = uint(data, i, 1)
        n = s["n"] * 128 + byte.bitwiseAND(F.lit(0x7F))
        return F.when(byte >= 128, F.struct(n.alias("n"), s["arcs"].alias("arcs"))).otherwise(F.struct(F.lit(0).cast("bigint").alias("n"), F.concat(s["arcs"], F.array(n)).alias("arcs")))

    arcs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(2)) - 1), state, step, lambda s: s["arcs"])
    first = uint(data, 0, 1)
    return F.array_join(F.concat(F.array(F.floor(first / 40), first % 40), arcs), ".")


def snmp(tree: Column) -> Column:
    """struct<version, community, pdu, request_id, oids> of versions 1 and 2c, out of a message's elements by `ber_tree`."""
    pdu = F.conv(F.split_part(F.get(F.filter(F.transform(tree, lambda e: e["path"]), lambda p: p.startswith("30/a")), F.lit(0)), F.lit("/"), F.lit(2)), 16, 10).cast("int")
    kinds = [f"30/{t:02x}" for t in SNMP_PDUS]
    return F.when(
        pdu.isNotNull(),
        F.struct(
            named(ber_number(first_at(tree, "30/02")), {0: "v1", 1: "v2c"}).alias("version"),
            text(first_at(tree, "30/04")).alias("community"),
            named(pdu, SNMP_PDUS).alias("pdu"),
            ber_number(first_at(tree, *[f"{k}/02" for k in kinds])).alias("request_id"),
            F.transform(at_path(tree, *[f"{k}/30/30/06" for k in kinds]), oid).alias("oids"),
        ),
    )


RDP_PROTOCOLS = {1: "ssl", 2: "hybrid", 4: "rdstls", 8: "hybrid_ex"}


def rdp(payload: Column) -> Column:
    """struct<kind, cookie, protocols, failure> of a connection request or its answer behind a TPKT header."""
    kind = uint(payload, 5, 1)
    cookie = F.nullif(F.regexp_extract(text(rest(payload, 11)), r"^Cookie: mstshash=([^\r\n]*)", 1), F.lit(""))
    size = F.length(payload)
    tail = size - 8
    negotiation = F.when(size >= 19, uint(payload, tail, 1))
    flags = uint(payload, tail + 4, 4, little=True)
    return F.when(
        (uint(payload, 0, 1) == 3) & kind.isin(0xE0, 0xD0),
        F.struct(
            F.when(kind == 0xE0, "request").when(negotiation == 3, "failure").otherwise("confirm").alias("kind"),
            cookie.alias("cookie"),
            F.when(negotiation.isin(1, 2), wire.words_of_flags(flags, RDP_PROTOCOLS)).alias("protocols"),
            F.when(negotiation == 3, flags).alias("failure"),
        ),
    )


FTP_TRANSFERS = ("RETR", "STOR", "STOU", "APPE", "LIST", "NLST")


def ftp(stream: Column, client: bool) -> Column:
    """array<struct<kind, verb, argument, code>> of one side's lines: commands of a client, replies and banner of a server.

    kind: command, credentials, tls_upgrade, transfer; or banner (the first line if its code is 220), reply.
    """
    if client:
        verb = lambda x: F.upper(F.substring_index(x, " ", 1))
        kind = lambda v: F.when(v.isin("USER", "PASS"), "credentials").when(v == "AUTH", "tls_upgrade").when(v.isin(*FTP_TRANSFERS), "transfer").otherwise("command")
        return F.transform(wire.lines(stream), lambda x: F.struct(kind(verb(x)).alias("kind"), verb(x).alias("verb"), F.when(x.contains(" "), F.substring(x, F.length(verb(x)) + 2, F.length(x))).alias("argument"), F.lit(None).cast("int").alias("code")))
    final = F.filter(wire.lines(stream), lambda x: x.rlike(r"^\d{3}( |$)"))
    return F.transform(final, lambda x, i: F.struct(F.when((i == 0) & x.startswith("220"), "banner").otherwise("reply").alias("kind"), F.lit(None).cast("string").alias("verb"), F.substring(x, 5, F.length(x)).alias("argument"), F.substring(x, 1, 3).cast("int").alias("code")))


def reply_class(code: Column) -> Column:
    """preliminary, completion, intermediate, transient or permanent, by a reply's first digit."""
    return named(F.floor(code / 100), {1: "preliminary", 2: "completion", 3: "intermediate", 4: "transient", 5: "permanent"})


def smtp(stream: Column) -> Column:
    """array<struct<kind, verb, argument>> of a client's lines, with the lines of a mail's text left out.

    kind: helo, mail_from, rcpt_to, credentials (decoded), tls_upgrade, data_begin, data_end or command.
    """
    state = F.struct(F.lit(False).alias("in_data"), F.array().cast("array<struct<kind:string,verb:string,argument:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        upper = F.upper(x)
        verb = F.when(upper.startswith("MAIL FROM:"), "MAIL FROM").when(upper.startswith("RCPT TO:"), "RCPT TO").otherwise(F.substring_index(upper, " ", 1))
        after = F.trim(F.substring(x, F.length(verb) + 2, F.length(x)))
        address = F.regexp_extract(x, "<([^>]*)>", 1)
        secret = F.replace(F.decode(F.try_to_binary(F.regexp_extract(x, r"(?i)^AUTH PLAIN (\S+)", 1), F.lit("base64")), "UTF-8"), F.lit("\0"), F.lit(" "))
        kind = F.when(s["in_data"], "data_end").when(verb.isin("HELO", "EHLO"), "helo").when(verb == "MAIL FROM", "mail_from").when(verb == "RCPT TO", "rcpt_to").when(upper.startswith("AUTH "), "credentials").when(verb == "STARTTLS", "tls_upgrade").when(verb == "DATA", "data_begin").otherwise("command")
        argument = F.when(kind.isin("mail_from", "rcpt_to"), address).when(upper.startswith("AUTH PLAIN "), F.trim(secret)).when(after != "", after)
        one = F.struct(kind.alias("kind"), F.when(~s["in_data"], verb).alias("verb"), F.when(~s["in_data"], argument).alias("argument"))
        more = F.struct((kind == "data_begin").alias("in_data"), F.concat(s["found"], F.array(one)).alias("found"))
        return F.when(s["in_data"] & (x != "."), s).otherwise(more)

    return F.aggregate(wire.lines(stream), state, step, lambda s: s["found"])
