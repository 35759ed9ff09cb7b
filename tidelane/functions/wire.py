"""Bytes of binary columns: unsigned numbers, addresses, and walks over records that carry their own length.

Everything here is a column expression, so decoders stay inside of Spark's own execution and prune unused fields.
Places count from 0 and may be columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelane.functions.scalars import let

At = Column | int


def place(at: At) -> Column:
    return F.lit(at) if isinstance(at, int) else at


def cut(data: Column, at: At, size: At) -> Column:
    """`size` bytes from `at`, fewer at the end of the data."""
    return data.substr((place(at) + 1).cast("int"), place(size).cast("int"))


def rest(data: Column, at: At) -> Column:
    return data.substr((place(at) + 1).cast("int"), F.length(data))


def uint(data: Column, at: At, size: int, little: bool = False) -> Column:
    """Unsigned number of `size` bytes (7 at most); null where the data are too short."""
    part = cut(data, at, size)
    digits = F.hex(F.reverse(part) if little and size == 1 else part)
    if little and size > 1:
        digits = F.concat(*[F.substring(digits, 2 * size - 2 * i - 1, 2) for i in range(size)])
    return F.when(F.length(data) >= place(at) + size, F.conv(digits, 16, 10).cast("long"))


def bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def text(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def ipv4(data: Column, at: At) -> Column:
    return F.concat_ws(".", *[uint(data, place(at) + i, 1).cast("string") for i in range(4)])


def mac(data: Column, at: At) -> Column:
    return F.regexp_replace(F.lower(F.hex(cut(data, at, 6))), "(..)(?=.)", "$1:")


def ipv6(data: Column, at: At) -> Column:
    """RFC 5952 form: groups without leading zeros, the first longest run of two or more zero groups as "::"; mapped IPv4 dotted."""
    groups = F.array(*[F.lower(F.hex(uint(data, place(at) + 2 * i, 2))) for i in range(8)])
    whole = F.array_join(groups, ":")
    out = whole
    for n in range(2, 9):  # longer runs are tried later and so win
        runs = "(^|:)0" + ":0" * (n - 1) + "(:|$)"
        out = F.when(whole.rlike(runs), F.regexp_replace(F.regexp_replace(whole, f"^(.*?){runs}", "$1::"), ":{3,}", "::")).otherwise(out)
    mapped = F.hex(cut(data, at, 12)) == "0" * 20 + "FFFF"
    return F.when(mapped, F.concat(F.lit("::ffff:"), ipv4(data, place(at) + 12))).otherwise(out)


def records(data: Column, start: At, end: At, head: int, size, most: int | None = None, kind=None) -> Column:
    """array<struct<kind, at, size>> of records that follow each other from `start` to `end`.

    head: bytes before a record's content; size(at): bytes of the content; kind(at): its type (the first byte if None).
    A record that doesn't end by `end` ends the walk, as do `most` records; without it, there are as many steps as heads fit in.
    """
    kind = kind or (lambda at: uint(data, at, 1))
    none = F.array().cast("array<struct<kind:bigint,at:int,size:int>>")
    state = F.struct(place(start).cast("int").alias("at"), none.alias("found"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        n = size(at).cast("int")
        ok = (at >= 0) & (at + head <= place(end)) & (n >= 0) & (at + head + n <= place(end))
        one = F.struct(kind(at).cast("bigint").alias("kind"), (at + head).cast("int").alias("at"), n.alias("size"))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct((at + head + n).cast("int").alias("at"), F.concat(s["found"], F.array(one)).alias("found"))).otherwise(F.struct(F.lit(-1).alias("at"), s["found"].alias("found")))

    room = F.lit(most) if most else F.coalesce(F.greatest(F.floor((place(end) - place(start)) / head), F.lit(1)), F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), room), state, step, lambda s: s["found"])


def found(walk: Column, kind: int) -> Column:
    """The first record of a kind; null without one."""
    return F.get(F.filter(walk, lambda r: r["kind"] == kind), F.lit(0))


def content(data: Column, record: Column) -> Column:
    return let(record, lambda r: F.when(r.isNotNull(), cut(data, r["at"], r["size"])))


def value_of(data: Column, walk: Column, kind: int) -> Column:
    """Content of the first record of a kind."""
    return let(found(walk, kind), lambda r: content(data, r))


def numbers(data: Column, start: At, count: At, size: int = 2) -> Column:
    """array<bigint> of `count` unsigned numbers of `size` bytes."""
    n = place(count).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: uint(data, place(start) + i * size, size))).otherwise(F.array().cast("array<bigint>"))


def frame_of(*parts: Column | str) -> Column:
    """Binary column out of hexadecimal texts."""
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def hexed(value: Column, size: int) -> Column:
    """A number as `size` bytes in hexadecimal."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def text_hex(value: Column | str) -> Column:
    return F.hex((F.lit(value) if isinstance(value, str) else value).cast("binary"))


#: Rows of a batch that are Python objects at a time.
AT_ONCE = 500


def by_row(schema: str, read, data: Column) -> Column:
    """`read(bytes)` of each value in Arrow batches, as `schema`; null for null. AT_ONCE values are Python objects at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(schema))

    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else read(v) for v in values.slice(i, AT_ONCE).to_pylist()], kind) for i in range(0, len(values), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}  # by name they would be looked up among globals
    return F.arrow_udf(run, schema)(data)


def ber_elements(data: bytes | None, deepest: int = 64) -> list[dict]:
    """Elements of ASN.1's basic encoding with the tags on the way to each, in hexadecimal with slashes, in order.

    What lies deeper than `deepest` levels stays inside of the value of its level.
    """
    out: list[dict] = []

    def walk(start: int, end: int, way: str, level: int) -> None:
        at = start
        while at + 2 <= end:
            tag, size, at = data[at], data[at + 1], at + 2
            if size >= 128:
                n = size & 127
                size, at = int.from_bytes(data[at : at + n]), at + n
            if at + size > end:
                return
            path = f"{way}/{tag:02x}" if way else f"{tag:02x}"
            out.append({"path": path, "value": data[at : at + size]})
            if tag & 0x20 and level < deepest:
                walk(at, at + size, path, level + 1)
            at += size

    if data:
        walk(0, len(data), "", 1)
    return out


def ber_tree(data: Column) -> Column:
    """array<struct<path, value>> of `ber_elements`, in Arrow batches; empty for null."""
    return by_row("array<struct<path:string,value:binary>>", ber_elements, F.coalesce(data, F.lit(b"")))


def at_path(tree: Column, *paths: str) -> Column:
    """array<binary>: values of the elements on these paths, in order."""
    return F.transform(F.filter(tree, lambda e: e["path"].isin(*paths)), lambda e: e["value"])


def first_at(tree: Column, *paths: str) -> Column:
    return F.get(at_path(tree, *paths), F.lit(0))


def ber_number(value: Column) -> Column:
    return F.conv(F.hex(value), 16, 10).cast("long")


def lines(data: Column) -> Column:
    """Lines of a text protocol, without their ends and without what follows the last end."""
    parts = F.split(text(data), "\r?\n")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def words_of_flags(value: Column, names: dict[int, str]) -> Column:
    """Names of the set bits, in the order of `names`."""
    return F.array_compact(F.array(*[F.when(bit(value, mask), name) for mask, name in names.items()]))


def named(value: Column, names: dict[int, str]) -> Column:
    """The name of a number; "other" for a number without one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, value.cast("int")), F.lit("other")))
