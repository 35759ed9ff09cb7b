"""Byte streams out of TCP segments, and datagrams out of IPv4 fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import reassembly
from tidelane.operators.folds import ordered_fold

#: Bytes that may wait behind a hole, and microseconds after which a hole is given up.
WAITING, PATIENCE_US = 256 * 1024, 1_000_000


def reassemble(segments: DataFrame, keys: list[str], policy: str = "first", waiting: int = WAITING, patience_us: int = PATIENCE_US) -> DataFrame:
    """keys, offset, chunk, gap, inconsistent of `reassembly.chunks`, whose rules have more to choose from."""
    got = reassembly.chunks(segments, keys, reassembly.Rules(policy=policy, waiting=waiting, patience_us=patience_us))
    return got.select(*keys, "offset", "chunk", "gap", "inconsistent")


def overflow(chunks: DataFrame, keys: list[str], cap: int, policy: str = "sliding_window") -> DataFrame:
    """`chunks` under a cap on bytes of a side: its last `cap` bytes (sliding_window), or none of a side over it (drop_flow)."""
    total = F.sum(F.length("chunk")).over(Window.partitionBy(*keys))
    if policy == "drop_flow":
        return chunks.withColumn("__t", total).filter(F.col("__t") <= cap).drop("__t")
    after = F.sum(F.length("chunk")).over(Window.partitionBy(*keys).orderBy("offset").rowsBetween(1, Window.unboundedFollowing))
    room = F.greatest(cap - F.coalesce(after, F.lit(0)), F.lit(0))
    out = chunks.withColumn("__cut", F.greatest(F.length("chunk") - room, F.lit(0)).cast("int"))
    out = out.withColumn("chunk", F.col("chunk").substr(F.col("__cut") + 1, F.length("chunk"))).withColumn("offset", F.col("offset") + F.col("__cut"))
    return out.filter(F.length("chunk") > 0).drop("__cut")


def until_gap(chunks: DataFrame, keys: list[str], response: str = "stop_side") -> DataFrame:
    """`chunks` as a parser gets them: all (continue), those of a side before its first gap (stop_side), of both sides (stop).

    The last of `keys` is the side.
    """
    if response == "continue":
        return chunks
    of = keys if response == "stop_side" else keys[:-1]
    before = F.sum(F.col("gap")).over(Window.partitionBy(*of).orderBy("offset", *keys[len(of) :]).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("__g", before).filter("__g = 0").drop("__g")


def with_missing(frames: DataFrame, length: str = "size", wire: str = "wire_size") -> DataFrame:
    """`frames` with missing: payload bytes that the capture cut off; they are a gap of the stream."""
    return frames.withColumn("missing", F.greatest(F.col(wire) - F.col(length), F.lit(0)))


def defragment(fragments: DataFrame, timeout_us: int = 30_000_000, most: int = 65_535) -> DataFrame:
    """src_ip, dst_ip, proto, id, us, payload of IPv4 datagrams whose fragments are complete.

    fragments: us, seq, src_ip, dst_ip, proto, id, fragment (offset), mf, payload. Any overlap drops the datagram, as do
    more than `most` bytes or `timeout_us` after its first fragment. A datagram has 8,192 fragments at most.
    """
    keys = ["src_ip", "dst_ip", "proto", "id"]

    def step(s, us, seq, offset, more, payload):
        if s and us - s[0] > timeout_us:
            s.clear()
        if not s:
            s[:] = [us, {}, None, False]
        s[3] = s[3] or any(offset < a + len(p) and a < offset + len(payload) for a, p in s[1].items()) or offset + len(payload) > most
        s[1][offset] = payload
        s[2] = s[2] if more else offset + len(payload)
        if s[2] is None or sum(map(len, s[1].values())) < s[2]:
            return []
        whole, dropped = b"".join(p for _, p in sorted(s[1].items())), s[3]
        s.clear()
        return [] if dropped else [(us, whole)]

    return ordered_fold(fragments, keys, ["fragment", "mf", "payload"], list, step, "us long, payload binary")
