"""Flow tracking: packets of a key become flows that end after an idle time, with statistics of both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.folds import annotated


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("us", "seq")


def track(packets: DataFrame, key: str, idle_us: int) -> DataFrame:
    """`packets` with flow_no: a packet `idle_us` or more after the one before it begins a new flow of its key."""
    w = in_order(key)
    gap = F.col("us") - F.lag("us").over(w)
    return packets.withColumn("flow_no", F.sum(F.coalesce(gap >= idle_us, F.lit(False)).cast("long")).over(w))


def side(name: str, column: Column) -> Column:
    return F.sum(F.when(F.col("side") == name, column).otherwise(0))


def summaries(tracked: DataFrame, key: str, *more: Column) -> DataFrame:
    """One row for each flow: times, packets and bytes of either side, flag bits, and `more`."""
    one = F.lit(1)
    return tracked.groupBy(key, "flow_no").agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        side("initiator", one).alias("packets_initiator"),
        side("responder", one).alias("packets_responder"),
        side("initiator", F.col("bytes")).alias("bytes_initiator"),
        side("responder", F.col("bytes")).alias("bytes_responder"),
        F.bit_or("flags").cast("int").alias("flags"),
        *more,
    )


def derived(flows: DataFrame) -> DataFrame:
    """Duration, totals, mean packet size, skew of bytes and throughput."""
    total = F.col("bytes_initiator") + F.col("bytes_responder")
    packets = F.col("packets_initiator") + F.col("packets_responder")
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    return flows.select(
        "*",
        total.alias("bytes_total"),
        seconds.alias("duration_s"),
        (total / packets).alias("mean_packet"),
        F.when(total > 0, (F.col("bytes_initiator") - F.col("bytes_responder")) / total).otherwise(0.0).alias("skew"),
        F.when(seconds > 0, 8 * total / seconds).otherwise(0.0).alias("bps"),
    )


def inter_arrival(packets: DataFrame, key: str) -> DataFrame:
    """Number, mean, deviation and extremes of the gaps between packets of a key, in microseconds."""
    gaps = packets.withColumn("gap", F.col("us") - F.lag("us").over(in_order(key))).filter("gap is not null")
    return gaps.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"), F.min("gap").alias("least"), F.max("gap").alias("most"))


def active_idle(packets: DataFrame, key: str, threshold_us: int) -> DataFrame:
    """Active periods (closed by a gap over the threshold; the last one stays open and doesn't count) and idle gaps."""
    w = in_order(key)
    gap = F.col("us") - F.lag("us").over(w)
    runs = packets.withColumn("gap", gap).withColumn("run", F.sum(F.coalesce(F.col("gap") > threshold_us, F.lit(False)).cast("long")).over(w))
    each = runs.groupBy(key, "run").agg((F.max("us") - F.min("us")).alias("active"), F.max(F.when(F.col("gap") > threshold_us, F.col("gap"))).alias("idle"))
    last = F.col("run") == F.max("run").over(Window.partitionBy(key))
    return each.withColumn("active", F.when(~last, F.col("active"))).groupBy(key).agg(F.count("active").alias("n_active"), F.avg("active").alias("mean_active"), F.count("idle").alias("n_idle"), F.avg("idle").alias("mean_idle"))


def history(tracked: DataFrame, key: str, most: int = 16) -> DataFrame:
    """Letters of SYN, FIN, RST and data of each flow in order, upper case for the initiator, `most` at most.

    Only the first `most` packets that have a letter are gathered.
    """
    letters = F.concat(*[F.when(F.col("flags").bitwiseAND(F.lit(bit)) > 0, letter).otherwise("") for letter, bit in (("s", 2), ("f", 1), ("r", 4), ("d", 8))])
    mark = F.when(F.col("side") == "initiator", F.upper(letters)).otherwise(letters)
    marked = tracked.withColumn("__m", mark).withColumn("__has", (F.length("__m") > 0).cast("int"))
    nth = F.sum("__has").over(in_order(key, "flow_no").rowsBetween(Window.unboundedPreceding, 0))
    first = F.when((F.col("__has") == 1) & (F.col("__nth") <= most), F.struct("us", "seq", F.col("__m").alias("m")))
    ordered = F.array_sort(F.collect_list(first))
    return marked.withColumn("__nth", nth).groupBy(key, "flow_no").agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["m"]), ""), 1, most).alias("history"))


#: Seconds without a packet after which a flow ends, by transport.
IDLE_S = {"tcp": 300, "udp": 60, "other": 30}
FIN, SYN, RST, ACK = 1, 2, 4, 16


#: States in which a flow has ended, and what its end is called.
ENDS = {"reset": "rst", "closed": "fin"}


@cache
def next_state(state: str, flags: int, initiator: bool, other_fin: bool) -> str:
    """The TCP state of a flow after a segment with these flags from one side."""
    if flags & RST:
        return "reset"
    if state == "active" and initiator and flags & SYN:
        return "syn_sent"
    if state == "syn_sent" and not initiator and flags & SYN and flags & ACK:
        return "syn_received"
    if state == "syn_received" and initiator and flags & ACK:
        return "established"
    if state == "established" and flags & FIN:
        return "fin_wait"
    if state == "fin_wait" and flags & FIN and other_fin:
        return "closing"
    if state == "closing" and flags & ACK:
        return "closed"
    return state


def lifecycle_steps(idle_s: dict[str, int] | None = None, infer_initiator: bool = False) -> tuple[Callable[[], list], Callable[..., tuple]]:
    """A key's state at its start, and the step that takes us, l4, forward, flags and perhaps an idle time of each packet in order.

    It gives flow_no, side, state, established, reason and nth, as `with_lifecycle` tells them.
    """
    limits = IDLE_S | (idle_s or {})

    def step(s, us, l4, forward, flags, *own):
        number, last, first_forward, state, fins, ended, nth = s
        limit = own[0] if own and own[0] is not None else limits.get(l4, limits["other"])
        if number < 0 or ended or us - last >= limit * 1_000_000:
            flipped = infer_initiator and l4 == "tcp" and flags & SYN and flags & ACK
            number, first_forward, state, fins, ended = number + 1, forward != bool(flipped), "active", 0, False
        initiator, reason, before = forward == first_forward, None, state
        if l4 == "tcp":
            mine, others = (1, 2) if initiator else (2, 1)
            state = next_state(state, flags, initiator, bool(fins & others))
            fins |= mine if flags & FIN else 0
            reason = ENDS.get(state)
        s[:] = [number, us, first_forward, state, fins, reason is not None, nth + 1]
        return number, "initiator" if initiator else "responder", state, before != "established" and state == "established", reason, nth

    return lambda: [-1, 0, True, "active", 0, False, 0], step


def with_lifecycle(packets: DataFrame, key: str, idle_s: dict[str, int] | None = None, infer_initiator: bool = False, timeout: str | None = None) -> DataFrame:
    """`packets` (us, seq, l4, forward, flags) with flow_no, side, state, established, reason and nth (the packet's place) in a key's order.

    The order is by us, path (of a capture, if there is one) and seq. A flow ends at its RST, or when both sides have sent a FIN
    and an ACK follows (reason rst or fin on that packet), or when the next packet is as late as the transport's idle time or
    later. The first packet's sender is the initiator; with infer_initiator the other side is, if that packet is a SYN with an
    ACK. timeout: a column with an idle time of its own, in seconds (null for that of the transport). established: whether this
    packet completed the handshake.
    """
    start, step = lifecycle_steps(idle_s, infer_initiator)
    order = ("us", "path", "seq") if "path" in packets.columns else ("us", "seq")
    columns = ["us", "l4", "forward", "flags", *([timeout] if timeout else [])]
    return annotated(packets, key, columns, start, step, "flow_no long, side string, state string, established boolean, reason string, nth long", order)


def lifecycle(packets: DataFrame, key: str, **options) -> DataFrame:
    """us, seq, flow_no, side, state, established, reason of each packet, as `with_lifecycle` tells them."""
    return with_lifecycle(packets, key, **options).select(key, "us", "seq", "flow_no", "side", "state", "established", "reason")


def flow_ends(tracked: DataFrame, key: str) -> DataFrame:
    """One row for each flow of packets with their lifecycle: statistics, the reason of its end (idle without one), last state."""
    more = [F.coalesce(F.max("reason"), F.lit("idle_timeout")).alias("reason"), F.max_by("state", F.struct("us", "seq")).alias("state"), F.bool_or("established").alias("established")]
    return summaries(tracked, key, *more)


def ticks(tracked: DataFrame, key: str, interval_us: int) -> DataFrame:
    """key, flow_no, tick, packets, bytes: a flow's totals so far at its first packet and at the first after each interval.

    A tick is due `interval_us` or more after the one before, counted in whole intervals from the flow's start.
    """
    w = Window.partitionBy(key, "flow_no")
    upto = in_order(key, "flow_no").rowsBetween(Window.unboundedPreceding, 0)
    each = tracked.withColumn("tick", F.floor((F.col("us") - F.min("us").over(w)) / interval_us))
    each = each.withColumn("packets", F.count("*").over(upto)).withColumn("__b", F.sum("bytes").over(upto)).withColumn("__p", F.lag("tick").over(in_order(key, "flow_no")))
    return each.filter(F.col("__p").isNull() | (F.col("__p") < F.col("tick"))).select(key, "flow_no", "tick", "us", "packets", F.col("__b").alias("bytes"))


def side_gaps(tracked: DataFrame, key: str) -> DataFrame:
    """key, flow_no, and mean, std, min, max of the gaps between packets of the flow and of either side, in microseconds."""
    flow = F.col("us") - F.lag("us").over(in_order(key, "flow_no"))
    own = F.col("us") - F.lag("us").over(in_order(key, "flow_no", "side"))
    gaps = tracked.withColumn("flow", flow).withColumn("own", own)
    gaps = gaps.withColumn("fwd", F.when(F.col("side") == "initiator", F.col("own"))).withColumn("bwd", F.when(F.col("side") == "responder", F.col("own")))
    stats = [f(c).alias(f"{c}_{n}") for c in ("flow", "fwd", "bwd") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return gaps.groupBy(key, "flow_no").agg(*stats)


def capture_legs(packets: DataFrame, key: str, source: str) -> DataFrame:
    """key, forward_leg, backward_leg, inconsistent: the first non-zero source of either direction, and whether others follow."""
    first = lambda way: F.min_by(F.when(way & (F.col(source) != 0), F.col(source)), F.when(way & (F.col(source) != 0), F.struct("us", "seq")))
    ahead = F.col("forward")
    out = packets.groupBy(key).agg(first(ahead).alias("forward_leg"), first(~ahead).alias("backward_leg"), F.min(F.when(ahead & (F.col(source) != 0), F.col(source))).alias("a"), F.max(F.when(ahead, F.col(source))).alias("b"), F.min(F.when(~ahead & (F.col(source) != 0), F.col(source))).alias("c"), F.max(F.when(~ahead, F.col(source))).alias("d"))
    return out.select(key, "forward_leg", "backward_leg", (F.coalesce(F.col("a") < F.col("b"), F.lit(False)) | F.coalesce(F.col("c") < F.col("d"), F.lit(False))).alias("inconsistent"))


def retransmits(segments: DataFrame, keys: list[str]) -> DataFrame:
    """`segments` (tcp_seq, size, us, seq) with retransmit: whether all of its bytes came before on the same side."""
    end = F.max(F.col("tcp_seq") + F.col("size")).over(Window.partitionBy(*keys).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("retransmit", (F.col("size") > 0) & F.coalesce(F.col("tcp_seq") + F.col("size") <= end, F.lit(False)))


def timeline(events: DataFrame, key: str, value) -> DataFrame:
    """All events of one key in order."""
    return events.filter(F.col(key) == value).orderBy("us", "seq")


def drop_repeats(packets: DataFrame, same: list[str], within_us: int, ring: int = 256) -> DataFrame:
    """Frames unless an equal one is among the last `ring` frames and at most `within_us` older.

    The number of a frame in arrival order is `seq`, so the ring is a difference of numbers.
    """
    w = Window.partitionBy(*same).orderBy("us", "seq")
    recent = (F.col("us") - F.lag("us").over(w) <= within_us) & (F.col("seq") - F.lag("seq").over(w) <= ring)
    return packets.withColumn("__again", F.coalesce(recent, F.lit(False))).filter("not __again").drop("__again")
