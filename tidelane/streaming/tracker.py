"""Flows of a stream of packets: the lifecycle as state of each key, with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelane.operators.flows import ACK, FIN, IDLE_S, SYN, next_state

#: What Spark needs for timers and states of a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PACKET = "us bigint, seq bigint, l4 string, forward boolean, flags int, bytes bigint"
FLOW = "flow_no bigint, open boolean, l4 string, first_forward boolean, state string, fins int, established boolean, start_us bigint, end_us bigint, packets_initiator bigint, packets_responder bigint, bytes_initiator bigint, bytes_responder bigint, tick bigint"
EVENTS = "flow_no bigint, event string, us bigint, reason string, state string, start_us bigint, end_us bigint, packets_initiator bigint, packets_responder bigint, bytes_initiator bigint, bytes_responder bigint"
FIELDS = [f.split()[0] for f in FLOW.split(", ")]


class Tracker(StatefulProcessor):
    """State of a key: its open flow, and packets that the watermark hasn't passed, as earlier ones may still come.

    Packets are taken in order of time and number once none can come before them, so events are those of the batch operator.
    """

    def __init__(self, key: str, idle_s: dict[str, int], tick_us: int | None, infer: bool):
        self.key, self.limits, self.tick_us, self.infer = key, IDLE_S | idle_s, tick_us, infer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW)
        self.waiting = handle.getListState("waiting", PACKET)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(r.us), int(r.seq), r.l4, bool(r.forward), int(r.flags), int(r.bytes)) for frame in rows for r in frame.itertuples(index=False)]
        if came:
            self.waiting.appendList(came)
        return iter(self.due(key, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(self.due(key, timerValues))

    def due(self, key, timer_values) -> list[pd.DataFrame]:
        """Events of everything that the watermark has passed; timers for what is left."""
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        s = dict(zip(FIELDS, self.flow.get(), strict=True)) if self.flow.exists() else {"flow_no": -1, "open": False}
        out: list[tuple] = []
        for packet in ready:
            self.packet(s, out, *packet)
        if s["open"] and self.deadline(s) <= passed and not (later and later[0][0] < self.deadline(s)):
            self.end(s, out, s["end_us"], "idle_timeout")
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if s["flow_no"] >= 0:
            self.flow.update(tuple(s.get(f) for f in FIELDS))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [r[0] for r in later[:1]] + ([self.deadline(s)] if s["open"] else [])
        if times:
            self.handle.registerTimer(max(-(-min(times) // 1000), passed // 1000 + 1))
        names = [self.key, *[f.split()[0] for f in EVENTS.split(", ")]]
        return [pd.DataFrame([(key[0], *r) for r in out], columns=names)] if out else []

    def deadline(self, s: dict) -> int:
        return s["end_us"] + self.limits.get(s["l4"], self.limits["other"]) * 1_000_000

    def told(self, s: dict, event: str, us: int, reason: str | None = None) -> tuple:
        return s["flow_no"], event, us, reason, *[s[f] for f in ("state", "start_us", "end_us", "packets_initiator", "packets_responder", "bytes_initiator", "bytes_responder")]

    def end(self, s: dict, out: list, us: int, reason: str) -> None:
        out.append(self.told(s, "ended", us, reason))
        s["open"] = False

    def packet(self, s: dict, out: list, us: int, seq: int, l4: str, forward: bool, flags: int, size: int) -> None:
        limit = self.limits.get(l4, self.limits["other"]) * 1_000_000
        if s["open"] and us - s["end_us"] >= limit:
            self.end(s, out, s["end_us"], "idle_timeout")
        fresh = not s["open"]
        if fresh:
            flipped = self.infer and l4 == "tcp" and flags & SYN and flags & ACK
            s.update(dict.fromkeys(FIELDS[9:], 0), flow_no=s["flow_no"] + 1, open=True, l4=l4, first_forward=forward != bool(flipped), state="active", fins=0, established=False, start_us=us, end_us=us)
        initiator, before, reason = forward == s["first_forward"], s["state"], None
        if l4 == "tcp":
            mine, others = (1, 2) if initiator else (2, 1)
            s["state"] = next_state(before, flags, initiator, bool(s["fins"] & others))
            s["fins"] |= mine if flags & FIN else 0
            reason = {"reset": "rst", "closed": "fin"}.get(s["state"])
        side = "initiator" if initiator else "responder"
        s["end_us"] = us
        s[f"packets_{side}"] += 1
        s[f"bytes_{side}"] += size
        if fresh:
            out.append(self.told(s, "started", us))
        elif self.tick_us and (us - s["start_us"]) // self.tick_us > s["tick"]:
            s["tick"] = (us - s["start_us"]) // self.tick_us
            out.append(self.told(s, "tick", us))
        if before != "established" and s["state"] == "established":
            s["established"] = True
            out.append(self.told(s, "established", us))
        if reason:
            self.end(s, out, us, reason)


def flow_events(packets: DataFrame, key: str, ts: str, lateness: str, idle_s: dict[str, int] | None = None, tick_us: int | None = None, infer_initiator: bool = False) -> DataFrame:
    """key and EVENTS of a stream of packets (key, us, seq, l4, forward, flags, bytes): started, established, tick, ended.

    ts: the packets' event time, as a timestamp, equal to us. Packets later than `lateness` are dropped by Spark; all others count as if they
    had come in order. Flows end by RST, by FIN of both sides, or by an idle time, for which the watermark is the clock. The
    session must use the state store STATE_STORE. State of a key is its flow and its packets of the last `lateness`.
    """
    marked = packets.withWatermark(ts, lateness)
    chosen = marked.select(key, ts, "us", "seq", "l4", "forward", F.col("flags").cast("int").alias("flags"), F.col("bytes").cast("long").alias("bytes"))
    kind = packets.schema[key].dataType.simpleString()
    return chosen.groupBy(key).transformWithStateInPandas(statefulProcessor=Tracker(key, idle_s or {}, tick_us, infer_initiator), outputStructType=f"{key} {kind}, {EVENTS}", outputMode="Append", timeMode="EventTime")
