"""Bytes of one side of a TCP flow in order: waiting pieces as intervals, holes given up by evidence, time or size.

A side is folded by one task; its state is the waiting pieces, whose bytes and number `Rules.waiting` bounds.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.folds import ordered_fold

POLICIES = ("first", "last", "lower_seq", "higher_seq")
WRAP, HALF = 1 << 32, 1 << 31


@dataclass(frozen=True)
class Rules:
    """When a hole is given up, in bytes and microseconds.

    waiting: bytes behind holes, with PIECE for each piece (0: never wait). patience_us: without progress, once two
    segments wait or an acknowledgement vouches for the hole; four times that without. grace_us: after an acknowledgement of missing
    bytes. ahead: farther ones are strays until a second segment or an acknowledgement confirms them. cap: bytes that one packet may
    release, beyond which `overflow` keeps the last ones (sliding_window) or ends the side (drop_flow).
    """

    policy: str = "first"
    waiting: int = 256 * 1024
    patience_us: int = 1_000_000
    grace_us: int = 10_000
    ahead: int = 1 << 20
    cap: int | None = None
    overflow: str = "sliding_window"


#: What a piece counts besides its bytes, and how many given-up ranges are remembered.
PIECE, REMEMBERED = 64, 8


class Piece:
    """Bytes from `start` on, with room in front that doubles, so that either end grows in constant time a byte.

    origins: for policies by sequence number, where the segment that each byte came from starts.
    """

    __slots__ = ("start", "data", "head", "origins")

    def __init__(self, start: int, data: bytes, origin: int | None):
        self.start, self.data, self.head = start, bytearray(data), 0
        self.origins = None if origin is None else array("q", [origin]) * len(data)

    def __len__(self) -> int:
        return len(self.data) - self.head

    @property
    def end(self) -> int:
        return self.start + len(self)

    def bytes_from(self, a: int, b: int) -> bytearray:
        at = self.head - self.start
        return self.data[a + at : b + at]

    def prepend(self, data, origins) -> None:
        n = len(data)
        if self.head < n:
            room = n + len(self)
            self.data[:0] = bytes(room)
            if origins is not None:
                self.origins[:0] = array("q", bytes(8 * room))
            self.head += room
        self.head -= n
        self.start -= n
        self.data[self.head : self.head + n] = data
        if origins is not None:
            self.origins[self.head : self.head + n] = origins

    def append(self, data, origins) -> None:
        self.data += data
        if origins is not None:
            self.origins += origins


class Pieces:
    """Disjoint pieces that don't touch, by their start."""

    def __init__(self, policy: str):
        self.policy, self.by_origin = policy, policy in ("lower_seq", "higher_seq")
        self.starts: list[int] = []
        self.at: dict[int, Piece] = {}
        self.size = 0

    def charged(self) -> int:
        return self.size + PIECE * len(self.starts)

    def insert(self, start: int, data: bytes) -> tuple[int, bool]:
        """(bytes that differ from waiting ones, whether any overlap). The policy decides which of them stay."""
        end, different, overlapped = start + len(data), 0, False
        i = bisect_right(self.starts, start)
        if i and self.at[self.starts[i - 1]].end >= start:
            i -= 1
        hit = [self.at[s] for s in self.starts[i : bisect_right(self.starts, end)]]
        if not hit:
            self.starts.insert(i, start)
            self.at[start] = Piece(start, data, start if self.by_origin else None)
            self.size += len(data)
            return 0, False
        for piece in hit:
            a, b = max(start, piece.start), min(end, piece.end)
            if a >= b:
                continue
            overlapped = True
            fresh = data[a - start : b - start]
            if piece.bytes_from(a, b) != fresh:
                different += self.settle(piece, a, fresh, start)
        fill, cursor = [], start
        for piece in hit:
            if piece.start > cursor:
                fill.append((cursor, piece.start, None))
            fill.append((piece.start, piece.end, piece))
            cursor = max(cursor, piece.end)
        if cursor < end:
            fill.append((cursor, end, None))
        base = max((k for k, f in enumerate(fill) if f[2]), key=lambda k: len(fill[k][2]), default=None)
        if base is None:
            whole = Piece(start, data, start if self.by_origin else None)
            self.size += len(data)
        else:
            whole = fill[base][2]
            for lo, hi, piece in reversed(fill[:base]):
                whole.prepend(*self.part(lo, hi, piece, start, data))
            for lo, hi, piece in fill[base + 1 :]:
                whole.append(*self.part(lo, hi, piece, start, data))
        for piece in hit:
            self.at.pop(piece.start, None)
        for k in range(i, i + len(hit)):
            self.at.pop(self.starts[k], None)
        self.starts[i : i + len(hit)] = [whole.start]
        self.at[whole.start] = whole
        return different, overlapped

    def settle(self, piece: Piece, a: int, fresh: bytes, start: int) -> int:
        at, different = a - piece.start + piece.head, 0
        for k, byte in enumerate(fresh, at):
            if piece.data[k] == byte:
                continue
            different += 1
            if self.policy == "last" or self.by_origin and (start < piece.origins[k] if self.policy == "lower_seq" else start > piece.origins[k]):
                piece.data[k] = byte
                if self.by_origin:
                    piece.origins[k] = start
        return different

    def part(self, lo: int, hi: int, piece: Piece | None, start: int, data: bytes):
        if piece is None:
            self.size += hi - lo
            return data[lo - start : hi - start], array("q", [start]) * (hi - lo) if self.by_origin else None
        return piece.bytes_from(piece.start, piece.end), piece.origins[piece.head :] if self.by_origin else None

    def pop(self) -> Piece:
        piece = self.at.pop(self.starts.pop(0))
        self.size -= len(piece)
        return piece


class SideStream:
    """One side. `out` gathers (offset, bytes, bytes missing before them, cause); counters only grow."""

    COUNTERS = ("retransmits", "out_of_window", "dropped", "gaps", "gap_bytes", "different", "inconsistent", "oversize", "filled", "resets")
    retransmits = out_of_window = dropped = gaps = gap_bytes = different = inconsistent = oversize = filled = resets = 0

    def __init__(self, rules: Rules):
        self.rules, self.pieces, self.arrivals = rules, Pieces(rules.policy), 0
        self.anchored, self.next, self.number, self.progress = False, 0, 0, 0
        self.evidence, self.since, self.fin_at, self.stray = 0, None, None, None
        self.given_up: deque[tuple[int, int]] = deque(maxlen=REMEMBERED)
        self.out: list[tuple] = []
        self.missing, self.cause, self.stopped = 0, None, False

    def counters(self) -> tuple[int, ...]:
        return tuple(getattr(self, n) for n in self.COUNTERS)

    def anchor(self, number: int, us: int) -> None:
        if not self.anchored:
            self.anchored, self.number, self.progress = True, number % WRAP, us

    def offset(self, number: int) -> int:
        return self.next + (number - self.number + HALF) % WRAP - HALF

    def advance(self, to: int, us: int) -> None:
        self.number = (self.number + to - self.next) % WRAP
        self.next, self.progress = to, max(self.progress, us)
        if self.evidence <= self.next:
            self.since = None

    def release(self, offset: int, data: bytes) -> None:
        self.out.append((offset, bytes(data), self.missing, self.cause))
        self.missing, self.cause = 0, None

    def skip(self, to: int, us: int, cause: str) -> None:
        if to <= self.next:
            return
        self.gaps += 1
        self.gap_bytes += to - self.next
        self.given_up.append((self.next, to))
        self.missing, self.cause = self.missing + to - self.next, self.cause or cause
        self.advance(to, us)

    def ready(self, us: int) -> None:
        """What the first pieces hold up to the next hole."""
        while self.pieces.starts and self.pieces.starts[0] <= self.next:
            piece, self.arrivals = self.pieces.pop(), 0
            if piece.end > self.next:
                at, data = self.next, piece.bytes_from(self.next, piece.end)
                self.advance(piece.end, us)
                self.release(at, data)

    def skip_to_first(self, us: int, cause: str) -> None:
        self.skip(self.pieces.starts[0], us, cause)
        self.ready(us)

    def flush(self, us: int, cause: str) -> None:
        while self.pieces.starts:
            self.skip_to_first(us, cause)

    def timers(self, us: int) -> None:
        """Gives holes up whose time has come."""
        r, starts = self.rules, self.pieces.starts
        if self.since is not None and self.evidence > self.next and us - self.since >= r.grace_us:
            if not starts:
                self.skip(self.evidence, us, "acknowledged")
            while starts and starts[0] <= self.evidence:
                self.skip_to_first(us, "acknowledged")
        if starts:
            stalled = us - self.progress
            sure = self.arrivals >= 2 or len(starts) >= 2 or (self.evidence > self.next and self.evidence >= starts[0])
            if stalled > r.patience_us * (1 if sure else 4):
                self.skip_to_first(us, "deadline")
        if self.stray and us - self.stray[2] > 4 * r.patience_us:
            self.stray = None

    def confirmed(self, us: int) -> None:
        """Goes on at the stray segment."""
        offset, data, _, missing = self.stray
        self.stray = None
        self.out_of_window -= 1
        self.resets += 1
        self.flush(us, "resync")
        self.skip(offset, us, "resync")
        number = self.number
        self.segment(number, data, us)
        self.skip(offset + len(data) + missing, us, "cut")

    def far(self, offset: int, data: bytes, us: int, missing: int = 0) -> bool:
        """Whether a segment far ahead confirms the stray one, which then has been taken; else it is the stray one now."""
        if self.stray and abs(offset - self.stray[0]) <= self.rules.ahead:
            self.confirmed(us)
            return True
        self.out_of_window += 1
        self.stray = (offset, data, us, missing)
        return False

    def segment(self, number: int, data: bytes, us: int) -> None:
        if self.stopped or not data:
            return
        self.anchor(number, us)
        start, ahead = self.offset(number), self.rules.ahead
        end = start + len(data)
        if start - self.next > ahead:
            if self.far(start, data, us):
                self.segment(number, data, us)
            return
        if end <= self.next:
            if end < self.next - ahead:
                self.out_of_window += 1
            elif any(start < b and a < end for a, b in self.given_up):
                self.dropped += 1
            else:
                self.retransmits += 1
            self.timers(us)
            return
        if start < self.next:
            self.retransmits += 1
            start, data = self.next, data[self.next - start :]
        if not self.pieces.starts and start == self.next:  # in order
            self.advance(end, us)
            self.release(start, data)
            if self.since is not None or self.stray:
                self.timers(us)
            return
        blocked = bool(self.pieces.starts)
        if not blocked:
            self.progress = us  # a hole opens now
        self.arrivals += 1
        different, overlapped = self.pieces.insert(start, data)
        self.different += different
        self.inconsistent += different > 0
        self.retransmits += overlapped
        self.filled += blocked and start == self.next
        self.ready(us)
        while self.pieces.starts and self.pieces.charged() > self.rules.waiting:
            self.skip_to_first(us, "full")
        self.timers(us)

    def vouched(self, number: int, us: int) -> None:
        """The stream reaches the byte of this number, as an acknowledgement or a FIN says."""
        if not self.anchored:
            return
        offset = self.offset(number)
        if self.fin_at is not None:
            offset = min(offset, self.fin_at)
        if offset <= self.next:
            return
        if offset - self.next > self.rules.ahead:
            if self.stray and offset >= self.stray[0]:
                self.confirmed(us)
            return
        self.evidence = max(self.evidence, offset)
        self.since = us if self.since is None else self.since

    def acknowledged(self, ack: int, us: int) -> None:
        if not self.stopped:
            if (ack - 1 - self.number + HALF) % WRAP > HALF:  # beyond what has come
                self.vouched((ack - 1) % WRAP, us)
            if self.since is not None or self.pieces.starts or self.stray:
                self.timers(us)

    def fin(self, number: int, us: int) -> None:
        if not self.stopped and self.anchored and self.offset(number) >= self.next:
            self.fin_at = self.offset(number)
            self.evidence = min(self.evidence, self.fin_at)
            self.vouched(number, us)

    def cut(self, number: int, size: int, us: int) -> None:
        """Bytes that the capture left out of a packet: a gap as soon as the stream reaches them."""
        if self.stopped or size <= 0:
            return
        self.anchor(number, us)
        start = self.offset(number)
        end = start + size
        if end <= self.next:
            return
        if start - self.next > self.rules.ahead:
            if self.stray and self.stray[2] == us and self.stray[0] + len(self.stray[1]) + self.stray[3] == start:
                self.stray = (*self.stray[:3], self.stray[3] + size)
            elif self.far(start, b"", us, size):
                self.cut(number, size, us)
                return
        elif start <= self.next:
            while self.next < end:
                self.skip(min(end, self.pieces.starts[0]) if self.pieces.starts else end, us, "cut")
                self.ready(us)
        else:
            self.vouched((number + size) % WRAP, us)
        self.timers(us)

    def taken(self) -> list[tuple]:
        """What has come out since the last call, under the cap."""
        out, self.out = self.out, []
        if self.missing:
            out.append((self.next, b"", self.missing, self.cause))
            self.missing, self.cause = 0, None
        cap = self.rules.cap
        if cap is None or self.stopped:
            return [] if self.stopped else out
        total = sum(len(o[1]) for o in out)
        if total <= cap:
            return out
        if self.rules.overflow == "drop_flow":
            self.oversize += total
            self.stopped, self.pieces = True, Pieces(self.rules.policy)
            return []
        self.oversize += total - cap
        lost, kept = total - cap, []
        for offset, data, gap, cause in out:
            drop = min(lost, len(data))
            lost -= drop
            kept.append((offset + drop, data[drop:], gap + drop, "overflow" if drop else cause))
        return kept

    def finish(self) -> list[tuple]:
        self.flush(self.progress, "end")
        if self.evidence > self.next and not self.stopped:
            self.skip(self.evidence, self.progress, "end")
        return self.taken()


COLUMNS = ["tcp_seq", "payload", "syn", "fin", "ack", "missing"]


def both_ways(packets: DataFrame, side: str = "side", acks: str = "flags") -> DataFrame:
    """`packets` (tcp_seq, tcp_ack, flags, payload, and missing if there is one) as input of both sides.

    A packet is a segment of its own side, and what it acknowledges speaks for the other one.
    """
    other = F.when(F.col(side) == "initiator", "responder").otherwise("initiator")
    bit = lambda n: F.col(acks).bitwiseAND(F.lit(n)) > 0
    missing = F.col("missing").cast("long") if "missing" in packets.columns else F.lit(0).cast("long")
    nothing = F.lit(None)
    own = F.struct(F.col(side).alias("side"), F.col("tcp_seq").cast("long").alias("tcp_seq"), F.col("payload").alias("payload"), bit(2).alias("syn"), bit(1).alias("fin"), nothing.cast("long").alias("ack"), missing.alias("missing"))
    told = F.struct(other.alias("side"), nothing.cast("long").alias("tcp_seq"), nothing.cast("binary").alias("payload"), F.lit(False).alias("syn"), F.lit(False).alias("fin"), F.col("tcp_ack").cast("long").alias("ack"), F.lit(0).cast("long").alias("missing"))
    both = F.when(bit(16), F.array(own, told)).otherwise(F.array(own))
    kept = [c for c in packets.columns if c not in (side, "tcp_ack", *COLUMNS)]
    return packets.select(*kept, F.explode(both).alias("__s")).select(*kept, *[F.col(f"__s.{c}").alias(side if c == "side" else c) for c in ("side", *COLUMNS)])


def fed(s: SideStream, us: int, number, payload, syn, fin, ack, missing) -> None:
    """One row of a side."""
    if ack is not None:
        s.acknowledged(ack, us)
    if number is None:
        return
    if not (payload or missing or syn or fin):
        return
    data, missing, first = bytes(payload or b""), missing or 0, number + bool(syn)
    if syn:
        s.anchor(first, us)
    if data:
        s.segment(first % WRAP, data, us)
    if missing > 0:
        s.cut((first + len(data)) % WRAP, missing, us)
    if fin:
        s.fin((first + len(data) + missing) % WRAP, us)


def complete(segments: DataFrame) -> DataFrame:
    """`segments` with all of COLUMNS."""
    kinds = {"tcp_seq": "long", "payload": "binary", "syn": "boolean", "fin": "boolean", "ack": "long", "missing": "long"}
    return segments.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in segments.columns})


def checked(rules: Rules) -> Rules:
    if rules.policy not in POLICIES:
        raise ValueError(rules.policy)
    return rules


def chunks(segments: DataFrame, keys: list[str], rules: Rules = Rules(), placed: bool = False) -> DataFrame:  # noqa: B008 - frozen
    """keys, us, seq, n, offset, chunk, gap, cause, inconsistent: what each side has sent, in order, as it becomes known.

    segments: keys (the last one the side), us, seq, tcp_seq, payload, syn, and, where known, fin, ack (rows of `both_ways`) and
    missing. A SYN's number is that of the byte before the first. gap: bytes given up before a chunk, for `cause`: acknowledged,
    deadline, full, cut, resync, overflow, end. inconsistent: bytes so far since the last row that differed from waiting ones. Time
    passes with either side's packets. Delivered bytes stay as they are.
    """
    checked(rules)

    def rows(s, us, seq, seen):
        out = s.taken()
        different, seen[0] = s.different - seen[0], s.different if out else seen[0]
        return [(us, seq, i, o, d, g, c, different if not i else 0) for i, (o, d, g, c) in enumerate(out)]

    def step(state, us, seq, *values):
        fed(state[0], us, *values)
        state[2:] = [us, seq]
        return rows(state[0], us, seq, state[1])

    def finish(state):
        state[0].flush(state[0].progress, "end")
        if state[0].evidence > state[0].next and not state[0].stopped:
            state[0].skip(state[0].evidence, state[0].progress, "end")
        return [(u, q, n + (1 << 16), *r) for u, q, n, *r in rows(state[0], state[2], state[3], state[1])]

    schema = "us long, seq long, n int, offset long, chunk binary, gap long, cause string, inconsistent long"
    return ordered_fold(complete(segments), keys, COLUMNS, lambda: [SideStream(rules), [0], 0, 0], step, schema, finish, placed=placed)


#: What a counter's growth is called.
ANOMALIES = {"oversize": "buffer_overflow", "gaps": "stream_gap", "dropped": "out_of_order", "out_of_window": "out_of_window", "retransmits": "retransmitted", "inconsistent": "inconsistent_retransmit"}


def anomalies(segments: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008 - frozen
    """keys, us, seq, kind, count, bytes: what went wrong on a side with each row, as its counters grew.

    kind: buffer_overflow (count is in bytes), stream_gap (bytes: of the gaps), out_of_order (a segment after its hole was given up),
    out_of_window, retransmitted, inconsistent_retransmit. A stray segment that turns out right takes its own count back. Rows
    at a side's end have its last us and seq.
    """
    checked(rules)
    at = {n: i for i, n in enumerate(SideStream.COUNTERS)}

    def grown(state, us, seq):
        before, now = state[1], state[0].counters()
        state[1] = now
        return [(us, seq, kind, now[at[n]] - before[at[n]], now[at["gap_bytes"]] - before[at["gap_bytes"]] if n == "gaps" else None) for n, kind in ANOMALIES.items() if now[at[n]] > before[at[n]]]

    def step(state, us, seq, *values):
        fed(state[0], us, *values)
        state[0].taken()
        state[2:] = [us, seq]
        return grown(state, us, seq)

    def finish(state):
        state[0].finish()
        return grown(state, state[2], state[3])

    return ordered_fold(complete(segments), keys, COLUMNS, lambda: [SideStream(rules), (0,) * len(at), 0, 0], step, "us long, seq long, kind string, count long, bytes long", finish)


def side_totals(segments: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008 - frozen
    """keys and the counters of each side at its end: holes filled, gaps, bytes missing, what was sent again, strays, resets."""
    checked(rules)

    def step(state, us, seq, *values):
        fed(state[0], us, *values)
        state[0].taken()
        return ()

    def finish(state):
        state[0].finish()
        return [(state[0].next, *state[0].counters())]

    schema = ", ".join(f"{n} long" for n in ("reached", *SideStream.COUNTERS))
    return ordered_fold(complete(segments), keys, COLUMNS, lambda: [SideStream(rules)], step, schema, finish)
