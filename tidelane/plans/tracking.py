"""Queries over tracked flows, streams, sketches, enrichment and exports, and the named queries that combine them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane import sinks
from tidelane.functions import scalars
from tidelane.functions.scalars import once
from tidelane.functions.wire import frame_of, hexed
from tidelane.operators import correlate, detect, enrich, flows, folds, keys, rates, reassembly, sketches, streams
from tidelane.parsers import web
from tidelane.plans import catalog
from tidelane.plans.catalog import COOL, DAY, DGA, EV, HOSTS, HOUR, TR, page_hosts, r6
from tidelane.plans.packets import SRC, ipv4
from tidelane.plans.registry import query
from tidelane.sources import frames
from tidelane.sources.events import packets

#: Idle times, in seconds, that suit the spacing of the events.
IDLE = {"tcp": 5 * 86_400, "udp": 86_400, "other": 43_200}


def tcp_packets(spark, sf_dir) -> DataFrame:
    """Events as packets of TCP (users that aren't a multiple of 5) and UDP, sent forward by the initiator's kinds of event."""
    return packets(spark, sf_dir).withColumn("l4", F.when(F.col("src") % 5 == 0, "udp").otherwise("tcp")).withColumn("forward", F.col("side") == "initiator")


def only(frame: DataFrame, fits: Column, *columns: str) -> DataFrame:
    """Columns of the rows that fit. Not a filter, as that is pushed below what decodes and decodes everything again for itself."""
    return frame.select(F.inline(F.when(fits, F.array(F.struct(*columns)))))


def lived(spark, sf_dir) -> DataFrame:
    return flows.with_lifecycle(tcp_packets(spark, sf_dir), "src", idle_s=IDLE)


#: The fold of `lifecycle` in SQL. Of a list of packets each step puts the number of the flow, the first sender, state,
#: FIN bits and end in front of what it has given out so far.
LIFE = f"""{EV}, pk AS (SELECT src, list({{'us': us, 'seq': seq, 'tcp': src % 5 <> 0, 'fw': side = 'initiator', 'fl': flags}} ORDER BY us, seq) AS ps FROM ev GROUP BY src),
st AS (SELECT src, list_transform(ps, lambda p: {{'p': p, 'no': -1::BIGINT, 'ff': TRUE, 'st': 'active', 'fi': FALSE, 'fr': FALSE, 'en': FALSE, 'es': FALSE, 'out': []::STRUCT(seq BIGINT, no BIGINT, side VARCHAR, st VARCHAR, es BOOLEAN, reason VARCHAR)[]}}) AS ps FROM pk),
ns AS (SELECT src, list_prepend({{'p': NULL, 'no': -1::BIGINT, 'ff': TRUE, 'st': 'active', 'fi': FALSE, 'fr': FALSE, 'en': TRUE, 'es': FALSE, 'out': []::STRUCT(seq BIGINT, no BIGINT, side VARCHAR, st VARCHAR, es BOOLEAN, reason VARCHAR)[]}}, ps) AS ps FROM st),
ws AS (SELECT src, list_reduce(ps, lambda s, e: list_transform([{{'new': s.en OR s.p IS NULL OR e.p.us - s.p.us >= (CASE WHEN e.p.tcp THEN {IDLE['tcp']} ELSE {IDLE['udp']} END) * 1000000::BIGINT}}], lambda a: list_transform([{{'no': s.no + CAST(a.new AS BIGINT), 'ff': CASE WHEN a.new THEN e.p.fw ELSE s.ff END, 'st': CASE WHEN a.new THEN 'active' ELSE s.st END, 'fi': NOT a.new AND s.fi, 'fr': NOT a.new AND s.fr}}],
lambda b: list_transform([{{'i': e.p.fw = b.ff}}], lambda c: list_transform([{{'st': CASE WHEN NOT e.p.tcp THEN b.st WHEN e.p.fl & 4 > 0 THEN 'reset' WHEN b.st = 'active' AND c.i AND e.p.fl & 2 > 0 THEN 'syn_sent' WHEN b.st = 'syn_sent' AND NOT c.i AND e.p.fl & 18 = 18 THEN 'syn_received' WHEN b.st = 'syn_received' AND c.i AND e.p.fl & 16 > 0 THEN 'established'
WHEN b.st = 'established' AND e.p.fl & 1 > 0 THEN 'fin_wait' WHEN b.st = 'fin_wait' AND e.p.fl & 1 > 0 AND (CASE WHEN c.i THEN b.fr ELSE b.fi END) THEN 'closing' WHEN b.st = 'closing' AND e.p.fl & 16 > 0 THEN 'closed' ELSE b.st END}}],
lambda d: {{'p': e.p, 'no': b.no, 'ff': b.ff, 'st': d.st, 'fi': b.fi OR (e.p.tcp AND c.i AND e.p.fl & 1 > 0), 'fr': b.fr OR (e.p.tcp AND NOT c.i AND e.p.fl & 1 > 0), 'en': d.st IN ('reset', 'closed'), 'es': FALSE,
'out': list_append(s.out, {{'seq': e.p.seq, 'no': b.no, 'side': CASE WHEN c.i THEN 'initiator' ELSE 'responder' END, 'st': d.st, 'es': b.st <> 'established' AND d.st = 'established', 'reason': CASE d.st WHEN 'reset' THEN 'rst' WHEN 'closed' THEN 'fin' END}})}})[1])[1])[1])[1]) AS s FROM ns),
lf AS (SELECT src, unnest(s.out, recursive := TRUE) FROM ws), lc AS (SELECT lf.src, lf.seq, lf.no AS flow_no, lf.side AS side, st AS state, es AS established, reason, ev.us, ev.bytes, ev.flags FROM lf JOIN ev USING (seq))"""


@query(f"WITH {LIFE} SELECT seq, flow_no, side, state, established, reason FROM lc")
def tcp_states(spark, sf_dir):
    """Flow number, side and TCP state of each packet."""
    return flows.lifecycle(tcp_packets(spark, sf_dir), "src", idle_s=IDLE).select("seq", "flow_no", "side", "state", "established", "reason")


@query(f"WITH {LIFE} SELECT src, flow_no, min(us) AS start_us, max(us) AS end_us, count(*) FILTER (side = 'initiator') AS packets_initiator, CAST(sum(bytes) AS BIGINT) AS bytes, coalesce(max(reason), 'idle_timeout') AS reason, arg_max(state, (us, seq)) AS state, bool_or(established) AS established FROM lc GROUP BY ALL")
def flow_lifecycle(spark, sf_dir):
    """Flows that end by RST, by FIN of both sides, or by the idle time of their transport."""
    out = flows.flow_ends(lived(spark, sf_dir), "src")
    return out.select("src", "flow_no", "start_us", "end_us", "packets_initiator", (F.col("bytes_initiator") + F.col("bytes_responder")).alias("bytes"), "reason", "state", "established")


@query(f"WITH {LIFE}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY src, flow_no ORDER BY us, seq) AS fg, us - lag(us) OVER (PARTITION BY src, flow_no, side ORDER BY us, seq) AS og FROM lc) SELECT src, flow_no, round(avg(fg), 2) AS flow_mean, min(fg) AS flow_min, round(avg(og) FILTER (side = 'initiator'), 2) AS fwd_mean, max(og) FILTER (side = 'initiator') AS fwd_max, round(avg(og) FILTER (side = 'responder'), 2) AS bwd_mean FROM g GROUP BY ALL")
def flow_iat_sides(spark, sf_dir):
    out = flows.side_gaps(lived(spark, sf_dir), "src")
    return out.select("src", "flow_no", F.round("flow_mean", 2).alias("flow_mean"), "flow_min", F.round("fwd_mean", 2).alias("fwd_mean"), "fwd_max", F.round("bwd_mean", 2).alias("bwd_mean"))


@query(f"WITH {LIFE}, t AS (SELECT *, (us - min(us) OVER (PARTITION BY src, flow_no)) // {DAY} AS tick, count(*) OVER w AS packets, sum(bytes) OVER w AS b FROM lc WINDOW w AS (PARTITION BY src, flow_no ORDER BY us, seq)), p AS (SELECT *, lag(tick) OVER (PARTITION BY src, flow_no ORDER BY us, seq) AS prior FROM t) SELECT src, flow_no, tick, us, packets, CAST(b AS BIGINT) AS bytes FROM p WHERE prior IS NULL OR prior < tick")
def flow_ticks(spark, sf_dir):
    return flows.ticks(lived(spark, sf_dir), "src", DAY)


@query(f"""WITH {EV}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY src ORDER BY us, seq) AS d FROM ev), t AS (SELECT *, sum(CASE WHEN d >= (src % 3 + 1) * {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY us, seq) AS no FROM g) SELECT seq, CAST(no AS BIGINT) AS flow_no FROM t""")
def timeout_overrides(spark, sf_dir):
    """Idle times of one, two or three days, by user."""
    p = packets(spark, sf_dir).withColumn("l4", F.lit("udp")).withColumn("forward", F.col("side") == "initiator").withColumn("limit", (F.col("src") % 3 + 1) * 86_400)
    return flows.lifecycle(p, "src", timeout="limit").select("seq", "flow_no")


@query(f"WITH {EV}, f AS (SELECT src, arg_min(svc, (us, seq)) AS svc, arg_min(side, (us, seq)) AS side FROM ev GROUP BY src) SELECT src, CASE WHEN svc = 'signup' THEN 'responder' ELSE 'initiator' END AS side FROM f")
def initiator_inference(spark, sf_dir):
    """The side of each user's first packet; a first packet that is a SYN with an ACK comes from the responder."""
    p = tcp_packets(spark, sf_dir).withColumn("l4", F.lit("tcp")).withColumn("flags", F.when(F.col("svc") == "signup", 18).otherwise(16))
    told = flows.lifecycle(p, "src", idle_s={"tcp": 10**9}, infer_initiator=True)
    return told.groupBy("src").agg(F.min_by("side", F.struct("us", "seq")).alias("side"))


@query(f"WITH {EV}, x AS (SELECT *, CASE WHEN src % 2 = 0 THEN seq % 4 ELSE seq % 2 * 2 END AS leg, side = 'initiator' AS fw FROM ev), g AS (SELECT src, arg_min(leg, (us, seq)) FILTER (fw AND leg <> 0) AS a, arg_min(leg, (us, seq)) FILTER (NOT fw AND leg <> 0) AS b, count(DISTINCT leg) FILTER (fw AND leg <> 0) AS na, count(DISTINCT leg) FILTER (NOT fw AND leg <> 0) AS nb FROM x GROUP BY src) SELECT src, a AS forward_leg, b AS backward_leg, na > 1 OR nb > 1 AS inconsistent FROM g")
def capture_legs(spark, sf_dir):
    p = tcp_packets(spark, sf_dir).withColumn("leg", F.when(F.col("src") % 2 == 0, F.col("seq") % 4).otherwise(F.col("seq") % 2 * 2))
    return flows.capture_legs(p, "src", "leg")


@query(f"WITH {EV}, s AS (SELECT *, seq // 3 * 100 % 4000 AS n FROM ev WHERE bytes > 0), r AS (SELECT *, max(n + bytes % 1000) OVER (PARTITION BY src, side ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s), f AS (SELECT src, count(*) AS total, count(*) FILTER (bytes % 1000 > 0 AND n + bytes % 1000 <= e) AS again FROM r GROUP BY src) SELECT src, total, again, round(again / total, 6) AS rate FROM f WHERE again > 0 AND total >= 4")
def tcp_retransmit_audit(spark, sf_dir):
    """Share of segments whose bytes have all been sent before."""
    p = packets(spark, sf_dir).filter("bytes > 0").withColumn("tcp_seq", F.floor(F.col("seq") / 3) * 100 % 4000).withColumn("size", F.col("bytes") % 1000)
    each = flows.retransmits(p, ["src", "side"]).groupBy("src").agg(F.count("*").alias("total"), F.count_if("retransmit").alias("again"))
    return each.filter("again > 0 and total >= 4").withColumn("rate", F.round(F.col("again") / F.col("total"), 6))


@query(f"WITH {EV}, m AS (SELECT arg_max(src, (n, -src)) AS src FROM (SELECT src, count(*) AS n FROM ev GROUP BY src)) SELECT ev.us, seq, svc FROM ev JOIN m USING (src)")
def conversation_timeline(spark, sf_dir):
    """All events of the busiest user in order."""
    p = packets(spark, sf_dir)
    busiest = p.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select("src")
    return p.join(F.broadcast(busiest), "src").orderBy("us", "seq").select("us", "seq", "svc")


#: Three texts of an event that differ at each place: digits, and two kinds of letters for them.
DIGITS, SMALL, LARGE = "0123456789", "abcdefghij", "ABCDEFGHIJ"


def event_text(kind: str = DIGITS) -> Column:
    return F.translate(F.lpad(F.col("flow").cast("string"), 11, "0"), DIGITS, kind)


def stream_segments(spark, sf_dir) -> DataFrame:
    """Four segments for each event: of its stream, out of order, with bytes that overlap and differ."""
    ev = packets(spark, sf_dir).select("src", F.col("seq").alias("flow"))
    cut = lambda kind, a, b: F.substring(event_text(kind), a + 1, b - a)
    texts = [(0, cut(DIGITS, 0, 3)), (5, cut(SMALL, 5, 9)), (7, cut(DIGITS, 7, 11)), (3, F.concat(cut(DIGITS, 3, 5), cut(LARGE, 5, 7)))]
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("us"), F.lit(s).cast("long").alias("off"), t.alias("text")) for i, (s, t) in enumerate(texts)])
    each = ev.select("src", "flow", F.explode(parts).alias("p"))
    start = (1 << 32) - 4
    return each.select("flow", F.lit("initiator").alias("side"), "p.us", F.col("p.us").alias("seq"), ((F.col("p.off") + start + F.col("flow")) % (1 << 32)).alias("tcp_seq"), F.col("p.text").cast("binary").alias("payload"), F.lit(False).alias("syn"))


def reassembled(spark, sf_dir, policy: str) -> DataFrame:
    got = streams.reassemble(stream_segments(spark, sf_dir), ["flow", "side"], policy)
    return got.groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col("chunk").cast("string").alias("c")))), lambda x: x["c"]), "").alias("stream"), F.sum("gap").alias("gaps"), F.sum("inconsistent").alias("inconsistent"))


def stream_sql(*parts: tuple[str, int, int]) -> str:
    """Places `a` to before `b` of an event's texts, one after the other."""
    text = "lpad(CAST(event_id AS VARCHAR), 11, '0')"
    return " || ".join(f"substring(translate({text}, '{DIGITS}', '{kind}'), {a + 1}, {b - a})" for kind, a, b in parts)


def overlap_sql(*parts: tuple[str, int, int]) -> str:
    return f"SELECT event_id AS flow, {stream_sql(*parts)} AS stream, CAST(0 AS BIGINT) AS gaps, CAST(4 AS BIGINT) AS inconsistent FROM events"


# Waiting: small letters at 5 to 8, then digits at 7 to 10; then digits at 3 and 4, large letters at 5 and 6, which fill the hole.
@query(overlap_sql((DIGITS, 0, 5), (SMALL, 5, 9), (DIGITS, 9, 11)))
def overlap_first(spark, sf_dir):
    return reassembled(spark, sf_dir, "first")


@query(overlap_sql((DIGITS, 0, 5), (LARGE, 5, 7), (DIGITS, 7, 11)))
def overlap_last(spark, sf_dir):
    return reassembled(spark, sf_dir, "last")


@query(overlap_sql((DIGITS, 0, 5), (LARGE, 5, 7), (SMALL, 7, 9), (DIGITS, 9, 11)))
def overlap_lower_seq(spark, sf_dir):
    return reassembled(spark, sf_dir, "lower_seq")


@query(overlap_sql((DIGITS, 0, 5), (SMALL, 5, 7), (DIGITS, 7, 11)))
def overlap_higher_seq(spark, sf_dir):
    return reassembled(spark, sf_dir, "higher_seq")


@query(f"SELECT event_id AS flow, unnest([{stream_sql((DIGITS, 0, 3))}, {stream_sql((SMALL, 5, 9))}]) AS chunk, unnest([CAST(0 AS BIGINT), 2]) AS gap FROM events")
def stream_gaps(spark, sf_dir):
    """A hole that nothing fills is given up at the end."""
    s = stream_segments(spark, sf_dir).filter("us < 2")
    return streams.reassemble(s, ["flow", "side"]).select("flow", F.col("chunk").cast("string").alias("chunk"), "gap")


@query(f"SELECT event_id AS flow, {stream_sql((SMALL, 6, 9))} AS kept, {stream_sql((DIGITS, 0, 3))} AS parsed, event_id % 2 = 0 AS dropped FROM events")
def stream_limits(spark, sf_dir):
    """The last three bytes under a cap; what a parser sees before the first gap; flows dropped over a cap of six bytes."""
    s = stream_segments(spark, sf_dir).filter("us < 2")
    chunks = streams.reassemble(s, ["flow", "side"])
    kept = streams.overflow(chunks, ["flow", "side"], 3).select("flow", F.col("chunk").cast("string").alias("kept"))
    parsed = streams.until_gap(chunks, ["flow", "side"]).select("flow", F.col("chunk").cast("string").alias("parsed"))
    short = chunks.filter("flow % 2 = 0 or offset = 0")
    left = streams.overflow(short, ["flow", "side"], 6, "drop_flow").select("flow").distinct().withColumn("there", F.lit(True))
    return kept.join(parsed, "flow").join(left, "flow", "left").select("flow", "kept", "parsed", F.col("there").isNull().alias("dropped"))


def told(us: int, at: int | None = None, size: int = 0, kind: str = DIGITS, ack: int | None = None, missing: int = 0) -> Column:
    """A segment of an event's text, or what the other side acknowledges."""
    data = F.substring(event_text(kind), at + 1, size).cast("binary") if at is not None else F.lit(None).cast("binary")
    number = lambda n: F.lit(None if n is None else (1 << 32) - 4 + n).cast("long") % (1 << 32)
    return F.struct(F.lit(us).cast("long").alias("us"), number(at).alias("tcp_seq"), data.alias("payload"), number(ack).alias("ack"), F.lit(missing).cast("long").alias("missing"))


def cause_segments(spark, sf_dir) -> DataFrame:
    """By event_id modulo 7: a hole that an acknowledgement vouches for; one before two segments and one before a lone one that wait
    too long; one at the end; bytes cut by the capture; too many pieces; and a segment sent again in other letters."""
    cases = [
        [told(10, 0, 3), told(20, 5, 2), told(30, ack=8), told(10_050, ack=8)],
        [told(10, 0, 3), told(20, 5, 2), told(900_000, 7, 1), told(1_000_030, 8, 1)],
        [told(10, 0, 3), told(20, 5, 2), told(900_000, ack=1), told(4_000_030, ack=1)],
        [told(10, 0, 3), told(20, 5, 2)],
        [told(10, 0, 3, missing=2), told(20, 5, 2)],
        [told(10, 0, 3), told(20, 5, 2), told(21, 9, 2)],
        [told(10, 0, 3), told(20, 5, 2), told(30, 4, 2, SMALL), told(40, 0, 3), told(50, 3, 1)],
    ]
    chosen = F.array(*cases[0])
    for i, case in enumerate(cases[1:], 1):
        chosen = F.when(F.col("flow") % 7 == i, F.array(*case)).otherwise(chosen)
    each = packets(spark, sf_dir).select("src", F.col("seq").alias("flow")).select("src", "flow", F.posexplode(chosen).alias("seq", "p"))
    return each.select("src", "flow", F.lit("initiator").alias("side"), F.col("seq").cast("long").alias("seq"), "p.*")


#: Of the cases: when the hole is given up, and why. The last one is filled.
GIVEN_UP = "CASE event_id % 7 WHEN 0 THEN 10050 WHEN 1 THEN 1000030 WHEN 2 THEN 4000030 WHEN 3 THEN 20 WHEN 4 THEN 10 ELSE 21 END"
RULES = reassembly.Rules(waiting=130)


@query(f"SELECT event_id AS flow, CAST({GIVEN_UP} AS BIGINT) AS us, ['acknowledged', 'deadline', 'deadline', 'end', 'cut', 'full'][event_id % 7 + 1] AS cause, CAST(2 AS BIGINT) AS gap, CASE event_id % 7 WHEN 1 THEN {stream_sql((DIGITS, 5, 9))} WHEN 4 THEN '' ELSE {stream_sql((DIGITS, 5, 7))} END AS chunk FROM events WHERE event_id % 7 < 6")
def holes_given_up(spark, sf_dir):
    """When each hole before byte 5 is given up, and why; the last event of seven fills its hole."""
    got = reassembly.chunks(cause_segments(spark, sf_dir), ["flow", "side"], RULES)
    return got.filter("gap > 0 and offset <= 5").select("flow", "us", "cause", "gap", F.col("chunk").cast("string").alias("chunk"))


KINDS = """SELECT event_id AS flow, CAST(40 AS BIGINT) AS us, 'retransmitted' AS kind, CAST(1 AS BIGINT) AS n FROM events WHERE event_id % 7 = 6
UNION ALL SELECT event_id, 30, kind, 1 FROM events, (SELECT unnest(['retransmitted', 'inconsistent_retransmit']) AS kind) WHERE event_id % 7 = 6"""


@query(f"SELECT event_id AS flow, CAST({GIVEN_UP} AS BIGINT) AS us, 'stream_gap' AS kind, CAST(1 AS BIGINT) AS n FROM events WHERE event_id % 7 < 6 UNION ALL SELECT event_id, 21, 'stream_gap', 1 FROM events WHERE event_id % 7 = 5 UNION ALL {KINDS}")
def stream_anomalies(spark, sf_dir):
    """Gaps, segments sent again, and those whose bytes differ, as the counters of each side grow."""
    got = reassembly.anomalies(cause_segments(spark, sf_dir), ["flow", "side"], RULES)
    return got.select("flow", "us", "kind", F.col("count").alias("n"))


@query("SELECT CAST(user_id AS BIGINT) AS src, count(*) AS flows, count(*) AS segments, min(event_id) AS first_flow FROM events WHERE event_id % 7 = 6 GROUP BY user_id")
def tcp_evasion_detector(spark, sf_dir):
    """Sources whose segments overlap waiting ones with other bytes: how many flows, how many segments, and the first flow."""
    got = reassembly.anomalies(cause_segments(spark, sf_dir), ["src", "flow", "side"], RULES)
    return got.filter("kind = 'inconsistent_retransmit'").groupBy("src").agg(F.countDistinct("flow").alias("flows"), F.sum("count").alias("segments"), F.min("flow").alias("first_flow"))


@query("SELECT event_id AS id, 'HELLO ' || event_type AS payload FROM events WHERE event_id % 3 > 0")
def ip_fragment_reassembly(spark, sf_dir):
    """Datagrams of two fragments that come last first; every third has an overlap and is dropped."""
    ev = packets(spark, sf_dir)  # an identification has 16 bits: later events have another source
    first, second = F.lit("HELLO wo"), F.col("svc")
    whole = F.concat(F.lit("HELLO "), F.col("svc"))
    parts = F.array(F.struct(F.lit(1).alias("o"), F.when(F.col("seq") % 3 == 0, 4).otherwise(8).alias("at"), F.lit(False).alias("mf"), F.substring(whole, F.lit(9), F.length(whole)).alias("p")), F.struct(F.lit(2).alias("o"), F.lit(0).alias("at"), F.lit(True).alias("mf"), F.substring(whole, F.lit(1), F.lit(8)).alias("p")))
    each = ev.select("src", F.col("seq").alias("n"), F.explode(parts).alias("x"))
    f = each.select(F.col("x.o").cast("long").alias("us"), F.col("x.o").cast("long").alias("seq"), F.concat(F.lit("10.0.0."), F.floor(F.col("n") / 65536)).alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(17).alias("proto"), (F.col("n") % 65536).alias("id"), F.col("x.at").alias("fragment"), F.col("x.mf").alias("mf"), F.col("x.p").cast("binary").alias("payload"))
    return streams.defragment(f).select((F.split_part("src_ip", F.lit("."), F.lit(4)).cast("long") * 65536 + F.col("id")).alias("id"), F.col("payload").cast("string").alias("payload"))


@query(f"WITH {EV} SELECT svc, src, count(*) AS n, TRUE AS enough, TRUE AS member, count(*) FILTER (seq % 2 = 0) > count(*) FILTER (seq % 2 = 1) OR FALSE AS kept FROM ev GROUP BY ALL")
def sketch_membership(spark, sf_dir):
    """Count-min estimates never fall short and Bloom filters never forget, also after two shards are merged; removals of a counting filter."""
    ev = packets(spark, sf_dir)
    a, b = (sketches.count_min(ev.filter(F.col("seq") % 2 == i), "svc", "src") for i in (0, 1))
    asked = ev.groupBy("svc", "src").agg(F.count("*").alias("n"), F.count_if(F.col("seq") % 2 == 0).alias("even"))
    est = sketches.estimates(sketches.merge_cells(a, b), asked, "svc", "src")
    bits = sketches.bloom(ev.filter("seq % 2 = 0"), "svc", "src").unionByName(sketches.bloom(ev.filter("seq % 2 = 1"), "svc", "src")).distinct()
    member = sketches.maybe_in(bits, asked, "svc", "src")
    return asked.join(est, ["svc", "src"]).join(member, ["svc", "src"]).select("svc", "src", "n", (F.col("estimate") >= F.col("n")).alias("enough"), F.col("maybe").alias("member"), (F.col("even") > F.col("n") - F.col("even")).alias("kept"))


@query(f"WITH {EV}, c AS (SELECT svc, src, count(*) AS n, count(*) FILTER (seq % 3 = 0) AS again FROM ev GROUP BY ALL) SELECT svc, count(*) FILTER (src % 2 = 1) AS kept, count(*) FILTER (src % 2 = 1) AS kept_found, count(*) FILTER (src % 2 = 0) AS removed, CAST(0 AS BIGINT) AS removed_found FROM c GROUP BY svc")
def counting_filter(spark, sf_dir):
    """All users are put in once; those with even numbers are taken out again, and aren't found any more."""
    users = packets(spark, sf_dir).select("svc", "src").distinct()
    steps = users.withColumn("sign", F.lit(1)).unionByName(users.filter("src % 2 = 0").withColumn("sign", F.lit(-1)))
    width = sketches.bloom_width(users, "svc")
    cells = sketches.counting_bloom(steps, "svc", "src", F.col("sign"), width=width, most=255)
    got = sketches.maybe_in(cells.select("svc", "cell"), users, "svc", "src", width=width)
    odd = F.col("src") % 2 == 1
    return got.groupBy("svc").agg(F.count_if(odd).alias("kept"), F.count_if(odd & F.col("maybe")).alias("kept_found"), F.count_if(~odd).alias("removed"), F.count_if(~odd & F.col("maybe")).alias("removed_found"))


@query(f"WITH {EV}, c AS (SELECT svc, src, count(*) AS n FROM ev GROUP BY ALL) SELECT svc, src, n FROM c WHERE 100 * n >= (SELECT sum(n) FROM c AS d WHERE d.svc = c.svc)")
def heavy_talkers(spark, sf_dir):
    """Users with a hundredth or more of a service's events, out of bounded summaries of four shards that are merged."""
    ev = packets(spark, sf_dir)
    shards = [sketches.frequent_state(ev.filter(F.col("seq") % 4 == i), "svc", "src", 4096) for i in range(4)]
    got = sketches.frequent(sketches.merge_frequent(*shards, tracked=4096), "src", 100)
    return got.join(ev.groupBy("svc").agg(F.count("*").alias("of")), "svc").filter("100 * n >= of").select("svc", "src", "n")


@query(f"WITH {EV} SELECT svc, count(*) AS n, TRUE AS p50_close, TRUE AS p99_close, TRUE AS p999_close FROM ev GROUP BY svc")
def merged_digests(spark, sf_dir):
    """Quantiles of digests of three shards, merged: their ranks are within 1 %, 0.2 % and 0.1 % of those asked for (or a row)."""
    ev = packets(spark, sf_dir)
    shards = [sketches.digest(ev.filter(F.col("seq") % 3 == i), "svc", "value") for i in range(3)]
    got = sketches.merge_digests(*shards, key="svc")
    asked = {"p50": (0.5, 0.01), "p99": (0.99, 0.002), "p999": (0.999, 0.001)}
    out = got.groupBy("svc").agg(F.sum("n").alias("n"))
    for name, (q, _) in asked.items():
        out = out.join(sketches.digest_quantile(got, "svc", q).withColumnRenamed("quantile", name), "svc")
    ranks = ev.join(out.drop("n"), "svc").groupBy("svc").agg(*[F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below") for name in asked], *[F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto") for name in asked])
    near = lambda name, q, e: (F.col(f"{name}_below") <= (q + e) * F.col("n") + 1) & (F.col(f"{name}_upto") >= (q - e) * F.col("n") - 1)
    return out.join(ranks, "svc").select("svc", "n", *[near(name, q, e).alias(f"{name}_close") for name, (q, e) in asked.items()])


@query(f"WITH {EV}, c AS (SELECT svc, src, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY svc ORDER BY n DESC, src) AS k FROM c) SELECT svc, src, n FROM r WHERE k <= 32")
def top_talkers_topk(spark, sf_dir):
    return sketches.top_k(packets(spark, sf_dir), "svc", "src", 32)


@query("""WITH e AS (SELECT page_id, unnest(list_transform(range(1, length(url) - 1), lambda i: substring(url, i, 3))) AS g FROM pages), c AS (SELECT page_id, g, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY page_id) AS t FROM c) SELECT page_id, CAST(max(t) AS BIGINT) AS n, count(*) AS n_distinct, arg_max(g, (n, g)) AS mode, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM t GROUP BY page_id""")
def ngram_entropy(spark, sf_dir):
    grams = F.transform(F.sequence(F.lit(1), F.length("url") - 2), lambda i: F.substring(F.col("url"), i, 3))
    each = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("length(url) >= 3").select("page_id", F.explode(grams).alias("g"))
    return sketches.gram_entropy(each, ["page_id"], "g").withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {TR}, n AS (SELECT *, row_number() OVER w AS k, coalesce(us - lag(us) OVER w, 0) AS gap FROM tr WINDOW w AS (PARTITION BY src, flow_no ORDER BY us, seq)) SELECT src, CAST(flow_no AS BIGINT) AS flow_no, count(*) AS packets, string_agg(least(bytes, 65535), ',' ORDER BY k) FILTER (k <= 32) || '|' || string_agg(gap, ',' ORDER BY k) FILTER (k <= 32) AS shape FROM n GROUP BY ALL")
def flow_fingerprints(spark, sf_dir):
    return sketches.flow_fingerprint(catalog.tracked(spark, sf_dir), "src").select("src", "flow_no", "packets", "shape")


@query(f"""WITH {TR}, n AS (SELECT *, row_number() OVER w AS k, least(coalesce(us - lag(us) OVER w, 0), 4294967295) AS gap FROM tr WINDOW w AS (PARTITION BY src, flow_no ORDER BY us, seq)),
g AS (SELECT src, CAST(flow_no AS BIGINT) AS flow_no, list(least(bytes, 65535) ORDER BY k) FILTER (k <= 32) AS ls, list(gap ORDER BY k) FILTER (k <= 32) AS gs, CAST(coalesce(sum(bytes) FILTER (side = 'initiator'), 0) AS BIGINT) AS bi, CAST(sum(bytes) AS BIGINT) AS b, count(*) FILTER (side = 'initiator') AS pi FROM n GROUP BY ALL),
y AS (SELECT *, list_transform(flatten(list_concat(list_transform(ls, lambda x: [x // 256, x % 256]), list_transform(gs, lambda x: [x // 16777216, x // 65536 % 256, x // 256 % 256, x % 256]))), lambda x: x::HUGEINT) AS bytes FROM g)
SELECT src, flow_no, printf('%016X', list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS hash, len(ls) AS samples, round(list_avg(ls), 4) AS mean_len, round(list_avg(gs), 2) AS mean_gap, bi AS bytes_initiator, pi AS packets_initiator, round(CASE WHEN b > 0 THEN (2 * bi - b) / b ELSE 0 END, 6) AS skew FROM y""")
def flow_fingerprint_hashes(spark, sf_dir):
    out = sketches.flow_features(catalog.tracked(spark, sf_dir), "src")
    return out.select("src", "flow_no", "hash", "samples", F.round("mean_len", 4).alias("mean_len"), F.round("mean_gap", 2).alias("mean_gap"), "bytes_initiator", "packets_initiator", *r6("skew"))


@query(f"WITH {EV}, b AS (SELECT svc, us // {DAY} AS bucket, CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.02 / 0.98)) END AS bin FROM ev), m AS (SELECT x.svc, x.bucket, b.bin, count(*) AS n FROM (SELECT DISTINCT svc, bucket FROM b) x JOIN b ON b.svc = x.svc AND b.bucket BETWEEN x.bucket - 2 AND x.bucket GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY svc, bucket ORDER BY bin NULLS FIRST) AS upto, round(0.5 * (sum(n) OVER (PARTITION BY svc, bucket) - 1)) AS rank FROM m) SELECT svc, bucket, round(CASE WHEN bin IS NULL THEN 0 ELSE 2 * pow(1.02 / 0.98, bin) / (1.02 / 0.98 + 1) END, 6) AS quantile FROM c WHERE upto > rank AND upto - n <= rank")
def windowed_quantiles(spark, sf_dir):
    return rates.live_quantiles(packets(spark, sf_dir), "svc", "value", 0.5, 0.02, DAY, 3).select("svc", "bucket", *r6("quantile"))


@query(f"WITH {EV}, g AS (SELECT src, us, seq, (us - lag(us) OVER (PARTITION BY src ORDER BY us, seq)) / 3600000000.0 AS x FROM ev), xs AS (SELECT src, list(x ORDER BY us, seq) AS xs FROM g WHERE x IS NOT NULL GROUP BY src), " + catalog.ORACLES["page_hinkley"].split("xs AS (", 1)[1].split("), ", 1)[1].replace("> 150", "> 40"))
def gap_page_hinkley(spark, sf_dir):
    """Rises of the mean gap between a user's events, in hours."""
    from pyspark.sql import Window

    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("src").orderBy("us", "seq"))) / 3_600_000_000
    return folds.page_hinkley(packets(spark, sf_dir).withColumn("gap", gap), "src", "gap", 1.0, 40.0)


#: A burst of three clicks within five days, and what clears it, as a fold in SQL.
BURST = """l AS (SELECT src, list({'us': us, 'seq': seq, 'k': svc} ORDER BY us, seq) AS es FROM ev GROUP BY src), n AS (SELECT src, list_prepend({'e': NULL, 't': []::BIGINT[], 'o': []::STRUCT(us BIGINT, seq BIGINT, n INTEGER)[]}, list_transform(es, lambda e: {'e': e, 't': []::BIGINT[], 'o': []::STRUCT(us BIGINT, seq BIGINT, n INTEGER)[]})) AS es FROM l),
s AS (SELECT src, list_reduce(es, lambda s, e: list_transform([list_concat(list_filter(s.t, lambda t: e.e.us - t <= 432000000000), CASE WHEN e.e.k = 'click' THEN [e.e.us] ELSE [] END)], lambda t: CASE WHEN len(t) >= 3 AND e.e.k = '{TRIGGER}' THEN {'e': e.e, 't': []::BIGINT[], 'o': list_append(s.o, {'us': e.e.us, 'seq': e.e.seq, 'n': 3})} ELSE {'e': e.e, 't': t, 'o': s.o} END)[1]) AS s FROM n), o AS (SELECT src, unnest(s.o, recursive := TRUE) FROM s)"""


@query(f"WITH {EV}, {BURST.replace('{TRIGGER}', 'click')} SELECT * FROM o")
def click_bursts(spark, sf_dir):
    return folds.bursts(packets(spark, sf_dir), "src", "svc", "click", 3, 5 * DAY)


@query(f"WITH {EV}, {BURST.replace('{TRIGGER}', 'purchase')} SELECT * FROM o")
def failed_auth_burst(spark, sf_dir):
    """Three failures (clicks here) within five days, then a success (a purchase)."""
    return folds.bursts(packets(spark, sf_dir), "src", "svc", "click", 3, 5 * DAY, "purchase")


@query()
def event_sequences(spark, sf_dir):
    """A view, a click and a purchase in this order within ten days; tests hold it against brute force."""
    return folds.sequences(packets(spark, sf_dir), "src", "svc", ["view", "click", "purchase"], 10 * DAY)


@query(f"WITH {EV} SELECT src, count(*) AS n FROM ev GROUP BY src")
def z_scores(spark, sf_dir):
    """Values with a distance from the smoothed mean; their number is checked here, the mean by other queries."""
    return folds.z_scores(packets(spark, sf_dir), "src", "value", 0.1).groupBy("src").agg(F.count("z").alias("n"))


def records(spark, sf_dir) -> DataFrame:
    return enrich.flow_records(lived(spark, sf_dir), "src")


#: Flow records in SQL.
REC = f"""{LIFE}, rc AS (SELECT src, flow_no, min(us) AS start_us, max(us) AS end_us, coalesce(max(reason), 'idle_timeout') AS reason, count(*) FILTER (side = 'initiator') AS fp, count(*) FILTER (side = 'responder') AS bp, CAST(coalesce(sum(bytes) FILTER (side = 'initiator'), 0) AS BIGINT) AS fb, CAST(coalesce(sum(bytes) FILTER (side = 'responder'), 0) AS BIGINT) AS bb, CAST(coalesce(bit_or(flags) FILTER (side = 'initiator'), 0) AS INTEGER) AS ff, CAST(coalesce(bit_or(flags) FILTER (side = 'responder'), 0) AS INTEGER) AS bf FROM lc GROUP BY ALL)"""


@query(f"WITH {REC} SELECT src, flow_no, fp AS packets_initiator, bb AS bytes_responder, ff AS flags_initiator, bf AS flags_responder, start_us // 1000 AS start_ms, end_us // 1000 AS end_ms, CASE WHEN reason = 'idle_timeout' THEN 1 ELSE 3 END AS end_reason FROM rc")
def flow_records(spark, sf_dir):
    return records(spark, sf_dir).select("src", "flow_no", "packets_initiator", "bytes_responder", "flags_initiator", "flags_responder", "start_ms", "end_ms", "end_reason")


@query(f"""WITH {REC}, g AS (SELECT src, flow_no, side, us, seq, us - lag(us) OVER (PARTITION BY src, flow_no ORDER BY us, seq) AS fg, us - lag(us) OVER (PARTITION BY src, flow_no, side ORDER BY us, seq) AS og FROM lc), i AS (SELECT src, flow_no, avg(fg) AS a, stddev_pop(fg) AS s, max(og) FILTER (side = 'responder') AS b FROM g GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN fg > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY src, flow_no ORDER BY us, seq) AS run FROM g), q AS (SELECT src, flow_no, run, max(us) - min(us) AS active, max(fg) FILTER (fg > {12 * HOUR}) AS idle, max(run) OVER (PARTITION BY src, flow_no) AS last FROM r GROUP BY src, flow_no, run), t AS (SELECT src, flow_no, avg(active) FILTER (run < last) AS am, max(idle) AS im FROM q GROUP BY ALL)
SELECT rc.src, rc.flow_no, (end_us // 1000 - start_us // 1000) * 1000 AS flow_duration_us, fp AS total_fwd_packets, round((fb + bb) / (fp + bp), 4) AS mean_packet_length, round(CASE WHEN end_us // 1000 > start_us // 1000 THEN (fb + bb) / ((end_us // 1000 - start_us // 1000) / 1000) ELSE 0 END, 4) AS flow_bytes_per_sec, round(CASE WHEN fb > 0 THEN bb / fb ELSE 0 END, 4) AS down_up_ratio, ff & 1 AS fwd_fin, (ff >> 1) & 1 AS fwd_syn, (bf >> 4) & 1 AS bwd_ack, CASE WHEN reason = 'idle_timeout' THEN 'OTH' ELSE 'SF' END AS conn_state, round(coalesce(a, 0), 2) AS flow_iat_mean_us, round(coalesce(s, 0), 1) AS flow_iat_std_us, CAST(coalesce(b, 0) AS DOUBLE) AS bwd_iat_max_us, round(coalesce(am, 0), 2) AS active_mean_us, CAST(coalesce(im, 0) AS DOUBLE) AS idle_max_us FROM rc LEFT JOIN i USING (src, flow_no) LEFT JOIN t USING (src, flow_no)""")
def ml_features_pipeline(spark, sf_dir):
    """One vector of features for each flow."""
    tracked = lived(spark, sf_dir)
    v = enrich.feature_vectors(enrich.flow_records(tracked, "src"), flows.side_gaps(tracked, "src"), enrich.active_idle_stats(tracked, "src", 12 * HOUR), "src")
    near = lambda c, d: F.round(c, d).alias(c)
    return v.select("src", "flow_no", "flow_duration_us", "total_fwd_packets", near("mean_packet_length", 4), near("flow_bytes_per_sec", 4), near("down_up_ratio", 4), "tcp_flags.fwd_fin", "tcp_flags.fwd_syn", "tcp_flags.bwd_ack", "conn_state", near("flow_iat_mean_us", 2), near("flow_iat_std_us", 1), near("bwd_iat_max_us", 6), near("active_mean_us", 2), near("idle_max_us", 6))


@query("""WITH t AS (SELECT event_id, ['http', 'dns', NULL, 'ftp/files'][event_id % 4 + 1] AS label, ['http', 'ssh'][user_id % 2 + 1] AS found, event_id % 3 = 0 AS old, event_id % 5 = 0 AS weak, user_id % 7 = 0 AS puny, user_id % 11 = 0 AS dga FROM events),
b AS (SELECT event_id, CASE WHEN label IS NULL THEN 1 WHEN label = found THEN 0 ELSE 2 END + CASE WHEN old THEN 32 ELSE 0 END + CASE WHEN weak THEN 16 ELSE 0 END + CASE WHEN puny THEN 4096 ELSE 0 END + CASE WHEN dga THEN 128 ELSE 0 END AS bits, old, weak, puny, dga, label, found FROM t)
SELECT event_id, bits, least(255, CASE WHEN bits & 1 > 0 THEN 10 ELSE 0 END + CASE WHEN bits & 2 > 0 THEN 50 ELSE 0 END + CASE WHEN old THEN 50 ELSE 0 END + CASE WHEN weak THEN 60 ELSE 0 END + CASE WHEN puny THEN 50 ELSE 0 END + CASE WHEN dga THEN 100 ELSE 0 END) AS score, CASE WHEN dga THEN 'high' WHEN bits & 4146 > 0 THEN 'medium' WHEN bits & 1 > 0 THEN 'low' END AS severity FROM b""")
def flow_risks(spark, sf_dir):
    """Risks of a flow's port, TLS hello and names, added up."""
    e, u = F.col("event_id"), F.col("user_id")
    label = F.element_at(F.array(F.lit("http"), F.lit("dns"), F.lit(None), F.lit("ftp/files")), (e % 4 + 1).cast("int"))
    found = F.when(u % 2 == 0, "http").otherwise("ssh")
    name = F.when(u % 7 == 0, "a.xn--80ak6aa92e.com").otherwise("a.example.com")
    bits = enrich.risk_of_port(label, found).bitwiseOR(enrich.risk_of_tls(F.when(e % 3 == 0, 0x0301).otherwise(0x0303), F.when(e % 5 == 0, 0x0005).otherwise(0x1301))).bitwiseOR(enrich.risk_of_name(name, u % 11 == 0))
    out = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", bits.alias("bits"))
    return out.withColumn("r", enrich.risk_summary(F.col("bits"))).select("event_id", "bits", "r.score", "r.severity")


@query(f"""WITH {EV}, f AS (SELECT printf('02:00:00:00:%02x:%02x', (src // 256) % 256, src % 256) AS mac, us, seq, svc, CASE WHEN svc = 'view' THEN '10.0.' || src % 256 || '.' || seq % 256 END AS ip, CASE svc WHEN 'click' THEN 'n' || seq % 4 END AS name, CASE svc WHEN 'signup' THEN 'v' || seq % 3 END AS vendor, CASE svc WHEN 'purchase' THEN CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 16 END END AS caps FROM ev),
n AS (SELECT mac, name, min((us, seq)) AS seen FROM f WHERE name IS NOT NULL GROUP BY ALL), x AS (SELECT mac, string_agg(name, ',' ORDER BY seen) AS names FROM n GROUP BY mac), g AS (SELECT mac, min(us) AS first_us, max(us) AS last_us, arg_max(vendor, (us, seq)) FILTER (vendor IS NOT NULL) AS vendor, coalesce(bit_or(caps), 0) AS c FROM f GROUP BY mac)
SELECT g.mac, first_us, last_us, vendor, names, CASE WHEN c & 1 > 0 THEN 'router' WHEN c & 16 > 0 THEN 'phone' WHEN c & 64 > 0 THEN 'host' ELSE 'unknown' END AS role FROM g LEFT JOIN x USING (mac)""")
def asset_merge(spark, sf_dir):
    """Partial assets out of four kinds of message, put together for each hardware address."""
    ev = packets(spark, sf_dir)
    mac = F.concat(F.lit("02:00:00:00:"), F.lower(hexed(F.floor(F.col("src") / 256) % 256, 1)), F.lit(":"), F.lower(hexed(F.col("src") % 256, 1)))
    part = lambda kind, **facts: enrich.partial_asset(ev.filter(F.col("svc") == kind), mac, **facts)
    s = F.col("seq")
    each = part("view", ip=F.concat(F.lit("10.0."), F.col("src") % 256, F.lit("."), s % 256), source=F.lit("arp")).unionByName(part("click", name=F.concat(F.lit("n"), s % 4), source=F.lit("dhcp"))).unionByName(part("signup", vendor=F.concat(F.lit("v"), s % 3), source=F.lit("ssdp"))).unionByName(part("purchase", capabilities=F.when(s % 3 == 0, 1).when(s % 3 == 1, 64).otherwise(16), source=F.lit("lldp"))).unionByName(part("error"))
    return enrich.merged_assets(each).select("mac", "first_us", "last_us", "vendor", F.array_join("names", ",").alias("names"), "role")


@query(f"""WITH {EV}, t AS (SELECT src, arg_max('t' || seq, (us, seq)) FILTER (svc = 'view') AS tls, arg_min('h' || seq, (us, seq)) FILTER (svc = 'click') AS web FROM ev GROUP BY src), n AS (SELECT src, 'd' || seq % 20 AS name, min((us, seq)) AS seen FROM ev WHERE svc = 'error' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seen, name) AS k FROM n), l AS (SELECT src, string_agg(name, ',' ORDER BY seen) AS names FROM r WHERE k <= 16 GROUP BY src) SELECT t.src, coalesce(tls, web) AS server_name, names FROM t LEFT JOIN l USING (src)""")
def l7_summaries(spark, sf_dir):
    ev = packets(spark, sf_dir)
    kind = F.when(F.col("svc") == "view", "tls").when(F.col("svc") == "click", "http").when(F.col("svc") == "error", "dns").otherwise("other")
    facts = ev.select("src", "us", "seq", kind.alias("kind"), F.when(kind == "tls", F.concat(F.lit("t"), "seq")).when(kind == "http", F.concat(F.lit("h"), "seq")).alias("server_name"), F.lit(None).cast("string").alias("ja4"), F.concat(F.lit("d"), F.col("seq") % 20).alias("name"))
    return enrich.l7_summaries(facts, "src").select("src", "server_name", F.array_join("names", ",").alias("names"))


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'domain' WHEN event_id % 9 = 0 THEN 'ja3' ELSE 'ip' END AS indicator_kind FROM events WHERE user_id % 7 = 0 OR event_id % 9 = 0 OR user_id % 13 = 0")
def tls_indicators(spark, sf_dir):
    """A feed of names, hashes and addresses; the first kind that matches counts, names before hashes before addresses."""
    lines = spark.range(7).select(F.element_at(F.array(*[F.lit(x) for x in ("# feed", "Bad.Example,90,list", "bad line, x", "Other.example", "", "d41d8cd98f00b204e9800998ecf8427e,10", "10.9.9.9")]), (F.col("id") + 1).cast("int")).alias("value"))
    names = enrich.feed_lines(lines.filter("value like '%ample%' or value like 'bad%' or value like '#%'"), "domain")
    hashes = enrich.feed_lines(lines.filter("value like 'd41%'"), "hash").withColumn("kind", F.lit("ja3"))
    all_ = names.unionByName(hashes).unionByName(enrich.feed_lines(lines.filter("value like '10.%'"), "ip"))
    e, u = F.col("event_id"), F.col("user_id")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("sni", F.when(u % 7 == 0, "bad.EXAMPLE").otherwise("good.example")).withColumn("ja3", F.when(e % 9 == 0, F.md5(F.lit(""))).otherwise("x")).withColumn("ip", F.when(u % 13 == 0, "10.9.9.9").otherwise("10.0.0.1"))
    return enrich.equal_indicators(ev, all_, domain="sni", ja3="ja3", ip="ip").select("event_id", "indicator_kind")


@query("SELECT 'e' || event_id || '.example' AS value, CAST(CASE WHEN event_id % 5 > 0 THEN user_id % 100 END AS INTEGER) AS reputation, CASE WHEN event_id % 5 > 0 THEN event_type END AS source FROM events WHERE event_id % 4 = 0")
def feed_loader(spark, sf_dir):
    """A feed with a line for each event: a name with a reputation and a source or alone, a remark, a bad number, or no name at all."""
    name = F.concat(F.lit(" E"), F.col("event_id"), F.lit(".Example"))
    whole = F.concat(name, F.lit(","), F.col("user_id") % 100, F.lit(" , "), F.col("event_type"))
    line = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 5 > 0, whole).otherwise(name)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("# "), name)).when(F.col("event_id") % 4 == 2, F.concat(name, F.lit(",high"))).otherwise("no name")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("value"))
    return enrich.feed_lines(lines, "domain").select("value", "reputation", "source")


@query(f"""WITH {REC}, e AS (SELECT event_id AS seq, user_id AS src, epoch_us(ts) AS us FROM events WHERE event_type = 'error') SELECT e.seq, e.us, rc.flow_no FROM e JOIN rc ON rc.src = e.src AND e.us BETWEEN start_us AND end_us""")
def icmp_explained_drops(spark, sf_dir):
    """ICMP errors with the live flow whose packet they quote; the key is that of the quoted five-tuple, with a user's number as address."""
    key = keys.canonical(F.lit("udp"), F.concat_ws(".", *[(F.shiftright("src", s) % 256).cast("string") for s in (24, 16, 8, 0)]), F.lit(40000), F.lit("192.168.0.1"), F.lit(53))
    quoted = F.concat(F.lit("03030000" + "00000000" + "4500001C" + "00000000" + "4011" + "0000"), hexed(F.col("src"), 4), F.lit("C0A80001" + "9C40" + "0035" + "00080000"))
    from tidelane.parsers.link import icmp

    errors = packets(spark, sf_dir).filter("svc = 'error'").select("seq", "us", icmp(frame_of(quoted))["inner"].alias("i"))
    errors = errors.select("seq", "us", keys.canonical(F.col("i.proto"), F.col("i.src_ip"), F.col("i.src_port"), F.col("i.dst_ip"), F.col("i.dst_port")).alias("key"))
    live = records(spark, sf_dir).select(key.alias("key"), "flow_no", "start_us", "end_us")
    return enrich.explained_by_errors(live, errors).select("seq", "us", "flow_no")


RITA = """CASE WHEN len(X) % 2 = 0 THEN (X[len(X) // 2] + X[len(X) // 2 + 1]) / 2 ELSE X[len(X) // 2 + 1] END"""


def rita_sql(x: str, without: float) -> str:
    med = lambda y: "(" + RITA.replace("X", y) + ")"
    low, high = f"{x}[1:len({x}) // 2]", f"{x}[len({x}) - len({x}) // 2 + 1:len({x})]"
    a, b, c = med(f"({low})"), med(x), med(f"({high})")
    skew = f"CASE WHEN {c} - {a} >= 10 AND {b} <> {a} AND {b} <> {c} THEN ({a} + {c} - 2 * {b}) / ({c} - {a}) ELSE 0 END"
    dev = f"(list_sort(list_transform({x}, lambda v: abs(v - {b}))))"
    mad = f"CASE WHEN {b} >= 1 THEN greatest(0, ({b} - {med(dev)}) / {b}) ELSE {without} END"
    return f"(1 - abs({skew}) + {mad}) / 2"


@query(f"""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY us DESC, seq DESC) AS r FROM ev), k AS (SELECT *, (us - lag(us) OVER (PARTITION BY src ORDER BY us, seq)) / 1e6 AS gap FROM l WHERE r <= 20), s AS (SELECT src, count(*) AS n, avg(gap) AS mg, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS g, list(CAST(bytes AS DOUBLE) ORDER BY bytes) AS z, (max(us) - min(us)) / 1e6 AS span FROM k GROUP BY src)
SELECT src, n, round({rita_sql('g', 1.0)}, 6) AS ts_score, round({rita_sql('z', 0.0)}, 6) AS ds_score FROM s WHERE n >= 10 AND mg BETWEEN 10 AND 864000""")
def rita_beacons(spark, sf_dir):
    return detect.rita_scores(packets(spark, sf_dir), ["src"], 10, 864_000).select("src", "n", *r6("ts_score", "ds_score"))


#: Names that users look up: hosts of pages, by the user's number.
LOOKUPS = f"{HOSTS}, c AS (SELECT count(*) AS n FROM pages), q AS (SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS src, host, dom FROM events, c JOIN r ON r.page_id = (event_id * 7) % c.n)"


def lookups(spark, sf_dir) -> DataFrame:
    hosts = page_hosts(spark, sf_dir).withColumn("dom", scalars.registered_domain(F.col("host")))
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").agg(F.count("*").alias("n"))
    ev = packets(spark, sf_dir).join(F.broadcast(n))  # one row
    return ev.withColumn("page_id", F.col("seq") * 7 % F.col("n")).join(hosts, "page_id").select("seq", "us", "src", "host", "dom")


#: Sightings of a domain of its own for each ten users and kind of event, which are far enough apart to be news again.
SEEN = f"{EV}, n AS (SELECT seq, us, svc || (src // 10) || '.example' AS dom FROM ev)"


@query(f"WITH {SEEN}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY dom ORDER BY us, seq) AS d, min(us) OVER () AS b FROM n) SELECT seq, dom FROM g WHERE (d IS NULL OR d > {2 * DAY}) AND us - b >= {DAY}")
def new_domains(spark, sf_dir):
    """Sightings of registered domains that are new or weren't seen for two days, after a day of warming up."""
    host = F.concat(F.lit("www."), F.col("svc"), F.floor(F.col("src") / 10).cast("string"), F.lit(".example"))
    seen = packets(spark, sf_dir).withColumn("dom", scalars.registered_domain(host))
    return detect.new_domains(seen, "dom", 2 * DAY, DAY).select("seq", "dom")


@query(f"""WITH {LOOKUPS}, x AS (SELECT a.src AS usr, a.dom, a.us, a.seq, count(DISTINCT b.host) AS live FROM q a JOIN q b ON a.dom = b.dom AND (b.us, b.seq) <= (a.us, a.seq) AND (b.us // {HOUR}) * {HOUR} >= a.us - 6 * {HOUR} WHERE length(a.host) >= 14 AND length(b.host) >= 14 GROUP BY ALL),
hits AS (SELECT dom AS src, us, seq FROM x WHERE live >= 3), {COOL.format(cool=12 * HOUR)} SELECT src AS dom, h.us AS us, h.seq AS seq FROM e""")
def dns_tunnels(spark, sf_dir):
    """Moments at which three long names under one domain were asked for within six hours."""
    q = lookups(spark, sf_dir).withColumn("all", F.lit(0))
    return detect.dns_tunnel(q, "all", "dom", "host", 14, 3, HOUR, 6, 12 * HOUR).select("dom", "us", "seq")


@query(f"WITH {HOSTS}, {DGA}, b AS ({catalog.ORACLES['beacon_scores']}), s AS (SELECT page_id % 50 AS src, min(score) AS worst FROM h JOIN g ON g.sld = regexp_extract(host, '([a-z0-9-]+)\\.example\\.', 1) AND length(sld) >= 4 GROUP BY 1), tl AS (SELECT user_id AS src FROM events GROUP BY 1 HAVING bool_or(event_type = 'signup')), a AS (SELECT src, 'beacon' AS k FROM b WHERE score >= 0.3 UNION SELECT src, 'dga' FROM s WHERE worst < -2.3 UNION SELECT src, 'tls' FROM tl) SELECT src, string_agg(k, ',' ORDER BY k) AS kinds FROM a GROUP BY src HAVING count(*) >= 2")
def composite_c2(spark, sf_dir):
    """Sources with two of: beacons, generated names, weak TLS."""
    beacons = catalog.beacon_scores(spark, sf_dir).filter("score >= 0.3").select("src", F.lit("beacon").alias("k"))
    scores = catalog.name_scores(spark, sf_dir).filter("length(sld) >= 4").withColumn("score", F.round("score", 6))
    hosts = page_hosts(spark, sf_dir).select((F.col("page_id") % 50).alias("src"), F.regexp_extract("host", r"([a-z0-9-]+)\.example\.", 1).alias("sld"))
    generated = hosts.join(scores, "sld").filter("score < -2.3").select("src", F.lit("dga").alias("k"))
    weak = packets(spark, sf_dir).filter("svc = 'signup'").select("src", F.lit("tls").alias("k"))
    each = beacons.unionByName(generated).unionByName(weak).distinct()
    return each.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("kinds"), F.count("*").alias("n")).filter("n >= 2").drop("n")


@query(f"WITH b AS ({catalog.ORACLES['beacon_scores']}) SELECT src % 10 AS grp, max(score) AS score, arg_max(src, (score, -src)) AS src FROM b GROUP BY 1")
def c2_beacon_finder(spark, sf_dir):
    """The best beacon of each group of sources."""
    b = catalog.beacon_scores(spark, sf_dir)
    return b.groupBy((F.col("src") % 10).alias("grp")).agg(F.max("score").alias("score"), F.max_by("src", F.struct("score", -F.col("src"))).alias("src"))


@query(f"WITH {EV}, c AS (SELECT a.svc, a.us, a.seq, sum(b.bytes) AS live FROM ev a JOIN ev b ON a.svc = b.svc AND (b.us, b.seq) <= (a.us, a.seq) AND (b.us // {HOUR}) * {HOUR} >= a.us - 6 * {HOUR} GROUP BY ALL) SELECT svc, round(max(live) / (6 * 3600), 6) AS peak FROM c GROUP BY svc")
def bandwidth_by_app(spark, sf_dir):
    """The greatest rate of each application over six hours."""
    live = rates.live_sum(packets(spark, sf_dir), "svc", F.col("bytes"), HOUR, 6, "live")
    return live.groupBy("svc").agg(F.round(F.max("live") / (6 * 3600), 6).alias("peak"))


@query(f"WITH {EV}, o AS (SELECT *, first(side) OVER (PARTITION BY src ORDER BY us, seq) AS began, CAST(CASE WHEN src % 4 = 0 THEN seq % 2 + 1 WHEN (side = 'initiator') = (src % 2 = 0) THEN 1 ELSE 2 END AS BIGINT) AS leg FROM ev), l AS (SELECT *, first(leg) OVER (PARTITION BY src, side ORDER BY us, seq) AS usual FROM o) SELECT seq, side = began AS by_initiator, leg, usual, leg <> usual AS strayed FROM l")
def tap_merge_orientation(spark, sf_dir):
    """Axes of direction of packets from two legs of a tap: whether the side that began sends, the leg that saw it, and the leg
    on which that side was seen first; on connections of every fourth user, legs are mixed up."""
    leg = F.when(F.col("src") % 4 == 0, F.col("seq") % 2 + 1).when((F.col("side") == "initiator") == (F.col("src") % 2 == 0), 1).otherwise(2).cast("long")
    p = packets(spark, sf_dir).withColumn("leg", leg).withColumn("forward", F.col("side") == "initiator").withColumn("l4", F.lit("other"))
    told = flows.with_lifecycle(p, "src", idle_s={"other": 10**9})
    legs = flows.capture_legs(p, "src", "leg")
    usual = F.when(F.col("forward"), F.col("forward_leg")).otherwise(F.col("backward_leg"))
    return told.join(legs, "src").select("seq", (F.col("side") == "initiator").alias("by_initiator"), "leg", usual.alias("usual"), (F.col("leg") != usual).alias("strayed"))


@query(f"""WITH {HOSTS} SELECT DISTINCT kind, value FROM (SELECT 'domain' AS kind, host AS value FROM h UNION ALL SELECT 'ip', {SRC} FROM events UNION ALL SELECT 'ja3', md5('771,4865-' || (49152 + user_id % 256) || ',0-10-11-16-43-51,29-23,') FROM events)""")
def extract_iocs(spark, sf_dir):
    """Names, addresses and fingerprints, each once."""
    from tidelane.plans.messages import ja3_hashes

    d = frames.decode(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("frame", frame_of("000000000001" + "000000000002" + "0800", ipv4(17, F.lit("0001000200080000")))))
    one = lambda frame, kind, c: frame.select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return one(page_hosts(spark, sf_dir), "domain", "host").unionByName(one(d, "ip", "src_ip")).unionByName(one(ja3_hashes(spark, sf_dir), "ja3", "ja3")).distinct()


@query(f"WITH {EV}, b AS (SELECT seq, src, svc, lag(svc) OVER (PARTITION BY src ORDER BY us, seq) AS prior FROM ev) SELECT src, count(*) AS changes, count(DISTINCT svc) AS n_macs FROM b WHERE prior <> svc GROUP BY src HAVING count(*) >= 3")
def arp_spoof_detector(spark, sf_dir):
    """Addresses whose binding changes three times or more."""
    b = correlate.bindings(packets(spark, sf_dir), "src", "svc").filter("change = 'changed'")
    return b.groupBy("src").agg(F.count("*").alias("changes"), F.count_distinct("svc").alias("n_macs")).filter("changes >= 3")


@query("SELECT event_type || '.example.org' AS sni, 'TLS1.3' AS version, count(*) AS n, count(DISTINCT user_id % 256) AS n_fingerprints FROM events GROUP BY 1")
def tls_inventory(spark, sf_dir):
    """Versions and clients' fingerprints of each server name."""
    from tidelane.plans.messages import client_hello_hex, events, server_hello_hex

    m = events(spark, sf_dir).select(web.tls_handshake(frame_of(client_hello_hex()), frame_of(server_hello_hex())).alias("m"))
    return m.groupBy("m.sni", "m.version").agg(F.count("*").alias("n"), F.count_distinct("m.ja4").alias("n_fingerprints"))


@query("WITH t AS (SELECT 't13d0206h2_' || substring(sha256('1301,' || printf('%04x', 49152 + user_id % 256)), 1, 12) || '_' || substring(sha256('0000,000a,000b,0010,002b,0033'), 1, 12) AS ja4, user_id FROM events) SELECT ja4, count(*) AS n, count(DISTINCT user_id) AS n_clients FROM t GROUP BY 1")
def client_fingerprint_catalog(spark, sf_dir):
    from tidelane.plans.messages import client_hello_hex, events

    m = events(spark, sf_dir).select("user_id", web.client_hello(web.handshakes(frame_of(client_hello_hex()))).alias("m")).select("user_id", web.ja4(F.col("m")).alias("ja4"))
    return m.groupBy("ja4").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_clients"))


@query("SELECT event_id, 'http/' || rpad(event_type, 8, '_') AS service FROM events WHERE event_id % 3 = 0")
def kerberoast_hunter(spark, sf_dir):
    from tidelane.plans.messages import kerberos_messages

    return only(kerberos_messages(spark, sf_dir), F.col("kerberoast"), "event_id", "service")


@query("SELECT event_id, 'dc=' || rpad(event_type, 8, '_') AS base FROM events WHERE user_id % 2 = 0")
def ldap_recon_hunter(spark, sf_dir):
    from tidelane.plans.messages import ldap_messages

    return only(ldap_messages(spark, sf_dir), F.col("spn_query") & (F.col("scope") == "subtree"), "event_id", "base")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def smb_lateral_movement(spark, sf_dir):
    """Connections to shares for administrators, by user."""
    from tidelane.parsers import enterprise
    from tidelane.plans.messages import smb_payloads

    said = smb_payloads(spark, sf_dir).select("user_id", once(enterprise.smb(F.col("payload"))["admin_share"]).alias("admin_share"))
    return only(said, F.col("admin_share"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


def exported(spark, sf_dir) -> DataFrame:
    """Flow records with the columns of exports."""
    r = records(spark, sf_dir)
    return r.select(
        "start_us", "end_us", F.lit("tcp").alias("proto"), F.concat(F.lit("10.0.0."), F.col("src") % 256).alias("src_ip"), F.lit(40000).alias("src_port"), F.lit("10.0.1.1").alias("dst_ip"), F.lit(80).alias("dst_port"),
        F.col("packets_initiator").alias("pkts_init"), F.col("packets_responder").alias("pkts_resp"), F.col("bytes_initiator").alias("bytes_init"), F.col("bytes_responder").alias("bytes_resp"), F.lit(0).alias("retransmits_init"), F.lit(0).alias("retransmits_resp"),
        F.col("reason").alias("end_reason"), F.col("bytes_initiator").alias("ip_bytes_init"), F.col("bytes_responder").alias("ip_bytes_resp"), enrich.zeek_state(F.col("reason")).alias("conn_state"), F.lit("S").alias("history"),
        F.col("src"), "flow_no", "start_ms", "end_ms", F.col("end_reason").alias("end_number"), F.col("flags_initiator"),
    )


SEC = "(X // 1000000) || '.' || lpad(CAST(X % 1000000 AS VARCHAR), 6, '0')"


def sec(x: str) -> str:
    return SEC.replace("X", x)


@query(f"WITH {REC} SELECT concat_ws(',', {sec('start_us')}, {sec('end_us')}, {sec('(end_us - start_us)')}, 'tcp', '10.0.0.' || src % 256, 40000, '10.0.1.1', 80, fp, bp, fb, bb, 0, 0, reason, fb, bb) AS line FROM rc")
def csv_flow_lines(spark, sf_dir):
    """All seventeen columns."""
    return sinks.flow_lines(exported(spark, sf_dir))


@query(f"WITH {REC} SELECT concat_ws(chr(9), {sec('start_us')}, 'uid', '10.0.0.' || src % 256, 40000, '10.0.1.1', 80, 'tcp', {sec('(end_us - start_us)')}, fb, bb, CASE reason WHEN 'fin' THEN 'SF' WHEN 'rst' THEN 'RSTO' ELSE 'OTH' END, 'S', fp, fb, bp, bb) AS line FROM rc")
def zeek_conn_lines(spark, sf_dir):
    """All sixteen columns; the uid, a hash, is blanked out for the comparison."""
    return sinks.zeek_conn(exported(spark, sf_dir)).select(F.regexp_replace("line", "\tC[0-9a-f]{16}\t", "\tuid\t").alias("line"))


@query(f"""WITH {EV} SELECT '{{"timestamp":"' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z","event_type":"anomaly","anomaly":{{"event":"beacon","severity":3,"technique":"T1071","src":' || src || '}}}}' AS line FROM ev WHERE svc = 'error'""")
def eve_anomaly_lines(spark, sf_dir):
    found = packets(spark, sf_dir).filter("svc = 'error'").select("us", F.lit("beacon").alias("kind"), F.lit("warning").alias("severity"), F.lit(detect.TECHNIQUES["beacon"]).alias("technique"), "src")
    return sinks.eve_anomalies(found)


@query(f"""WITH {REC} SELECT src, flow_no, '06' || '9C40' || '0A0000' || printf('%02X', src % 256) || '0050' || '0A000101' || printf('%016X%016X%016X%016X%016X%016X', fb + bb, fp + bp, fb + bb, fp + bp, start_us // 1000, end_us // 1000) || printf('%04X', ff) || CASE WHEN reason = 'idle_timeout' THEN '01' ELSE '03' END AS record FROM rc""")
def ipfix_records(spark, sf_dir):
    """Flow records as they stand in a data set; tests read whole messages."""
    return ipfix_rows(spark, sf_dir).select("src", "flow_no", sinks.ipfix_record().alias("record"))


def ipfix_rows(spark, sf_dir) -> DataFrame:
    e = exported(spark, sf_dir)
    return e.select("src", "flow_no", F.lit(6).alias("proto_number"), "src_port", "dst_port", F.concat(F.lit("0A0000"), hexed(F.col("src") % 256, 1)).alias("src_hex"), F.lit("0A000101").alias("dst_hex"), (F.col("bytes_init") + F.col("bytes_resp")).alias("octets"), (F.col("pkts_init") + F.col("pkts_resp")).alias("packets"), "start_ms", "end_ms", F.col("flags_initiator").alias("control"), F.col("end_number").alias("end_reason"))


@query(f"WITH {REC} SELECT CAST(sum(1) AS BIGINT) AS records, TRUE AS right_size, 1 AS version FROM rc")
def ipfix_messages(spark, sf_dir):
    """Whole messages: their lengths are those in their heads, and together they hold every record."""
    m = sinks.ipfix_messages(ipfix_rows(spark, sf_dir), 1_700_000_000, 7)
    size = F.conv(F.hex(F.substring("message", 3, 2)), 16, 10).cast("long")
    return m.agg(F.sum("records").alias("records"), F.every(size == F.length("message")).alias("right_size"), (F.max(F.conv(F.hex(F.substring("message", 1, 2)), 16, 10).cast("int")) - 9).alias("version"))


@query("""WITH n(i, name) AS (VALUES (1, 'octetDeltaCount'), (2, 'packetDeltaCount'), (4, 'protocolIdentifier'), (6, 'tcpControlBits'), (7, 'sourceTransportPort'), (8, 'sourceIPv4Address'), (11, 'destinationTransportPort'), (12, 'destinationIPv4Address'), (27, 'sourceIPv6Address'), (28, 'destinationIPv6Address'), (85, 'octetTotalCount'), (86, 'packetTotalCount'), (136, 'flowEndReason'), (152, 'flowStartMilliseconds'), (153, 'flowEndMilliseconds'))
SELECT event_id, CAST(event_id % 160 AS INTEGER) AS id, name, i AS number FROM events LEFT JOIN n ON i = event_id % 160""")
def ipfix_elements(spark, sf_dir):
    """Names of elements by numbers that events give, and numbers by those names."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 160).cast("int").alias("id"))
    named = ev.withColumn("name", sinks.element_name(F.col("id")))
    return named.withColumn("number", sinks.element_number(F.col("name")))


@query(f"WITH {REC} SELECT src, flow_no, reason IN ('fin') AS graceful, TRUE AS transport, FALSE AS parser, CASE reason WHEN 'fin' THEN 'SF' WHEN 'rst' THEN 'RSTO' ELSE 'OTH' END AS zeek FROM rc")
def end_reasons(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("src", "flow_no", enrich.end_kind(F.col("reason")).alias("k"), enrich.zeek_state(F.col("reason")).alias("zeek")).select("src", "flow_no", "k.*", "zeek")


@query(f"WITH {HOSTS} SELECT page_id, CASE WHEN length(host) = 18 THEN len(list_filter(range(1, 19), lambda i: substring(host, i, 1) <> substring('abc.example.network', i, 1))) END AS hamming, regexp_matches(host, '^[A-Za-z0-9+/=]{{16,}}$') AS base64, md5(host || ';' || 'a;b;c') AS hassh FROM h")
def byte_tests(spark, sf_dir):
    """Hamming distance, base64-like texts, HASSH of name lists."""
    h = page_hosts(spark, sf_dir)
    one = lambda x: F.array(F.lit(x))
    return h.select("page_id", scalars.hamming(F.col("host"), F.substring(F.lit("abc.example.network"), 1, 18)).alias("hamming"), scalars.looks_base64(F.col("host")).alias("base64"), scalars.hassh(F.array("host"), one("a"), one("b"), one("c")).alias("hassh"))


@query("SELECT event_id, ['pdf', 'png', 'zip', 'elf', 'unknown'][event_id % 5 + 1] AS kind, sha256(CASE WHEN event_id % 5 = 0 THEN '%PDF-1.7' ELSE event_type END) AS sha FROM events WHERE event_id % 5 IN (0, 4)")
def file_kinds(spark, sf_dir):
    """Kinds of files by their first bytes, and their hashes."""
    data = F.when(F.col("event_id") % 5 == 0, F.lit("%PDF-1.7")).otherwise(F.col("event_type")).cast("binary")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 5 in (0, 4)")
    return ev.select("event_id", scalars.file_kind(data).alias("kind"), F.sha2(data, 256).alias("sha"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '4:64:0:1460:' ELSE '4:128:0:1460:' END || user_id % 65536 || ',7:mss,nop,ws:df:0' AS signature FROM events")
def syn_signatures(spark, sf_dir):
    """Signatures of SYN packets: version, first TTL, sizes, window, options, quirks."""
    e, u = F.col("event_id"), F.col("user_id")
    ttl = F.when(u % 2 == 0, "3C").otherwise("7A")
    tcp = F.concat(F.lit("0400" + "0050" + "00000001" + "00000000" + "70" + "02"), hexed(u % 65536, 2), F.lit("00000000" + "020405B4" + "01" + "030307"))
    packet = F.concat(F.lit("4500"), F.lit("0030"), F.lit("0000" + "4000"), ttl, F.lit("06" + "0000" + "0A000001" + "0A000002"), tcp)
    f = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", frame_of("000000000001" + "000000000002" + "0800", packet).alias("frame"))
    return frames.decode(f).select("event_id", frames.syn_signature(F.col("frame"), F.col("ip"), F.col("tcp")).alias("signature"))
