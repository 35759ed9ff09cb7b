"""Exact substring dedup by suffix arrays that are built by two-stage sorting.

A window is LENGTH bytes, and its anchor is one of its grams, picked by the bytes of the window alone. So equal windows
meet by their anchors, and texts are compared only around anchors that two documents share: a segment is the run of
bytes whose windows have one anchor. Equal segments are counted once. The different segments of an anchor are sorted as
suffixes: those smaller than their successors directly, the others by scanning buckets; adjacent common prefixes of
LENGTH bytes tell which windows are equal, and which document has them first. Anchors with very many segments are dealt
to several suffix arrays, whose windows are combined.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import discard, durable, pieces, text_key
from tidelane.llm.linking import MOST_IDS, few, mixed

#: Bytes of a repeated string, of the grams, and grams in such a string.
LENGTH, GRAM = 50, 28
WIDTH = LENGTH - GRAM + 1
#: Bytes of the short grams whose least one places the anchor. LENGTH - SHORT is a multiple of WIDTH less one, so that anchors move forward only.
SHORT = 5
#: Different segments of an anchor that one suffix array takes.
PART = 4_000
#: Bytes of segments that are sorted together, and of those that one task gets on average.
SORTED, TASK = 1_000_000, 4_000_000
#: Windows that are looked at together, and anchors that a task remembers.
STRIDE, REMEMBERED = 1 << 19, 1 << 19
LATE = (1 << 63) - 1


def wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number; `data` must go on for eight bytes."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(np.uint64).ravel()


def anchors(data: np.ndarray) -> np.ndarray:
    """The place of the anchor of each window of `data`.

    Of the short grams of a window the least in a fixed order of their bytes, the first on ties, is p bytes from its
    start; the anchor starts p % WIDTH bytes from there. What surrounds a window makes no difference.
    """
    n, out = len(data) - LENGTH + 1, []
    for start in range(0, n, STRIDE):
        count = min(STRIDE, n - start)
        part = data[start : start + count + LENGTH - 1].astype(np.uint64)
        grams = part[: len(part) - SHORT + 1]
        for k in range(1, SHORT):
            grams = grams << np.uint64(8) | part[k : len(part) - SHORT + 1 + k]
        # A permutation of five-byte numbers, above the place, which is below 2 ** 24.
        grams = grams * np.uint64(0x9E3779B97F4A7C15)
        grams = (grams ^ (grams & np.uint64((1 << 40) - 1)) >> np.uint64(19)) * np.uint64(0xD6E8FEB86659FD93)
        least = grams << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        step, among = 1, LENGTH - SHORT + 1
        while 2 * step <= among:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:count], least[among - step : among - step + count])
        at = np.arange(count)
        out.append(start + at + ((least & np.uint64((1 << 24) - 1)).astype(np.int64) - at) % WIDTH)
    return np.concatenate([*out, np.empty(0, np.int64)])


def minimizers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, hash of the anchor's gram) of each run of windows with one anchor.

    data: the bytes of all texts, `ends` where each one ends. Windows that cross an end are left out.
    """
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = anchors(data)
    # Runs begin where the anchor or the text changes, and end before the next run or the text's last window.
    starts = np.concatenate([[0], ends[:-1]])
    new = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, starts[starts < len(at)])
    text = np.searchsorted(ends, new, side="right")
    last = np.minimum(np.concatenate([new[1:], [len(at)]]), ends[text] - LENGTH + 1) - 1
    keep = new <= last
    new, text, last = new[keep], text[keep], last[keep]
    place, h = at[new], np.zeros(len(new), dtype=np.uint64)
    for k in (*range(0, GRAM - 7, 8), GRAM - 8):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + wide(data, place + k))
    return text, new, last, h


REST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def identities(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment's bytes; the anchor's hash beside it makes 128 bits."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = size.astype(np.uint64)
    for k in range(0, int(size.max(initial=0)), 8):
        more = size > k
        word = wide(padded, start[more] + k) & REST[np.minimum(size[more] - k, 8)]
        h[more] = mixed(h[more] * np.uint64(0xD6E8FEB86659FD93) + word)
    return h


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of `data` in the order of their suffixes; suffixes alike in their first LENGTH bytes may be in any order.

    The order is that of two-stage sorting. data must end with a byte that is smaller than all others.
    """
    n = len(data)
    byte = data.astype(np.int16)
    # A suffix is of the first kind if it is smaller than its successor: of the next different byte, the larger follows.
    change = np.flatnonzero(np.diff(byte) != 0)
    if not len(change):
        return np.arange(n)[::-1].copy()
    upto = np.searchsorted(change, np.arange(n - 1), side="left")
    smaller = np.zeros(n, dtype=bool)
    ok = upto < len(change)
    place = change[np.minimum(upto, len(change) - 1)]
    smaller[:-1] = ok & (byte[place + 1] > byte[place])
    smaller[-1] = True  # the end, before everything
    direct = in_order(data, np.flatnonzero(smaller))
    starts = np.searchsorted(byte[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        found = waiting[c]
        own = np.concatenate(found) if found else np.empty(0, np.int64)
        while len(own):  # runs of c that end in what has just been placed
            before = own[own > 0] - 1
            own = before[(byte[before] == c) & ~smaller[before]]
            found.append(own)
        bucket = np.concatenate([*found, direct[starts[c] : starts[c + 1]]]) if found else direct[starts[c] : starts[c + 1]]
        if len(bucket):
            done.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[~smaller[before]]
            value = byte[before]
            for d in np.unique(value[value > c]):
                waiting[d].append(before[value == d])
    return np.concatenate(done)


def in_order(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """`places` by the LENGTH bytes from each, eight at a time; only what is still tied is looked at again."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    key = wide(padded, places).byteswap()
    places = places[np.argsort(key, kind="stable")]
    key = np.sort(key)
    new = np.ones(len(places), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(8, LENGTH, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        key = wide(padded, places[at] + k).byteswap()
        order = np.lexsort((key, group))
        places[at], group, key = places[at][order], group[order], key[order]
        differs = np.ones(len(at), dtype=bool)
        differs[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        new[at] = differs
    return places


def equal_windows(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Group number of each place in `order`: places next to each other share it if LENGTH bytes agree."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):  # common prefixes, eight bytes at a time
        words = wide(padded, order + k)
        same[1:] &= words[1:] == words[:-1]
    return np.cumsum(~same) - 1


def first_holders(bytes_: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, least owner of the window) of all windows of segments, which follow each other in `bytes_`."""
    n = len(lengths)
    ends = np.cumsum(lengths + 1)
    # Bytes go up by one where room is needed for the end mark: UTF-8 has no byte 255.
    data = np.zeros(len(bytes_) + n, dtype=np.uint8)
    data[np.arange(len(bytes_)) + np.repeat(np.arange(n), lengths)] = bytes_ + np.uint8(1)
    order = suffix_array(data)
    which = np.searchsorted(ends, order, side="right")
    whole = order + LENGTH < ends[which]
    order, which = order[whole], which[whole]
    group = equal_windows(data, order)
    least = np.full(int(group[-1]) + 1 if len(group) else 1, LATE)
    np.minimum.at(least, group, owners[which])
    return which, order - (ends - lengths - 1)[which], least[group]


def blocks(batch):
    """(slice of the batch, bytes of each text, all bytes, end of each text) for moderate amounts of text."""
    for part in pieces(batch, 1_000_000):
        texts = [(t or "").encode("utf-8", "replace") for t in part.column("text").to_pylist()]
        yield part, texts, np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])


def ranked(docs: DataFrame) -> DataFrame:
    """rank (the doc_id; the largest number for null, which comes last), key, text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LATE)).alias("rank"), text_key().alias("key"), "text")


def prints(rows: DataFrame) -> DataFrame:
    """print (hash of an anchor), rank, sure, slot: once for each document, or nearly so.

    sure: the task has met another document with the print. Of the rows with a print the first two of a task have it as
    slot, the others get a slot of their own: so a slot has about twice as many rows as there are tasks, however many
    documents share a print.
    """

    def run(batches):
        import pyarrow as pa

        seen, holder, times = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int8)
        for batch in batches:
            for part, _, data, ends in blocks(batch):
                text, _, _, h = minimizers(data, ends)
                rank = part.column("rank").to_numpy()[text]
                order = np.lexsort((rank, h))
                h, rank = h[order], rank[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (rank[1:] != rank[:-1])
                h, rank = h[new], rank[new]
                cell = (h >> np.uint64(40)).astype(np.int64) % REMEMBERED
                known = np.where(seen[cell] == h, times[cell], 0)
                new = (known != 1) | (holder[cell] != rank)  # else this row has been given already
                h, rank, cell, known = h[new], rank[new], cell[new], known[new]
                first = np.ones(len(h), dtype=bool)
                first[1:] = h[1:] != h[:-1]
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(h)))
                nth = known + np.arange(len(h)) - np.repeat(begin, size)
                sure = (known > 0) | (np.repeat(size, size) > 1)
                slot = np.where(nth > 1, mixed(h ^ (rank.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), h)
                here = cell[begin]
                holder[here] = np.where(known[begin] > 0, holder[here], rank[begin])
                seen[here], times[here] = h[begin], np.minimum(known[begin] + size, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rank), pa.array(sure), pa.array(slot.view(np.int64))], ["print", "rank", "sure", "slot"])

    return rows.select("rank", "text").mapInArrow(run, "print long, rank long, sure boolean, slot long")


def segments_of(rows: DataFrame) -> DataFrame:
    """rank, key, print, start, size, id (hash of the bytes) of the segments of the anchors in `shared` of each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, _, data, ends in blocks(batch):
                text, first, last, h = minimizers(data, ends)
                begin = np.concatenate([[0], ends[:-1]])
                cut = np.searchsorted(text, np.arange(len(ends) + 1))
                shared = part.column("shared")
                at = shared.offsets.to_numpy()
                flat = shared.values.to_numpy()
                keep = np.concatenate([np.isin(h[cut[i] : cut[i + 1]].view(np.int64), flat[at[i] : at[i + 1]]) for i in range(len(ends))]) if len(ends) else np.empty(0, bool)
                text, first, last, h = text[keep], first[keep], last[keep], h[keep]
                size = last + LENGTH - first
                yield pa.RecordBatch.from_arrays(
                    [part.column("rank").take(pa.array(text)), part.column("key").take(pa.array(text)), pa.array(h.view(np.int64)), pa.array((first - begin[text]).astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(identities(data, first, size).view(np.int64))],
                    ["rank", "key", "print", "start", "size", "id"],
                )

    return rows.mapInArrow(run, "rank long, key long, print long, start long, size int, id long")


def cut_out(rows: DataFrame) -> DataFrame:
    """print, id, owner, parts, segment for the places (print, id, parts, start, size) that each row names."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, 1_000_000):
                out = []
                for rank, text, places in zip(*[part.column(c).to_pylist() for c in ("rank", "text", "places")], strict=True):
                    data = (text or "").encode("utf-8", "replace")
                    out += [(p["print"], p["id"], rank, p["parts"], data[p["start"] : p["start"] + p["size"]]) for p in places]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["print", "id", "owner", "parts", "segment"])

    return rows.select("rank", "text", "places").mapInArrow(run, "print long, id long, owner long, parts long, segment binary")


RUNS = "print long, id long, first long, last long, owner long, least long, window binary"


def sorted_runs(segments: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(print, id, first, last): runs of windows of each segment that a smaller owner's segment has, and what they are read from.

    About SORTED bytes of segments go into one suffix array. Equal windows have one anchor, so only those of an anchor
    in several parts can meet elsewhere: they come one by one instead, with their bytes, the segment's owner and the
    least owner in this part.
    """

    def sort(table):
        import pyarrow as pa

        segment = table.column("segment").combine_chunks()
        offsets = segment.buffers()[1]
        offsets = np.frombuffer(offsets, dtype=np.int32)[segment.offset : segment.offset + len(segment) + 1]
        bytes_ = np.frombuffer(segment.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        print_, id_, owner, parts = (table.column(c).to_numpy() for c in ("print", "id", "owner", "parts"))
        which, window, least = first_holders(bytes_, np.diff(offsets), owner)
        split = parts[which] > 1
        hit = ~split & (least < owner[which])
        order = np.lexsort((window[hit], which[hit]))
        at, w = which[hit][order], window[hit][order]
        edge = np.ones(len(at) + 1, dtype=bool)
        edge[1:-1] = (at[1:] != at[:-1]) | (w[1:] != w[:-1] + 1)
        begin, end = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
        none = np.full(len(begin), -1)
        runs = [print_[at[begin]], id_[at[begin]], w[begin], w[end], none, none]
        several, place = which[split], window[split]
        each = [print_[several], id_[several], place, place, owner[several], least[split]]
        start = (offsets[:-1] - offsets[0])[several] + place
        raw = bytes_.tobytes()
        bytes_of = [None] * len(begin) + [raw[a : a + LENGTH] for a in start.tolist()]
        names = [c.split()[0] for c in RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate([a, b]).astype(np.int64)) for a, b in zip(runs, each, strict=True)], pa.array(bytes_of, pa.binary())], names)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        bytes_in = lambda batches: sum(pc.sum(pc.binary_length(b.column("segment"))).as_py() or 0 for b in batches)
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, SORTED // 4, "segment"):
                held.append(piece)
                size += bytes_in([piece])
                if size > SORTED:  # all but the last group, which may go on
                    table = pa.Table.from_batches(held)
                    last = np.logical_and.reduce([table.column(c).to_numpy() == piece.column(c)[-1].as_py() for c in ("print", "part")])
                    whole = table.num_rows - int(last.sum())
                    if whole:
                        yield sort(table.slice(0, whole))
                        held = table.slice(whole).combine_chunks().to_batches()
                        size = bytes_in(held)
        if held:
            yield sort(pa.Table.from_batches(held))

    parted = segments.withColumn("part", F.pmod(F.col("id"), F.col("parts")))
    parted = parted.repartition(tasks, "print", "part").sortWithinPartitions("print", "part")
    found = durable(parted.select("print", "id", "segment", "owner", "parts", "part").mapInArrow(run, RUNS))
    runs = found.filter("window is null").select("print", "id", "first", "last")
    each = found.filter("window is not null")
    # Windows of anchors in several parts: one row for each part and window goes into the minimum, which is combined
    # before it is shuffled, and comes back to all.
    least = each.groupBy("window").agg(F.min("least").alias("l")).select(F.col("window").alias("w"), "l")
    lost = each.filter("least >= owner").join(least, F.col("window") == F.col("w")).filter("l < owner").unionByName(each.filter("least < owner"), allowMissingColumns=True)
    return runs.unionByName(lost.select("print", "id", "first", "last")), found


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`.

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id. Null and empty texts
    have no bytes. Rows of one doc_id are one document: they take nothing from each other. A null id comes after all
    ids. Repeated rows give a row each; a text of any length is cut in strides. An empty table gives an empty result.
    doc_id must be a whole number. Columns of `docs` other than doc_id and text are ignored.
    """
    all_rows = ranked(docs)
    text = F.coalesce("text", F.lit(""))
    base = durable(all_rows.select("rank", "key", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha")))
    # A copy of the whole text of a smaller id loses everything, and takes nothing that the first copy doesn't take.
    firsts = base.filter(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("rank").alias("first"), F.max("rank").alias("most")).filter("first < most").drop("most")
    firsts = few(durable(firsts), MOST_IDS // 4)
    copies = durable(base.select("rank", "key", "sha").join(firsts, "sha").filter("rank > first").select("rank", "key").distinct())
    rows = all_rows.join(few(copies), ["rank", "key"], "left_anti")

    slot = Window.partitionBy("slot")
    met = prints(rows).withColumn("common", F.max("sure").over(slot) | (F.min("rank").over(slot) < F.max("rank").over(slot)))
    wanted = durable(met.filter("sure or common").groupBy("rank").agg(F.collect_set("print").alias("shared")))
    found = durable(segments_of(rows.join(wanted, "rank")))
    discard(wanted)
    kinds = durable(found.groupBy("print", "id").agg(F.min(F.struct("rank", "key", "start", "size")).alias("at"), F.max("rank").alias("most")).select("print", "id", F.col("at.rank").alias("owner"), "at", "most"))
    groups = durable(kinds.groupBy("print").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("print", F.ceil(F.col("kinds") / PART).alias("parts")))
    places = kinds.join(groups, "print").groupBy("at.rank", "at.key").agg(F.collect_list(F.struct("print", "id", "parts", "at.start", "at.size")).alias("places"))
    places = durable(places)
    several = durable(cut_out(rows.join(places, ["rank", "key"])))
    discard(places, groups)
    total = several.agg(F.sum(F.octet_length("segment"))).head()[0] or 0
    runs, sorted_ = sorted_runs(several, max(1, total // TASK))
    # A later holder of a segment loses all of it, the owner those windows that someone before it has. One join does both.
    windows = runs.groupBy("print", "id").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    # Written out, so that the join below has plain exchanges on both sides and Spark can split its large partitions.
    told = durable(kinds.join(windows, ["print", "id"], "left").filter("owner < most or windows is not null").select("print", "id", "owner", "windows"))
    discard(kinds, several, sorted_)
    span = lambda a, b: F.struct((F.col("start") + a).alias("a"), (F.col("start") + b).alias("b"))
    lost = F.when(F.col("rank") > F.col("owner"), F.array(span(F.lit(0).cast("long"), F.col("size").cast("long")))).otherwise(F.transform("windows", lambda w: span(w["first"], w["last"] + LENGTH)))
    each = found.join(told, ["print", "id"]).select("rank", "key", F.explode(lost).alias("span"))
    spans = each.groupBy("rank", "key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    spans = durable(spans)
    discard(found, told)
    cut = durable(rows.join(spans, ["rank", "key"]).mapInArrow(remove, "rank long, key long, n_removed long, n_spans long, kept_sha256 string").distinct())
    discard(spans)
    whole = copies.withColumn("copy", F.lit(True))
    out = base.join(cut, ["rank", "key"], "left").join(few(whole), ["rank", "key"], "left")
    none, one, copy = F.lit(0).cast("long"), F.lit(1).cast("long"), F.coalesce("copy", F.lit(False))
    return out.select(
        F.when(F.col("rank") < LATE, F.col("rank")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, one).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def remove(batches):
    """What is left of each text without its spans: how many bytes and runs went, and the hash of the rest."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for rank, key, text, spans in zip(*[batch.column(c).to_pylist() for c in ("rank", "key", "text", "spans")], strict=True):
            data, kept, at, n = text.encode("utf-8", "replace"), hashlib.sha256(), 0, 0
            for s in spans:
                if s["a"] > at or not n:
                    kept.update(data[at : s["a"]])
                    n += 1
                at = max(at, s["b"])
            kept.update(data[at:])
            merged, end = 0, 0
            for s in spans:
                merged += max(0, s["b"] - max(end, s["a"]))
                end = max(end, s["b"])
            out.append((rank, key, merged, n, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], ["rank", "key", "n_removed", "n_spans", "kept_sha256"])
