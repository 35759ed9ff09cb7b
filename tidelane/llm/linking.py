"""Links between documents with similar sets, and their components, without pairing all members of a group."""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import discard, durable, pieces

#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_IDS = 500_000
#: Members of a list beyond which it is divided before its members are paired, and members in a block of postings.
HOT = 128
#: Tokens of such lists up to which a document stands in a list for every two of them.
TOKENS = 8
#: Words of the parities that members of divided lists carry.
WORDS = 8

TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Factors of the words of a shingle, which has at most so many.
PLACE = np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of BASE by the lower 12 bits of the exponent; word_hashes makes those by its higher bits where a word is that long.
LOW = powers(BASE, 1 << 12)
#: Bytes that are hashed together.
STRIDE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], which follow each other: functions of a word's bytes alone."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRIDE, side="right")))
        part = data[starts[i] : ends[j - 1]]
        begin, size = starts[i:j] - starts[i], ends[i:j] - starts[i:j]
        room = np.diff(np.append(begin, len(part)))
        at = np.arange(len(part)) - np.repeat(begin, room)
        values = TABLE[part] * LOW[at & 4095]
        if size.max() > 4096:
            values *= powers(pow(BASE, 4096, 1 << 64), int(size.max()) // 4096 + 1)[np.minimum(at, size.max()) >> 12]
        values[at >= np.repeat(size, room)] = 0  # what stands between words
        out[i:j] = mixed(np.add.reduceat(values, begin) + size.astype(np.uint64))
        i = j
    return out


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, one text after the other, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(~before & blank)
    upto = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return word_hashes(data, starts, ends), np.diff(np.searchsorted(starts, upto))


def gram_hashes(words: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of hashed words from `at` to `last`."""
    h = (last - at + 1).astype(np.uint64)
    for k in range(int((last - at).max(initial=-1)) + 1):
        inside = at + k <= last
        h += np.where(inside, words[np.minimum(at + k, last)] * PLACE[k], np.uint64(0))
    return mixed(h)


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of each text, one text after the other with repeats, and how many each text has.

    Fewer words than `size` make one shingle; no words make none.
    """
    words, lengths = text_words(texts)
    first = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.where(lengths > 0, np.maximum(1, lengths - size + 1), 0)
    at = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return gram_hashes(words, at, np.minimum(at + size, np.repeat(first[1:], counts)) - 1), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text its distinct hashed shingles, ascending."""
    hashes, counts = shingle_hashes(texts, size)
    cuts = np.cumsum(counts)
    return [np.unique(hashes[end - n : end]) for end, n in zip(cuts, counts, strict=True)]


def few(df: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """`df` marked for a broadcast if it has `most` rows at most; else unchanged, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of `edges` (a, b); the component is the smallest id that paths reach.

    Large-star and small-star steps alternate until the edges stay the same. Minima are combined before they are
    shuffled, and the joins that bring them back are ones whose large partitions Spark can split.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        old, now = now, durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(old)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def probe(query: np.ndarray, document: np.ndarray) -> int:
    """In how many of the query's lists the document is.

    Both are ascending arrays of tokens. Of the lists, the part that belongs to one document is its array, so each token
    is looked for there by bisection.
    """
    if not len(query) or not len(document):
        return 0
    at = np.searchsorted(document, query)
    at[at == len(document)] = 0
    return int((document[at] == query).sum())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * |intersection| >= num * |union|. sets: id, elements (packed uint64)."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, 1_000_000, "x"):
                keep = []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    u, v = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                    common = probe(u, v) if len(u) < len(v) else probe(v, u)
                    keep.append(den * common >= num * (len(u) + len(v) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def exploded(sets: DataFrame, least: tuple[int, int] | None = None) -> DataFrame:
    """(id, element) of every set; least (num, den): only the smallest elements, as many as leave less than num / den."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch, 2_000_000, "elements"):
                packed = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column("elements")]
                if least:
                    packed = [x[: len(x) - -(-least[0] * len(x) // least[1]) + 1] for x in packed]
                ids = part.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in packed])), pa.array(np.concatenate([*packed, np.empty(0, np.int64)]))], ["id", "element"])

    return sets.mapInArrow(run, "id long, element long")


def able(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, met): how many elements of a set are in any other of the sets. Sets that meet too few to be linked are left out."""
    each = exploded(sets)
    shared = each.groupBy("element").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter("p < q").select("element")
    count = each.join(shared, "element", "left_semi").groupBy("id").agg(F.count("*").cast("int").alias("met"))
    return count.join(sets.select("id", (F.octet_length("elements") / 8).alias("n")), "id").filter(den * F.col("met") >= num * F.col("n")).groupBy("id").agg(F.max("met").alias("met"))


def merged(lists: DataFrame) -> DataFrame:
    """(a, b) of the documents that occur often enough in the short lists of another. lists: id, least, weight, found.

    `found` is an ascending block of ids out of one list of document `id`. The lists of a document come together and are
    merged by a heap; an id counts with the weight of each list that it is in, and stays if it reaches `least`.
    """

    def run(batches):
        import pyarrow as pa

        now, least, held = None, 0, []

        def often():
            streams = [[(b, w) for b in found] for w, found in held]
            return [(now, b) for b, same in groupby(heapq.merge(*streams), key=lambda x: x[0]) if sum(w for _, w in same) >= least]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                for id_, need, weight, found in zip(*[part.column(c).to_pylist() for c in ("id", "least", "weight", "found")], strict=True):
                    if id_ != now:
                        out += often() if held else []
                        now, least, held = id_, need, []
                    held.append((weight, found))
            yield pack(out)
        if held:
            yield pack(often())

    rows = lists.select("id", "least", "weight", "found").repartition("id").sortWithinPartitions("id").mapInArrow(run, "a long, b long")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def of_several(lists: DataFrame) -> DataFrame:
    """Rows of the lists that have members of different components."""
    mixed_ = durable(lists.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p < q").select("token"))
    return lists.join(mixed_, "token", "left_semi")


def in_whole_lists(warm: DataFrame, occurrences: int) -> DataFrame:
    """Rows of lists in which documents with many tokens (`many`) meet each other and the rest, but not the rest itself.

    Of each token with such documents there are two lists: one has their blocks, and all members look there for smaller
    ones; the other has the blocks of the rest, and only such documents look there.
    """
    whole = warm.join(few(durable(warm.filter("many").select("token").distinct())), "token", "left_semi")
    many, other = F.col("many"), F.xxhash64("token", F.lit("rest"))
    lists = F.array(F.struct(F.col("token"), many.alias("posts"), F.lit(True).alias("asks")), F.struct(other.alias("token"), (~many).alias("posts"), many.alias("asks")))
    rows = whole.withColumn("least", F.when(many, occurrences).otherwise(1)).withColumn("list", F.explode(lists))
    return rows.select("list.token", "id", "n", "pos", "component", "met", "weight", "least", "list.posts", "list.asks").filter("posts or asks")


def linked(entries: DataFrame, sets_of, num: int, den: int, occurrences: int = 1, thin: bool = False, bound=lambda pairs: pairs, signs: DataFrame | None = None) -> DataFrame:
    """(id, component) of ids linked by sets with Jaccard >= num / den, found by inverted lists.

    entries: token, id, n (size of the set), pos (place of the token in the set's order, from 0; 0 throughout if there is
    no order); any two sets that are similar enough share `occurrences` tokens of them. Repeated entries count once.
    sets_of(ids): the sets of some ids. First every member of a list is compared with the list's smallest id and with its
    smallest set, which joins up groups of near copies by twice as many comparisons as they have members. What is left to
    compare are members of one list in different components; no link between components is lost.

    There each document looks for smaller ones (ids decide on ties), so only members whose tokens before this one leave
    room for a link with a larger set stand in a list's blocks. Lists of over HOT members are divided first: of two
    linked sets either a token of a shorter list is shared, which then suffices, or two tokens of such lists, which make
    a list of their own (without an order: the token and one of the smallest elements, of which linked sets share one).
    With an order, a document with over TOKENS tokens of long lists has none of two: near copies share them all, so these
    would be as long and far more. It meets all members of the lists themselves, in which the rest don't meet each other.

    thin: leave out members that have too few elements in common with all the others, for entries without an order, whose
    lists also join sets that are far from similar. bound: takes pairs (a, b) and leaves out some that can't be linked,
    before their sets are fetched. signs: id, signs (WORDS words of parities of a set); members of lists that were divided, or
    were too long, meet there only if their parities allow a link.
    """
    lists = entries.groupBy("token").agg(F.max("id").alias("last"), F.min(F.struct("id", "n")).alias("first"), F.min(F.struct("n", "id")).alias("small")).filter("first.id < last").drop("last")
    lists = durable(lists)  # so that the join has plain exchanges on both sides and Spark can split large partitions
    held = durable(entries.join(lists, "token").distinct())
    discard(lists)
    alike = lambda m, n: den * F.least(m, n) >= num * F.greatest(m, n)
    stars = held.select("id", "n", F.explode(F.array(F.col("first"), F.struct("small.id", "small.n"))).alias("hub"))
    stars = stars.filter(F.col("id") != F.col("hub.id")).filter(alike(F.col("n"), F.col("hub.n"))).select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b")).distinct()
    stars = durable(bound(stars))
    ids = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    sets = durable(sets_of(few(ids)))
    groups = components(verified(stars, sets, num, den))
    discard(sets)

    told = held.select("token", "id", "n", "pos").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = durable(of_several(told))
    discard(held)
    sets = durable(sets_of(few(told.select("id").distinct()))) if thin else None
    if thin:
        met = durable(able(sets, num, den))
        told = told.join(few(met), "id")
    else:
        told = told.withColumn("met", F.col("n"))
    told = told.withColumn("weight", F.lit(1)).withColumn("least", F.lit(occurrences))
    hot = durable(told.groupBy("token").agg(F.count("*").alias("members")).filter(F.col("members") > HOT))
    if not hot.isEmpty():
        warm = durable(told.join(few(hot.select("token")), "token"))
        cool = told.join(few(hot.select("token")), "token", "left_anti")
        if thin:
            again = exploded(sets.join(few(warm.select("id").distinct()), "id", "left_semi"), (num, den)).select("id", F.col("element").alias("other"), F.lit(0).alias("place"))
            pairs_of = warm.join(again, "id")
        else:
            many = durable(warm.groupBy("id").agg(F.count("*").alias("tokens")).filter(F.col("tokens") > TOKENS).select("id", F.lit(True).alias("many")))
            single, warm = warm, durable(warm.join(few(many), "id", "left").withColumn("many", F.coalesce("many", F.lit(False))))
            discard(single, many)
            again = warm.filter("not many").select("id", F.col("token").alias("other"), F.col("pos").alias("place"))
            pairs_of = warm.filter("not many").join(again, "id").filter("place > pos")
        divided = pairs_of.select(F.xxhash64("token", "other").alias("token"), "id", "n", F.col("place").alias("pos"), "component", "met", F.lit(occurrences).alias("weight"), F.lit(1).alias("least")).distinct()
        # A document with tokens of such lists may share one of them with what it meets only once elsewhere.
        # One that meets all members of its lists still meets it in as many as any.
        once = warm.filter(F.lit(True) if thin else ~F.col("many")).select("id", F.lit(True).alias("some")).distinct()
        cool = cool.join(few(once), "id", "left").withColumn("least", F.when(F.col("some"), 1).otherwise(F.col("least"))).drop("some")
        divided = of_several(divided)
        divided = durable(divided if thin else divided.unionByName(in_whole_lists(warm, occurrences), allowMissingColumns=True))
        if signs is not None:
            of_warm = durable(signs.join(few(divided.select("id").distinct()), "id", "left_semi").distinct())
            told = durable(cool.unionByName(divided.join(few(of_warm, MOST_IDS // 10), "id"), allowMissingColumns=True))
            discard(of_warm)
        else:
            told = durable(cool.unionByName(divided))
        discard(warm, divided)
    if "posts" not in told.columns:
        told = told.withColumns({"posts": F.lit(None).cast("boolean"), "asks": F.lit(None).cast("boolean")})
    posts, asks = F.coalesce("posts", F.lit(True)), F.coalesce("asks", F.lit(True))
    if not hot.isEmpty():
        hot = durable(told.filter(posts).groupBy("token").agg(F.count("*").alias("members")).filter(F.col("members") > HOT))
    spare = occurrences - 1  # of the shared tokens, those before the last one that is looked at
    parts = told.filter(posts).join(few(hot), "token", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("members", F.lit(1)) / HOT)))
    signed = "signs" in told.columns
    member = F.struct("id", "n", "pos", "met", "component", *["signs"] * signed)
    postings = parts.filter((num + den) * (F.least(F.col("n") - F.col("pos"), F.col("met")) + spare) >= 2 * num * F.col("n"))
    postings = postings.groupBy("token", "part").agg(F.array_sort(F.collect_list(member)).alias("block")).drop("part")

    def partner(x: Column) -> Column:
        room = F.least(x["n"] - x["pos"], F.col("n") - F.col("pos"), x["met"], F.col("met")) + spare
        smaller = (x["n"] < F.col("n")) | ((x["n"] == F.col("n")) & (x["id"] < F.col("id")))
        near = smaller & (x["component"] != F.col("component")) & (den * x["n"] >= num * F.col("n")) & ((num + den) * room >= num * (x["n"] + F.col("n")))
        if not signed:
            return near
        apart = sum((F.bit_count(x["signs"][i].bitwiseXOR(F.col("signs")[i])) for i in range(WORDS)), F.lit(0))
        return near & F.coalesce((num + den) * apart <= (den - num) * (x["n"] + F.col("n")), F.lit(True))

    met_there = told.filter(asks).join(postings, "token").withColumn("found", F.transform(F.filter("block", partner), lambda x: x["id"])).filter(F.size("found") > 0)
    if occurrences > 1:
        rest = merged(met_there)
    else:
        rest = met_there.select("id", F.explode("found").alias("o")).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))
    rest = rest.distinct().join(stars, ["a", "b"], "left_anti")
    if not thin:
        rest = durable(bound(rest))
        sets = durable(sets_of(few(rest.select(F.col("a").alias("id")).unionByName(rest.select(F.col("b").alias("id"))).distinct())))
    more = durable(verified(rest, sets, num, den))
    discard(sets, told, stars, rest, hot)
    if more.isEmpty():
        return groups
    # Components met by the later links: their ids join like single ids.
    return components(groups.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
