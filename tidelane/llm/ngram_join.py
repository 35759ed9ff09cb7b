"""N-gram Jaccard join as a T-occurrence search in the manner of DivideSkip.

Documents are sets of word shingles, and each shingle has an inverted list of documents. A document of n shingles links
only with documents that occur in T = ceil(num / den * n) of its lists at least. Its L = T - OCCURRENCES longest lists
are set aside; of the others, the short ones, blocks are merged by a heap, and what occurs in OCCURRENCES of them is a
candidate. Candidates are then looked up in the long lists by bisection. The long lists are never built by token, since
one may hold a third of all documents: they are kept by document, as the ascending array of its shingles, so a probe
bisects there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import durable, pieces, small_batches, text_key, unused
from tidelane.llm.linking import WORDS, components, few, linked, shingle_sets

#: Cells of the table of list lengths. It has this size whatever the input.
CELLS = 1 << 18
#: Fewest bits of the parities of a set; there are as many as it has elements, rounded up to a power of two.
SIGNS = 512
#: Partial tables that one task adds up.
FAN = 64
#: Short lists that a candidate must be in.
OCCURRENCES = 2


def lowered(texts: list[str | None]) -> list[bytes]:
    """Texts in UTF-8 with A-Z in lower case."""
    return [(t or "").encode("utf-8", "replace").lower() for t in texts]


def list_lengths(docs: DataFrame, size: int) -> np.ndarray:
    """Upper bounds of the lengths of all inverted lists: documents counted by cells that shingles are hashed to.

    Every document counts. The tables of the tasks are added up in a tree of groups of FAN tables.
    """

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(lowered(part.column("text").to_pylist()), size)
                total += np.bincount((np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "cells": pa.array([packed], pa.binary())})

    def add(key, frame):
        import pandas as pd

        total = sum(np.frombuffer(zstandard.decompress(c), dtype=np.int64) for c in frame["cells"])
        return pd.DataFrame({"part": [key[0]], "cells": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    tables = docs.select("text").mapInArrow(count, "part long, cells binary")
    left = docs.rdd.getNumPartitions()
    while left > FAN:
        tables = tables.withColumn("part", (F.col("part") / FAN).cast("long")).groupBy("part").applyInPandas(add, "part long, cells binary")
        left = -(-left // FAN)
    return sum((np.frombuffer(zstandard.decompress(r.cells), dtype=np.int64) for r in tables.collect()), np.zeros(CELLS, dtype=np.int64))


def ordered(elements: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set from its shortest lists to its longest, list lengths taken by powers of two; then by hash."""
    return elements[np.argsort(rank[(elements >> np.uint64(46)).astype(np.int64)], kind="stable")]


def lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([*arrays, np.empty(0, np.int64)]))


def digests(docs: DataFrame, size: int, num: int, den: int, rank) -> DataFrame:
    """doc_id, n, h1, h2 (hash of the set), prefix (tokens of the short lists), signs (parities of it) for each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(lowered(part.column("text").to_pylist()), size)
                whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                halves = np.frombuffer(b"".join(whole), dtype=np.int64).reshape(-1, 2)
                short = [ordered(s, rank.value)[: len(s) - -(-num * len(s) // den) + OCCURRENCES].astype(np.int64) if len(s) else s.astype(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [lists([parities(s) for s in sets]), part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists(short)],
                    ["signs", "doc_id", "n", "h1", "h2", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "signs array<long>, doc_id long, n int, h1 long, h2 long, prefix array<long>")


def parities(elements: np.ndarray) -> np.ndarray:
    """Bits that tell whether the number of elements hashed to a place is odd, packed; a 64th of the set's own size.

    Two sets' bits differ in at most as many places as the sets differ in elements.
    """
    bits = max(SIGNS, 1 << (len(elements) - 1).bit_length() if len(elements) else 0)
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def folded(signs):
    """Parities as WORDS words: places that far apart are one. What two sets' bits differ in doesn't grow by that."""
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.aggregate(F.filter(signs, lambda _, j: j % WORDS == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))


def parity_bound(told: DataFrame, num: int, den: int):
    """A function that leaves out pairs whose parities differ in more places than linked sets have different elements.

    The longer parities of a pair are folded in half, place by place, to the length of the shorter.
    """
    signs = told.select(F.col("doc_id").alias("id"), "n", "signs")

    def halved(a, b):
        half = F.size(a) / 2
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, half.cast("int")), F.slice(a, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(a)

    def bound(pairs: DataFrame) -> DataFrame:
        both = pairs
        for side in "ab":
            both = both.join(signs.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("signs").alias(f"{side}_signs")), side)
        a, b = F.col("a_signs"), F.col("b_signs")
        apart = F.aggregate(F.zip_with(halved(a, b), halved(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        alike = den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n")
        return both.filter(alike & ((num + den) * apart <= (den - num) * (F.col("a_n") + F.col("b_n")))).select("a", "b").distinct()

    return bound


def sets_of(docs: DataFrame, size: int, repeated: bool):
    """A function from ids to (id, elements): every text of these ids, each once (repeated: an id has several rows)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(lowered(part.column("text").to_pylist()), size)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "elements"])

    def of(ids: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
        return (rows.distinct() if repeated else rows).mapInArrow(run, "id long, elements binary")

    return of


def ngram_join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`: classes of documents linked by Jaccard >= num / den.

    Texts with equal sets are one class from the start, told by a 128-bit hash, and only its smallest id is searched for.
    Null and empty texts have no shingles, link with nothing and are their own component. Rows of one doc_id count as
    one document, linked if any of their texts is. A row with a null doc_id gets the component of the documents with an
    equal set, or null. Columns of `docs` other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    lengths = list_lengths(docs, size)
    usual = max(1.0, lengths.mean())
    rank = docs.sparkSession.sparkContext.broadcast(np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1) / usual))).astype(np.int8))
    told = durable(digests(docs, size, num, den, rank))
    classes = durable(told.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.count("*").alias("rows")))
    heads = classes.filter("id is not null").select("id", "h1", "h2")
    mine = told.withColumnRenamed("doc_id", "id").join(heads, ["id", "h1", "h2"], "left_semi")
    entries = mine.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    repeated = not told.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    found = linked(entries, sets_of(docs, size, repeated), num, den, OCCURRENCES, bound=parity_bound(told.filter("n > 0"), num, den), signs=told.filter("n > 0").select(F.col("doc_id").alias("id"), folded(F.col("signs")).alias("signs")))

    # Ids of one class, and texts of one id, belong together: a row's component is the smallest of its class's.
    several = told.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("h1", "h2").alias("texts")).filter("texts > 1").select("doc_id")
    if not several.isEmpty():
        again = told.filter("n > 0").join(several, "doc_id", "left_semi").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
        found = components_with(found, again)
    place = classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    shared = place.join(classes.filter("rows > 1 or id is null"), ["h1", "h2"], "left_semi")
    alone = told.join(few(shared), ["h1", "h2"], "left").join(found.select(F.col("id").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left")
    return alone.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "own", "doc_id")).alias("component_id"))


def components_with(found: DataFrame, more: DataFrame) -> DataFrame:
    return components(found.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, and of its rows the one of the smallest text key.

    Of rows that are equal in id and text one stays, whatever their other columns hold. Rows without an id stay unless a
    document with an id has an equal set; rows with empty or null texts stay, but one for each id. All columns are kept,
    whatever their names; an empty table gives an empty result.
    """
    joined = ngram_join(docs, size, num, den)
    gone = durable(joined.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct())
    key, number, id_ = unused(docs, "key_of_text"), unused(docs, "number_of_row"), unused(docs, "id_gone")
    kept = docs.join(few(gone.withColumnRenamed("id", id_)), F.col("doc_id") == F.col(id_), "left_anti")
    lone = docs.filter("doc_id is null").select(text_key().alias(key))
    if not lone.isEmpty():
        kept = kept.join(few(unnamed_copies(docs, key, size)), F.col("doc_id").isNull() & (text_key() == F.col(key)), "left_anti")
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_))
    if again.isEmpty():
        return kept
    again = few(durable(again))
    first = Window.partitionBy("doc_id").orderBy(text_key())
    once = kept.join(again, F.col("doc_id") == F.col(id_), "left_semi").withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).drop(number)
    return kept.join(again, F.col("doc_id") == F.col(id_), "left_anti").unionByName(once)


def unnamed_copies(docs: DataFrame, key: str, size: int) -> DataFrame:
    """Text keys of the rows without an id whose set equals that of a document with an id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(lowered(part.column("text").to_pylist()), size)]
                yield pa.RecordBatch.from_arrays([part.column("named"), part.column("key"), pa.array(whole, pa.binary())], ["named", "key", "set"])

    sets = docs.select(F.col("doc_id").isNotNull().alias("named"), text_key().alias("key"), "text").mapInArrow(run, "named boolean, key long, set binary")
    both = sets.filter("set is not null").groupBy("set").agg(F.bool_or("named").alias("named"), F.collect_set(F.when(~F.col("named"), F.col("key"))).alias("keys"))
    return durable(both.filter("named and size(keys) > 0").select(F.explode("keys").alias(key)).distinct())
