"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each `w` consecutive k-gram hashes the smallest is kept, in documents and in benchmark items alike, so that any span
of k + w - 1 common words holds a fingerprint that both sides keep. Fingerprints are joined; each hit is extended over
the words on both sides of it, and counts if the common span is long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import text_key, unused

#: Words of a window, and of the k-grams that are hashed; a window holds WINDOW - GRAM + 1 of those.
WINDOW, GRAM = 10, 5
#: Fingerprints of the benchmark that may be broadcast (about 100 bytes each in memory); more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Low bits of a packed fingerprint that hold the place; the rest are hash. No string has more words than these count.
PLACE = (1 << 30) - 1
#: Upper case becomes lower, and what is no part of a word becomes a blank.
LETTERS = {chr(c): chr(c + 32) for c in range(0x41, 0x5B)}
OTHERS = [chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))]


def words_of(text: Column) -> Column:
    """Words of a text in lower case; none for null. Two native passes, without a regular expression."""
    plain = F.translate(text, "".join([*LETTERS, *OTHERS]), "".join([*LETTERS.values(), *(" " for _ in OTHERS)]))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty unless n > 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, size: int, w: int, margin: int) -> Column:
    """Array of (hash, pos, near): the kept k-grams of `size` words, each with the `margin` words before and after it.

    Hash and place are packed in one number, so the least number of a window is its least hash, the first one on ties.
    Texts of fewer than `w` k-grams have no window and so none.
    """

    def packed(ws: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
        return F.transform(upto(F.size(ws) - (size - 1)), lambda i: gram(i).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))

    def least(hs: Column) -> Column:
        if w == 1:
            return hs
        return F.array_distinct(F.transform(upto(F.size(hs) - (w - 1)), lambda j: F.least(*[F.get(hs, j + i) for i in range(w)])))

    def with_words(ws: Column, kept: Column) -> Column:
        def one(x: Column) -> Column:
            p = x.bitwiseAND(F.lit(PLACE)).cast("int")
            near = F.array(*[F.get(ws, p + i) for i in range(-margin, size + margin)])  # null outside of the text
            return F.struct(x.bitwiseAND(F.lit(~PLACE)).alias("hash"), p.alias("pos"), near.alias("near"))

        return F.transform(kept, one)

    return let(words, lambda ws: with_words(ws, let(packed(ws), least)))


def common(a: Column, b: Column, places: range) -> Column:
    """How many words at these places are the same in both arrays, up to the first that isn't."""
    out = F.lit(len(places))
    for n, i in reversed(list(enumerate(places))):
        out = F.when(F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)), out).otherwise(n)
    return out


def hits(docs: DataFrame, items: DataFrame, size: int, w: int) -> DataFrame:
    """key columns, item_id, first, last: word ranges of documents that are windows of items with k-grams of `size`."""
    margin, need = w - 1, size + w - 1
    sides = []
    for side, ids in ((docs, ["doc_id", "key"]), (items, ["item_id"])):
        prints = side.select(*ids, F.explode(fingerprints(F.col("words"), size, w, margin)).alias("f"))
        sides.append(prints.select(*ids, *[F.col(f"f.{c}").alias(f"{ids[0][0]}_{c}") for c in ("hash", "pos", "near")]))
    ours, theirs = sides
    if theirs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        theirs = F.broadcast(theirs)
    met = ours.join(theirs, F.col("d_hash") == F.col("i_hash"))
    before = common(F.col("d_near"), F.col("i_near"), range(margin - 1, -1, -1))
    after = common(F.col("d_near"), F.col("i_near"), range(margin, size + 2 * margin))
    met = met.select("doc_id", "key", "item_id", "d_pos", before.alias("before"), after.alias("after"))
    met = met.filter((F.col("after") >= size) & (F.col("before") + F.col("after") >= need))
    return met.select("doc_id", "key", "item_id", (F.col("d_pos") - F.col("before")).alias("first"), (F.col("d_pos") + F.col("after") - 1).alias("last"))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`.

    A window is WINDOW consecutive words of an item, or all words of a shorter one; document words inside an occurrence
    of a window are hit. Null and empty texts have no words, items without words or with a null id no window. Repeated
    rows and null ids give a row each; item rows of one id count as one item with the windows of all. Columns other
    than doc_id, item_id and text are ignored. Without items nothing is hit.
    """
    rows = docs.select("doc_id", text_key().alias("key"), words_of(F.col("text")).alias("words"))
    found = found_windows(docs, benchmark)
    base = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if found is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    # Overlapping ranges meet as words. A document has as many ranges as items that share a window with it there.
    per = found.groupBy("doc_id", "key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    per = per.select(F.col("doc_id").alias("h_doc"), F.col("key").alias("h_key"), "n_hit", "items")
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("key") == F.col("h_key")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.concat_ws(",", "items"), 256), none).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows in which a window of the benchmark occurs; all columns stay, whatever their names.

    Null and empty texts are never contaminated; repeated rows share one fate, null ids are told apart by their texts.
    Empty tables on either side are fine.
    """
    bad = found_windows(docs, benchmark)
    if bad is None:
        return docs
    doc, key = unused(docs, "contaminated_doc"), unused(docs, "contaminated_key")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key() == F.col(key)), "left_anti")


def found_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """What `hits` finds for windows of all lengths; None for a benchmark without words."""
    rows = docs.select("doc_id", text_key().alias("key"), words_of(F.col("text")).alias("words"))
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).distinct()
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).filter("n > 0").distinct().collect()]  # ten at most
    found = None
    for n in sorted(lengths):
        these = items.filter(F.size("words") >= n if n == WINDOW else F.size("words") == n)
        part = hits(rows, these, GRAM, WINDOW - GRAM + 1) if n == WINDOW else hits(rows, these, n, 1)
        found = part if found is None else found.unionByName(part)
    return found
