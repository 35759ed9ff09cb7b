"""Substring dedup by paragraphs: MinHash bands, exact Jaccard of what collides, removal by components.

A line of LEAST words or more is cut by itself, and shorter lines that follow each other are cut as one text. Cuts are
places whose rank is the least among all places less than LEAST words away: ends of sentences come before other ends of
words, then a hash of the last words decides. So cuts depend on the words around them alone, not on a count from some
start: passages fall into the same paragraphs wherever they stand, but for some words at their ends.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import discard, durable, pieces, text_key
from tidelane.llm.linking import BLANK, MOST_IDS, few, gram_hashes, linked, mixed, word_hashes

#: Fewest words of a paragraph; only where shorter lines have fewer in all between longer ones, they are one by themselves.
LEAST = 8
#: Words whose hash ranks the place after them.
CONTEXT = 3
#: Bands of ROWS MinHash values each. Two paragraphs of Jaccard s meet with probability 1 - (1 - s ** ROWS) ** BANDS,
#: which is 0.983 at 0.8 and 0.999 at 0.9.
BANDS, ROWS, SHINGLE = 4, 2, 5
#: Each letter of scripts that put no blanks between words is a word.
LETTER = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u3190-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
LETTERS = re.compile(f"([{LETTER}])")
WORD = re.compile(f"[{LETTER}]|[^{LETTER}\t-\r ]+")
SEEDS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Cut:
    """Paragraphs of some texts, which together are all their words, in arrays.

    data: words in lower case with a blank after each; starts, ends, hashes: of the words in it; first, words: each
    paragraph's first word and number of words; owner, place: its text and its number in it.
    """

    def __init__(self, texts: list[str]):
        lower = [LETTERS.sub(r" \1 ", t.lower()) if not t.isascii() and LETTERS.search(t) else t.lower() for t in texts]
        packed = [t.encode("utf-8", "replace") + b"\n" for t in lower]
        raw = np.frombuffer(b"".join(packed), dtype=np.uint8)
        blank = BLANK[raw]
        before = np.concatenate([[True], blank[:-1]])
        begins = np.flatnonzero(before & ~blank)
        line = np.cumsum(raw == 10)[begins]
        text = np.searchsorted(np.cumsum([0, *map(len, packed)]), begins, side="right") - 1
        self.data = np.where(blank, np.uint8(32), raw)[~(before & blank)]
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], self.ends + 1])[: len(self.ends)]
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.first = np.flatnonzero(self._begins(line, text))
        self.words = np.diff(np.append(self.first, len(begins)))
        self.owner = text[self.first]
        self.place = np.arange(len(self.first)) - np.searchsorted(self.owner, self.owner)

    def _begins(self, line: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether a paragraph begins with a word."""
        n = len(line)
        long = np.bincount(line, minlength=1)[line] >= LEAST
        begins = np.ones(n, dtype=bool)
        begins[1:] = (text[1:] != text[:-1]) | ((line[1:] != line[:-1]) & (long[1:] | long[:-1]))
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, n))
        start, end, at = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes), np.arange(n)
        fits = np.flatnonzero((at + 1 - start >= LEAST) & (end - at - 1 >= LEAST))
        rank = np.full(n, ~np.uint64(0))
        hashes = gram_hashes(self.hashes, np.maximum(fits - CONTEXT + 1, start[fits]), fits) >> np.uint64(1)
        rank[fits] = np.where(self._sentence_ends(fits), hashes, hashes | np.uint64(1 << 63))
        least = np.ones(len(fits), dtype=bool)
        for k in range(1, LEAST):  # all these places are in the same line or lines
            least &= (rank[fits] < rank[fits - k]) & (rank[fits] <= rank[fits + k])
        begins[fits[least] + 1] = True
        return begins

    def _sentence_ends(self, words: np.ndarray) -> np.ndarray:
        last = [self.data[np.maximum(self.ends[words] - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        wide = last[0] | last[1] << 8 | last[2] << 16
        return np.isin(last[0], list(b".!?")) | np.isin(wide, [int.from_bytes(c.encode()) for c in "\u3002\uff01\uff1f"])

    def identities(self, of: np.ndarray) -> np.ndarray:
        """64-bit hash of the words of some paragraphs; equal paragraphs are one from here on."""
        raw = self.data.tobytes()
        spans = zip(self.starts[self.first[of]].tolist(), self.ends[self.first[of] + self.words[of] - 1].tolist(), strict=True)
        return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans], dtype=np.uint64).astype(np.int64)

    def shingles(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What shingle_hashes gives for the words of some paragraphs."""
        first, after = self.first[of], self.first[of] + self.words[of]
        counts = np.maximum(1, self.words[of] - SHINGLE + 1)
        at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        last = np.minimum(at + SHINGLE, np.repeat(after, counts)) - 1
        return gram_hashes(self.hashes, at, last), counts


def paragraphs(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each paragraph of one text, in code points from its first word to the end of its last."""
    cut, words = Cut([text]), [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[a + n - 1][1], [text[x:y].lower() for x, y in words[a : a + n]]) for a, n in zip(cut.first.tolist(), cut.words.tolist(), strict=True)]


def distinct_counts(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of different values in each of the consecutive groups of `flat`, which have `counts` members each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((flat, owner))
    by, value = owner[order], flat[order]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (by[1:] != by[:-1]) | (value[1:] != value[:-1])
    return np.bincount(by[new], minlength=len(counts)).astype(np.int32)


def bands(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS rows with a token for each group of `flat`; no group is empty."""
    cuts = np.cumsum(counts) - counts
    out = np.empty((BANDS, len(counts)), dtype=np.uint64)
    if len(counts):
        for k in range(BANDS):
            key = np.full(len(counts), k + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mixed(key ^ np.minimum.reduceat(mixed(flat * SEEDS[k * ROWS + r]), cuts))
            out[k] = key
    return out.astype(np.int64)


TOKENS = [f"band_{k}" for k in range(BANDS)]
#: Of each paragraph of LEAST words or more: its id, place, number of words, size of its set, and tokens.
UNIT = {"ids": "long", "places": "int", "words": "int", "sizes": "int"} | dict.fromkeys(TOKENS, "long")


def unit_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_paragraphs, and for each column of UNIT an array with one value for each paragraph.

    This is the one time that every text is read; all tokens and sizes come from here.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                cut = Cut([t or "" for t in part.column("text").to_pylist()])
                kept = np.flatnonzero(cut.words >= LEAST)
                hashes, counts = cut.shingles(kept)
                offsets = np.searchsorted(cut.owner[kept], np.arange(part.num_rows + 1)).astype(np.int32)
                totals = np.bincount(cut.owner, minlength=part.num_rows)
                lists = [cut.identities(kept), cut.place[kept].astype(np.int32), cut.words[kept].astype(np.int32), distinct_counts(hashes, counts), *bands(hashes, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array(totals, pa.int64()), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], ["doc_id", "key", "n_paragraphs", *UNIT])

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, n_paragraphs long, " + ", ".join(f"{c} array<{t}>" for c, t in UNIT.items()))


def each_unit(units: DataFrame, *columns: str) -> DataFrame:
    """doc_id, key and some columns of UNIT with a row for each paragraph."""
    return units.select("doc_id", "key", F.explode(F.arrays_zip(*columns)).alias("u")).select("doc_id", "key", *[F.col(f"u.{c}").alias(c) for c in columns])


def band_entries(units: DataFrame) -> DataFrame:
    """token, id, n, pos of every paragraph that shares the token with another; equal paragraphs count once.

    A paragraph's tokens are different, so a token that occurs twice has two paragraphs.
    """
    once = each_unit(units, "ids", "sizes", *TOKENS).drop("doc_id", "key").dropDuplicates(["ids"])
    each = once.select(F.explode(F.array(*TOKENS)).alias("token"), F.col("ids").alias("id"), F.col("sizes").alias("n"))
    shared = durable(each.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1").select("token"))
    out = durable(each.join(few(shared), "token", "left_semi").withColumn("pos", F.lit(0)))
    discard(shared)
    return out


def unit_sets(docs: DataFrame, units: DataFrame):
    """A function from ids to (id, elements) of these paragraphs, each once.

    Each id is taken from one document, and only documents from which some id is taken are read again.
    """

    def of(ids: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in pieces(batch):
                    cut = Cut([t or "" for t in part.column("text").to_pylist()])
                    firsts = np.searchsorted(cut.owner, np.arange(part.num_rows))
                    wanted = [(w["id"], first + w["place"]) for first, ws in zip(firsts.tolist(), part.column("wanted").to_pylist(), strict=True) for w in ws]
                    hashes, counts = cut.shingles(np.array([u for _, u in wanted], dtype=np.int64))
                    until = np.cumsum(counts)
                    sets = [np.unique(hashes[end - n : end]).tobytes() for end, n in zip(until, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in wanted], pa.int64()), pa.array(sets, pa.binary())], ["id", "elements"])

        each = each_unit(units, "ids", "places").withColumnsRenamed({"ids": "id", "places": "place"}).join(ids, "id")
        taken = durable(each.groupBy("id").agg(F.min(F.struct("key", "doc_id", "place")).alias("at")).select("id", "at.*"))
        wanted = taken.groupBy(F.col("key").alias("k"), F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("id", "place")).alias("wanted"))
        # An id and a place for each of the ids: their number bounds what a broadcast holds.
        wanted = F.broadcast(wanted) if taken.limit(MOST_IDS + 1).count() <= MOST_IDS else wanted
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
        texts = texts.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "wanted")
        return texts.mapInArrow(run, "id long, elements binary").dropDuplicates(["id"])

    return of


def removals(docs: DataFrame, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The unit table, and (doc_id, key, place, words, source) of the paragraphs that go; source holds the first copy."""
    units = durable(unit_table(docs))
    entries = band_entries(units)
    groups = durable(linked(entries, unit_sets(docs, units), num, den, thin=True))
    discard(entries)
    each = each_unit(units, "ids", "places", "words").withColumnsRenamed({"ids": "id", "places": "place"})
    each = each.join(few(groups), "id", "left").withColumn("component", F.coalesce("component", "id")).drop("id")
    # A null doc_id comes after all others.
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"))
    firsts = each.groupBy("component").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first <> last").select("component", "first")
    firsts = durable(firsts)
    gone = each.join(few(firsts), "component").filter(rank > F.col("first"))
    return units, gone.select("doc_id", "key", "place", "words", F.col("first.doc_id").alias("source"))


def paragraph_dedup(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, n_words_removed, removed (places), sources (doc_ids) for each row of `docs`.

    A paragraph goes if a document with a smaller id has one of its component: equal, or linked by Jaccard >= num / den
    of 5-word shingles. Repeats inside the first document stay. Null and empty texts have no paragraphs; shorter ones
    than LEAST words are never removed. Of a repeated passage the words up to its first cut and after its last one stay;
    where a copy's lines of LEAST words or more end elsewhere, so do paragraphs next to such an end. Repeated rows give a row each and keep what their id keeps; a null id comes
    after all ids. Columns of `docs` other than doc_id and text are ignored.
    """
    units, gone = removals(docs, num, den)
    per = gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "words")).alias("p"), F.array_sort(F.collect_set("source")).alias("sources"))
    per = per.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("w"), F.array_sort(F.transform("p", lambda x: x["place"])).alias("gone"), "sources")
    out = units.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    text = lambda c: F.coalesce(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))), F.lit(""))
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("w", F.lit(0)).cast("long").alias("n_words_removed"), text("gone").alias("removed"), text("sources").alias("sources"))
