"""Two tokenizers over the same texts: where their tokens end together, and how often two ids do so in the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.bpe import engine
from tidelane.llm.common import durable, pieces, small_batches

#: Bytes beyond which a text is given to the second tokenizer in parts, and parts that the rows of one pair are dealt to.
PART, SALTS = 1 << 16, 16
#: Links of a task that are counted at once.
COUNTED = 1 << 20


class Side:
    """Ids of a text with their bytes; `bytes_of[i]` are those of id i."""

    bytes_of: list[bytes]

    def prepare(self) -> None:
        self.lengths = np.asarray([len(b) for b in self.bytes_of], dtype=np.int64)

    def __call__(self, text: str) -> list[int]:
        raise NotImplementedError

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoding = engine(path)
        self.bytes_of = []
        for i in range(self.encoding.n_vocab):
            try:
                self.bytes_of.append(self.encoding.decode_single_token_bytes(i))
            except KeyError:  # a number without a token
                self.bytes_of.append(b"")
        self.prepare()

    def __call__(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)

    def joined(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


class Pieces(Side):
    """A sentencepiece model, which puts a space before a text itself.

    A long text is encoded in parts that begin with a space after another character. That changes nothing where no piece
    has a space after another character, as then no merge reaches over such a place; else texts stay whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(names)]
        self.divides = not any(self.MARK in p.lstrip(self.MARK) for p in names)
        self.prepare()

    def __call__(self, text: str) -> list[int]:
        if len(text) <= PART or not self.divides:
            return self.model.encode(text)
        ids, start = [], 0
        while len(text) - start > PART:
            at = self.place(text, start)
            if at is None:
                break
            ids += self.model.encode(text[start:at])
            start = at + 1  # the encoder puts that space back
        return ids + self.model.encode(text[start:])

    @staticmethod
    def place(text: str, start: int) -> int | None:
        """A space after another character, as near to PART characters on as can be, with something after it."""
        at = start + PART
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                return None
            if text[at - 1] != " " and text[at - 1] != Pieces.MARK:
                return at
            at += 1


class Aligner:
    """Groups and links of texts. `base` is the number of second ids: a pair is first * base + second."""

    def __init__(self, first: Side, second: Side):
        self.first, self.second, self.base = first, second, len(second.bytes_of)
        a, b = [str(i) for i in range(len(first.bytes_of))], [str(i) for i in range(self.base)]
        # what is written for a token: its number and what follows it, for one inside and one at the end of a group
        self.written = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]

    def __call__(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens of the first, of the second, groups, hash of the groups, pairs of the links in order)."""
        nothing = 0, 0, 0, "", np.empty(0, np.int64)
        if not text:
            return nothing
        data = b" " + text.encode()
        a, b = self.first(text), self.second(text)
        if self.first.joined(a) != data or self.second.joined(b) != data:
            return nothing
        a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.first.lengths[a]), np.cumsum(self.second.lengths[b])
        rising = bool(self.first.lengths[a].all() and self.second.lengths[b].all())
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=rising)
        return len(a), len(b), len(cuts), self.group_hash(a, b, ends_a, ends_b, cuts), self.links(a, b, ends_a, ends_b, cuts)

    def group_hash(self, a, b, ends_a, ends_b, cuts) -> str:
        """SHA-256 of `a1,a2|b1;a3|b2,b3`."""
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        before_a, before_b = np.searchsorted(group_a, group_b, "right"), np.searchsorted(group_b, group_a, "left")
        out = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n = len(self.first.bytes_of)
        out[np.arange(len(a)) + before_b] = a + n * last_a
        out[np.arange(len(b)) + before_a] = 2 * n + b + self.base * last_b
        return hashlib.sha256("".join(map(self.written.__getitem__, out.tolist()))[:-1].encode()).hexdigest()

    def links(self, a, b, ends_a, ends_b, cuts) -> np.ndarray:
        """Pairs of the tokens that end at one cut. Tokens without bytes would end where the one before them does."""
        from_a, from_b = np.searchsorted(ends_a, cuts, "left"), np.searchsorted(ends_b, cuts, "left")
        many_a, many_b = np.searchsorted(ends_a, cuts, "right") - from_a, np.searchsorted(ends_b, cuts, "right") - from_b
        each = many_a * many_b
        which = np.repeat(np.arange(len(cuts)), each)
        place = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        return a[from_a[which] + place // many_b[which]] * self.base + b[from_b[which] + place % many_b[which]]

    def possible(self) -> int:
        """Most pairs that can ever be linked: of two tokens that end together, one's bytes end the other's."""
        suffixes = [[sum(data[i:] in table for i in range(len(data))) for data in side] for side, table in ((self.first.bytes_of, self.count(self.second)), (self.second.bytes_of, self.count(self.first)))]
        return sum(map(sum, suffixes)) + sum(not b for b in self.first.bytes_of) * self.base + sum(not b for b in self.second.bytes_of) * len(self.first.bytes_of)

    @staticmethod
    def count(side: Side) -> set[bytes]:
        return set(side.bytes_of) - {b""}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One for each worker process."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(ByteLevel(first), Pieces(second))
    return _ALIGNERS[first, second]


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and pairs: array<long> with the link's two ids as one number, in order."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                made = [aligner(first, second)(t) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *[len(m[4]) for m in made]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    **{name: pa.array([m[i] for m in made], pa.int64()) for i, name in enumerate(("n_a", "n_b", "n_groups"))},
                    "groups_sha256": pa.array([m[3] for m in made], pa.string()),
                    "pairs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), np.concatenate([np.empty(0, np.int64), *[m[4] for m in made]])),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>")


def counted(batches):
    """(pair, n) of a task, each pair once: its state is bounded by the pairs that the vocabularies allow."""
    import pyarrow as pa

    held, keys, counts, waiting = [], np.empty(0, np.int64), np.empty(0, np.int64), 0

    def settle():
        every, number = np.unique(np.concatenate(held), return_counts=True)
        both, place = np.unique(np.concatenate([keys, every]), return_inverse=True)
        return both, np.bincount(place, np.concatenate([counts, number]), len(both)).astype(np.int64)

    for batch in batches:
        values = batch.column("pairs").flatten().to_numpy()
        held.append(values)
        waiting += len(values)
        if waiting > COUNTED:
            keys, counts = settle()
            held, waiting = [], 0
    if held:
        keys, counts = settle()
    for a in range(0, len(keys), 10_000):
        yield pa.RecordBatch.from_pydict({"pair": pa.array(keys[a : a + 10_000]), "n": pa.array(counts[a : a + 10_000])})


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n: how many links of all documents hold a pair; summed in each task, then in salted parts, then as a whole."""
    parts = links.select("pairs").mapInArrow(counted, "pair long, n long").withColumn("salt", F.spark_partition_id() % SALTS)
    return parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def link_ids(pair: Column, base: int) -> tuple[Column, Column]:
    """The two ids of a pair."""
    return F.floor(pair / base).cast("int"), F.pmod(pair, F.lit(base)).cast("int")


def token_pairs(docs: DataFrame, first: str, second: str) -> DataFrame:
    """a, b, n: pairs of ids that end together anywhere, with how often. Awkward rows as in `alignment`."""
    a, b = link_ids(F.col("pair"), aligner(first, second).base)
    return pair_counts(aligned(docs, first, second)).select(a.alias("a"), b.alias("b"), "n")


def alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of `docs`.

    first: a byte-level BPE file, second: a sentencepiece model, both on every machine. Texts are encoded once; their links
    are written out, counted, and read again with the counts. There are as many counts as pairs of tokens of which one ends
    the other, at most, whatever the corpus; that bound is checked before they are broadcast.

    Null and empty texts, and those that a tokenizer changes, have no tokens: zeros and an empty hash. Repeated rows and
    null ids give a row each and count each time; a very long text is encoded in parts; an empty table gives an empty result.
    doc_id must be a whole number. Columns of `docs` other than doc_id and text are ignored.
    """
    import pyarrow as pa

    spark, known = docs.sparkSession, aligner(first, second)
    base = known.base
    links = durable(aligned(docs, first, second))
    bound = known.possible()
    got = pair_counts(links).limit(bound + 1).toArrow()
    if got.num_rows > bound:
        raise ValueError(f"more than {bound} pairs")
    order = np.argsort(got.column("pair").to_numpy())
    pairs, counts = got.column("pair").to_numpy()[order], got.column("n").to_numpy()[order]
    best = np.zeros(base, np.int64)
    np.maximum.at(best, pairs % base, counts)
    shared = spark.sparkContext.broadcast((pairs, counts, best))

    def run(batches):
        pairs, counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            values = lists.flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            each = counts[np.searchsorted(pairs, values)] if len(values) else np.empty(0, np.int64)
            ends = np.cumsum(sizes)
            total = lambda x: (t := np.concatenate([[0], np.cumsum(x)]))[ends] - t[ends - sizes]
            more = {"n_links": sizes.astype(np.int64), "n_best": total(each == best[values % base]), "count_sum": total(each)}
            yield pa.RecordBatch.from_pydict({n: pa.array(more[n], pa.int64()) if n in more else batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    return links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
