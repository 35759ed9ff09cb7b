"""Byte-level BPE by content-defined chunks: chunks that documents share are encoded once, joins are re-encoded."""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidelane.llm.common import rows_to_arrow

#: Fixed value: how this kind of tokenizer divides a text before merging, as its public description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that the rolling hash sees, the bits that must be 0 at a boundary, and the bytes that a worker keeps chunks in.
WINDOW, MASK, KEPT = 16, (1 << 10) - 1, 32_000_000
#: Bytes that are hashed together.
STRIDE = 1 << 18
#: Two characters between which pre-tokens meet in any text: a change from a visible one to a blank, or between letters,
#: numbers and punctuation; after an apostrophe a letter may belong to it.
SURE = regex.compile(r"[\p{L}\p{N}\p{P}][ \t\r\n]|\p{L}[\p{N}\p{P}]|\p{N}[\p{L}\p{P}]|(?!')\p{P}[\p{L}\p{N}]")


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def engine(path: str):
    """An encoder with the vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE" or model["ignore_merges"]:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab, names = model["vocab"], byte_names()
    for rank, pair in enumerate(model["merges"]):  # merges by rank must be merges by id
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        if vocab[a + b] != 256 + rank:
            raise ValueError(f"{path}: ids don't follow the merges")
    ranks = {bytes(names[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def boundaries(data: bytes) -> np.ndarray:
    """Ends of content-defined chunks: where the hash of the last WINDOW bytes has its masked bits at 0."""
    starts = [max(0, at - WINDOW + 1) for at in range(0, len(data), STRIDE)]  # each part sees the windows that end in it
    return np.concatenate([np.empty(0, np.int64), *(part_boundaries(data[a : a + STRIDE + WINDOW - 1 if a else STRIDE]) + a for a in starts)])


def part_boundaries(data: bytes) -> np.ndarray:
    if len(data) < WINDOW:
        return np.empty(0, dtype=np.int64)
    h, step = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) + np.uint32(1), 1
    factor = 0x9E3779B1
    while step < WINDOW:  # hashes of 2, 4, ... bytes from those of half as many
        h = h[step:] + h[:-step] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h & np.uint32(MASK)) == 0) + WINDOW


class Piece:
    """Bytes with their ids: ends of the tokens in bytes, and the ids as text, each with a comma after it; 4 bytes a number."""

    __slots__ = ("data", "ids", "ends", "text", "marks")

    def __init__(self, data: bytes, ids: list[int], lengths: list[int], names: list[str]):
        self.data, self.ids = data, array("i", ids)
        self.ends = array("i", accumulate(map(lengths.__getitem__, ids)))
        numbers = list(map(names.__getitem__, ids))
        self.text, self.marks = "".join(numbers), array("i", accumulate(map(len, numbers), initial=0))


class Coder:
    """Encodes and decodes whole texts, with what it has made of earlier chunks at hand.

    Chunks are encoded by themselves and put together at joins, where ids may differ from those of the whole text. So the
    last tokens of one chunk and the first of the next are encoded again as one. The result stands where it agrees with
    both sides: it must begin with ids of the first chunk and end with ids of the second, each up to a sure place. Until
    it does, more tokens of both sides are taken in. A sure place is one at which pre-tokens meet whatever stands around
    it, so that what is left of it and what is right of it don't depend on each other.
    """

    #: Tokens of either side that are encoded again at first.
    AROUND = 6

    def __init__(self, path: str):
        self.encoding = engine(path)
        self.lengths, self.names = self.token_lengths(), [f"{i}," for i in range(self.encoding.n_vocab)]
        self.special = [t.encode() for t in self.encoding.special_tokens_set]
        self.young, self.old, self.size = {}, {}, 0

    def token_lengths(self) -> list[int]:
        out = []
        for i in range(self.encoding.n_vocab):
            try:
                out.append(len(self.encoding.decode_single_token_bytes(i)))
            except KeyError:  # a number without a token
                out.append(0)
        return out

    def piece(self, data: bytes) -> Piece:
        ids = self.encoding.encode(data.decode("utf-8"), allowed_special="all")
        if self.encoding.decode_bytes(ids) != data:
            raise ValueError("ids don't decode to their text")
        return Piece(data, ids, self.lengths, self.names)

    def chunk(self, data: bytes) -> Piece:
        """Kept in two generations: chunks that nobody asks for during a whole one are forgotten."""
        made = self.young.get(data)
        if made is None:
            made = self.old.get(data) or self.piece(data)
            self.size += len(data) + len(made.text) + 12 * len(made.ids) + 700
            if self.size > KEPT // 2:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[data] = made
        return made

    def sure(self, data: bytes, at: int, marked: bool) -> bool:
        """Whether pre-tokens meet at a place in any text; marked: special tokens, which may span places, occur."""
        if 33 <= data[at - 1] <= 126 and data[at] == 32:
            return True
        if marked or data[at] & 0xC0 == 0x80:  # the latter is inside of a letter
            return False
        before, after = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:], data[at : at + 4].decode("utf-8", "ignore")[:1]
        return bool(SURE.fullmatch(before + after))

    def joined(self, left: Piece, begun: int, right: Piece, last: bool) -> tuple[Piece, int, Piece, int, int, Piece | None, int]:
        """(left, upto, middle, first, after, right, skip): ids of left before `upto`, of middle from `first` to before
        `after`, then those of right after its first `skip`; no right if the middle goes on to its end. The left piece
        counts from its first `begun` ids on, which end at a sure place."""
        whole = left.data + right.data
        cut, around = len(left.data), self.AROUND
        marked = any(t in whole for t in self.special)
        while True:
            i, j = max(begun, len(left.ids) - around), min(len(right.ids), around)
            while i > begun and whole[left.ends[i - 1]] & 0xC0 == 0x80:  # inside of a letter
                i -= 1
            while j < len(right.ids) and right.data[right.ends[j - 1]] & 0xC0 == 0x80:
                j += 1
            start = left.ends[i - 1] if i else 0
            end = cut + (right.ends[j - 1] if j else 0)
            middle = self.piece(whole[start:end])
            upto, first = (begun, 0) if i == begun else (-1, 0)
            if i > begun:
                for k, (x, y) in enumerate(zip(left.ids[i:], middle.ids, strict=False)):
                    if x != y:
                        break
                    place = start + middle.ends[k]
                    if place < cut and self.sure(whole, place, marked):
                        upto, first = i + k + 1, k + 1
            after, skip, rest = len(middle.ids), len(right.ids), None
            agreed = last and j == len(right.ids)
            if not agreed:
                for k, (x, y) in enumerate(zip(reversed(right.ids[:j]), reversed(middle.ids), strict=False)):
                    if x != y:
                        break
                    n = j - k - 1  # tokens of right before this one
                    place = cut + (right.ends[n - 1] if n else 0)
                    if place > cut and self.sure(whole, place, marked):
                        after, skip, rest, agreed = len(middle.ids) - k - 1, n, right, True
            if agreed and upto >= 0 and first <= after:
                return left, upto, middle, first, after, rest, skip
            if i == begun and j == len(right.ids):  # nothing is sure: both are one piece from here on
                return left, begun, middle, 0, 0, middle, 0
            around *= 2

    def parts(self, data: bytes):
        """(piece, first id, id after the last) in order; together they are the ids of the whole text."""
        ends = [*boundaries(data).tolist(), len(data)]
        ends = sorted({self.letter(data, e) for e in ends})
        left, begun, start = None, 0, 0
        for end in ends:
            if end == start:
                continue
            right, start = self.chunk(data[start:end]), end
            if left is None:
                left = right
                continue
            left, upto, middle, first, after, rest, skip = self.joined(left, begun, right, end == len(data))
            yield left, begun, upto
            yield middle, first, after
            left, begun = rest, skip
        if left is not None:
            yield left, begun, len(left.ids)

    @staticmethod
    def letter(data: bytes, at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        data = (text or "").encode()
        n, ids, decoded, held = 0, hashlib.sha256(), hashlib.sha256(), ""
        for piece, a, b in self.parts(data):
            if b > a:
                ids.update(held.encode())
                held = piece.text[piece.marks[a] : piece.marks[b]]
                n += b - a
                decoded.update(piece.data[piece.ends[a - 1] if a else 0 : piece.ends[b - 1]])
        ids.update(held[:-1].encode())  # no comma after the last
        return n, ids.hexdigest(), decoded.hexdigest()

    def ids(self, text: str | None) -> list[int]:
        return [i for piece, a, b in self.parts((text or "").encode()) for i in piece.ids[a:b]]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for each worker process: its chunks outlive tasks."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def bpe(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs`; `path` is a vocabulary file on every machine.

    A chunk is encoded once by each worker that meets it, as long as KEPT bytes hold it: sending encoded chunks between
    machines would shuffle more than the texts. Null and empty texts have no ids; repeated rows and null ids give a row
    each; a very long text is a long row of chunks; an empty table gives an empty result. doc_id must be a whole number.
    Columns of `docs` other than doc_id and text are ignored.
    """

    def run(texts: list[str | None]) -> dict:
        made = [coder(path)(t) for t in texts]
        return {"n_tokens": [m[0] for m in made], "ids_sha256": [m[1] for m in made], "decoded_sha256": [m[2] for m in made]}

    return rows_to_arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves, for writers of token files. Null and empty texts have an empty array; rows as in `bpe`."""
    return rows_to_arrow(docs, lambda texts: {"ids": [coder(path).ids(t) for t in texts]}, "doc_id long, ids array<int>")
