"""Alignment of two tokenizers, neighbour search and whitening against brute force, and their awkward rows."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidelane.llm import alignment, neighbours, whitening
from tidelane.llm.queries import PIECES, vocabulary

DATA = Path("/root/testdata/sf0.01")
NAN = float("nan")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


def plain_alignment(texts: dict) -> dict:
    """Rows of `alignment` by loops over tokens that the libraries give."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(vocabulary())
    a_side.encode_special_tokens = True
    a_side.no_truncation()
    names = __import__("tidelane.llm.bpe", fromlist=["byte_names"]).byte_names()
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    found, links = {}, Counter()
    for key, text in texts.items():
        found[key] = None
        if not text:
            continue
        a = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(names[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i in b_side.encode(text) for p in [b_side.id_to_piece(i)]]
        data = (" " + text).encode()
        if b"".join(x[1] for x in a) != data or b"".join(x[1] for x in b) != data:
            continue
        ends = [[sum(len(x[1]) for x in side[: k + 1]) for k in range(len(side))] for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(x[0]) for x, e in zip(side, where, strict=True) if low < e <= cut) for side, where in ((a, ends[0]), (b, ends[1]))) for low, cut in zip([0, *cuts], cuts)]
        mine = [(x[0], y[0]) for x, e in zip(a, ends[0], strict=True) for y, g in zip(b, ends[1], strict=True) if e == g]
        links.update(mine)
        found[key] = len(a), len(b), len(cuts), mine, hashlib.sha256(";".join(groups).encode()).hexdigest()
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return {k: (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(links[p] == best[p[1]] for p in f[3]), sum(links[p] for p in f[3]), f[4]) for k, f in found.items()}


def test_alignment_equals_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.orderBy("n_chars").limit(150).collect()}
    extra = ["<|endoftext|> and <s> x </s>", "  two  spaces ", "a▁b", "é ① ﬁ \U0001f600\U0001f601", "a\tb\r\nc\x00d", "漢字かな", "word " * 40, "é", " ", "\n", "<0x41>", "x" * 300, None, ""]
    texts |= {-1 - i: t for i, t in enumerate(extra)}
    table = spark.createDataFrame([(k, v, 7, "x") for k, v in texts.items()], "doc_id long, text string, pairs int, n_a string")
    rows = {r.doc_id: tuple(r)[1:] for r in alignment.alignment(table, vocabulary(), vocabulary(PIECES)).collect()}
    assert rows == plain_alignment(texts)
    assert sum(r[0] > 0 for r in rows.values()) > 100


def test_alignment_of_long_and_repeated_texts(spark, monkeypatch):
    """A text in parts has the ids that the whole text has; copies count each time."""
    monkeypatch.setattr(alignment, "PART", 3)
    side, rng = alignment.Pieces(vocabulary(PIECES)), random.Random(3)
    for text in (" ".join(f"word{i}  été, {'x' * (i % 60)}" for i in range(3000)) + " ", "y" * 5000, " ", "   ", "a", " a ", "\n \n  b\t"):
        assert side(text) == side.model.encode(text)
    for _ in range(2000):
        text = "".join(rng.choice(["  ", " ", "a", "the", "é", "漢", "\n", ".", "0", "ing"]) for _ in range(rng.randint(1, 30)))
        assert side(text) == side.model.encode(text)
    rows = [(1, "some words"), (1, "some words"), (None, "some words"), (2, None)]
    got = alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), vocabulary(PIECES)).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in got) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), vocabulary(), vocabulary(PIECES)).collect() == []


def test_pairs_that_can_be_linked_are_bounded(spark):
    known = alignment.aligner(vocabulary(), vocabulary(PIECES))
    assert known.possible() < 1_000_000
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    pairs = alignment.token_pairs(docs, vocabulary(), vocabulary(PIECES)).collect()
    for r in pairs[:2000]:
        a, b = known.first.bytes_of[r.a], known.second.bytes_of[r.b]
        assert a.endswith(b) or b.endswith(a)
    assert len({(r.a, r.b) for r in pairs}) == len(pairs) <= known.possible()


def brute(rows: list, every: int, k: int) -> dict:
    ids, x = [r[0] for r in rows], np.asarray([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            far = np.sqrt(((x - x[i]) ** 2).sum(1))
            out[q] = sorted((f, v) for f, v in zip(far.tolist(), ids, strict=True) if v != q)[:k]
    return out


def recall(found: list, want: dict) -> float:
    got = {(r.query_id, r.vec_id) for r in found}
    return np.mean([(q, v) in got for q, best in want.items() for _, v in best])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_are_found(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 20, 10)
    got = neighbours.neighbours(table, every=20).collect()
    assert recall(got, want) >= 0.95
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    x = {i: np.asarray(v, dtype=np.float64) for i, v in rows}
    assert set(by) == set(want) and all(len(b) == 10 and b == sorted(b) for b in by.values())
    assert all(math.isclose(s, math.sqrt(((x[q] - x[v]) ** 2).sum()), rel_tol=1e-12) for q, b in by.items() for s, v in b)


def test_neighbours_in_larger_blocks(spark, vectors, monkeypatch):
    """One block, whose footrule ranking leaves most vectors out of the second look."""
    monkeypatch.setattr(neighbours, "BLOCKS", 1)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(size=24) * 0.6).tolist()) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.neighbours(table).collect()
    assert recall(got, brute(rows, 100, 10)) >= 0.9


def test_neighbours_of_copies_and_awkward_rows(spark):
    """A third of all rows is one vector; ties go to small ids, and whatever is no vector takes no part."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).round(1).tolist()) for i in range(600)]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(1000, None), (1001, []), (1100, [NAN, 1.0, 2.0]), (1200, [float("inf"), 0.0, 0.0]), (1300, [0.0, 0.0, 0.0]), (1400, [None, 1.0, 1.0]), (1500, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, b"") for i, v in rows + odd + rows[:50]], "vec_id long, embedding array<double>, block int, key binary")
    want = brute(rows, 100, 10)
    got = {}
    for r in neighbours.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert {q: [v for _, v in b] for q, b in want.items()} == {q: [v for *_, v in b] for q, b in got.items()}
    assert all([r for r, *_ in b] == list(range(1, 11)) for b in got.values())
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-0.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.neighbours(few).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, math.sqrt(2))]
    assert neighbours.neighbours(few.limit(0)).collect() == [] and neighbours.neighbours(few.limit(1)).collect() == []


def plain_whitening(rows: list, most: int = 16):
    x = np.asarray([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    c = fit - np.asarray(sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    white = (x - np.asarray(sums) / n) @ vectors / np.sqrt(values)
    return n, [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x], white, values / np.trace(c.T @ c / n)


def test_whitening_equals_numpy(spark, vectors):
    base = [(r.vec_id, r.embedding) for r in vectors.collect()]
    rows = base + base[:100] + [(10_000 + i, v) for i, v in base[:7]]
    odd = [(-1, None), (-2, [NAN] * 64), (-3, [None] * 64), (-4, [1.0]), (-5, []), (None, base[0][1]), (-6, [float("inf")] * 64)]
    table = spark.createDataFrame([(i, v, 1.0, "a") for i, v in rows + odd], "vec_id long, embedding array<float>, x double, key string")
    n, deviation, white, explained = plain_whitening(rows)
    got = sorted(whitening.whitening(table).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 16 * len(rows) and len({(r.vec_id, r.component, r.whitened) for r in got}) == 16 * (len(rows) - 100)
    order = sorted(range(len(base), len(rows)), key=lambda i: rows[i][0]) + [i for i in range(100, len(base))]
    at = {(r.vec_id, r.component): r for r in got}
    got = [at[rows[i][0], c] for i in order for c in range(1, 17)]
    w, mine = np.asarray([r.whitened for r in got]).reshape(-1, 16), white[order]
    assert np.abs(np.abs(w) - np.abs(mine)).max() < 1e-6
    assert all(np.allclose(w[:, j], s * mine[:, j], atol=1e-6) for j in range(16) for s in [np.sign(w[0, j] * mine[0, j])])
    assert [r.deviation for r in got[::16]] == [deviation[i] for i in order]
    assert {r.n for r in got} == {n} and np.allclose([r.explained for r in got[:16]], explained, rtol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_without_variance_and_with_huge_entries(spark):
    few = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(0, [0.0, 0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whitening(few).collect()
    assert len(got) == 30 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert got[0].identity_error < 1e-9 and got[0].n == 9 and math.isclose(got[0].explained, 1)
    one = whitening.whitening(few.limit(1)).collect()
    assert len(one) == 3 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in one)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitening(huge).collect()] == [None] * 4
    assert whitening.whitening(few.limit(0)).collect() == []
