"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import held_out, labelled_sample, pieces, rows_to_arrow, small_batches

#: Length of the n-grams in characters, and the bits of the table that they are hashed to.
ORDERS, BITS = (4, 5), 20
#: Characters that are hashed together.
STRIDE = 1 << 16


def grams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of every order of the lower-cased text; white space counts as one blank."""
    text = " " + " ".join(text.lower().split()) + " "
    out = np.empty(0, dtype=np.uint32)
    for at in range(0, len(text), STRIDE):  # a part goes on for the n-grams that begin in it
        part = np.unique(part_grams(text[at : at + STRIDE + max(ORDERS) - 1]))
        out = np.union1d(out, part) if len(out) else part
    return out


def part_grams(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in ORDERS:
        size = len(points) - n + 1
        if size > 0:
            h = np.full(size, n, dtype=np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += points[k : k + size]
            h *= np.uint64(0xD6E8FEB86659FD93)
            found.append((h >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def fit(sample: list[tuple[str, int]], keep: int = 1024, prior: float = 1.0, ridge: float = 1e-3, steps: int = 300) -> dict:
    """Weights of the `keep` n-grams that tell the labels apart best, and the intercept.

    Presence of an n-gram in a document is its feature. The ratio r = log((p + prior) / |p|) - log((q + prior) / |q|)
    of its document counts in either class scales it before a ridge logistic regression, in which both classes weigh
    alike. Without both labels the score is that label throughout (0 without any).
    """
    y = np.array([label for _, label in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return {"slot": np.zeros(1 << BITS, np.int32), "weight": np.zeros(1), "bias": 40.0 if len(y) and y[0] else -40.0}
    counts = np.zeros((2, 1 << BITS))
    for text, label in sample:
        counts[label, grams(text)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float64)
    ratio = np.log((counts[1] + prior) / (n[1] + 2 * prior)) - np.log((counts[0] + prior) / (n[0] + 2 * prior))
    strength = np.abs(ratio) / np.sqrt(1 / (counts[0] + prior) + 1 / (counts[1] + prior))
    best = np.sort(np.argsort(-strength, kind="stable")[:keep])
    slot = np.zeros(1 << BITS, np.int32)
    slot[best] = np.arange(1, len(best) + 1)
    x = np.zeros((len(y), len(best)), dtype=np.float32)
    for i, (text, _) in enumerate(sample):  # hashed again, since the n-grams of all texts take more room than the texts
        hit = slot[grams(text)]
        x[i, hit[hit > 0] - 1] = 1
    x *= ratio[best].astype(np.float32)
    w, b = np.zeros(len(best), np.float32), 0.0
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]).astype(np.float32)
    step = 4.0 / (float(share @ np.einsum("ij,ij->i", x, x)) + 1)
    old_w, old_b = w, b
    for k in range(steps):  # accelerated gradient steps
        at_w, at_b = w + (k / (k + 3)) * (w - old_w), b + (k / (k + 3)) * (b - old_b)
        error = share * (1 / (1 + np.exp(-(x @ at_w + at_b))) - y).astype(np.float32)
        old_w, old_b = w, b
        w, b = at_w - step * (x.T @ error + ridge * at_w), at_b - step * float(error.sum())
    return {"slot": slot, "weight": np.concatenate([[0.0], w * ratio[best]]), "bias": float(b)}


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    """Between 0 and 1 for each text; null counts as empty."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        hit = model["slot"][grams(text or "")]
        out[i] = model["weight"][np.unique(hit[hit > 0])].sum() + model["bias"]
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = 0.5, max_rows: int = 16_384, max_bytes: int = 24_000_000, keep: int = 1024) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`; doc_id must be a whole number.

    The classifier is fitted on a sample of labelled rows bounded by `max_rows` and `max_bytes`, and has weights for the
    `keep` n-grams that tell the labels apart best; rows whose
    crc32(doc_id as text) mod `folds` is `fold` are held out of it. Every row, repeated or not, gets a score from its
    whole text alone. Null or empty texts get the score of a text without n-grams; a null doc_id is kept, not held out.
    Columns of `docs` other than doc_id and text are ignored; an empty table gives an empty result.
    """
    model = fit(labelled_sample(docs, labels, "toxic", folds, fold, max_rows, max_bytes), keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 slots and 1,024 weights, whatever the input
    scored = rows_to_arrow(docs, lambda texts: {"score": scores(shared.value, texts)}, "doc_id long, score double")
    return scored.select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """`docs` without the rows that the classifier rejects; all columns stay as they are, whatever their names.

    Null and empty texts get the score of a text without n-grams, repeated rows the same score; an empty table stays
    empty, and without labels of both kinds all rows share one fate. A score equal to the threshold rejects.
    """
    model = fit(labelled_sample(docs, labels, "toxic", options.get("folds", 5), options.get("fold", 0), options.get("max_rows", 16_384), options.get("max_bytes", 24_000_000)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(scores(shared.value, part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)
