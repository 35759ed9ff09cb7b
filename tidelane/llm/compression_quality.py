"""Quality: zstandard dictionaries built from good and bad text; the compressed-size difference becomes a score."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import held_out, label_counts, labelled_sample, rows_to_arrow

#: Bytes of a dictionary, of a block that is compressed by itself, and zstandard's level.
DICTIONARY, BLOCK, LEVEL = 262_144, 512, 3


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """Trained on the texts' blocks; with too few of them, their end as raw content."""
    whole = [t.encode("utf-8", "replace") for t in texts]
    samples = [d[i : i + 1024] for d in whole for i in range(0, len(d) - 7, 1024)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Difference of the sizes under the bad and the good dictionary, as a share of the text's bytes."""

    def __init__(self, bad: bytes, good: bytes):
        self.both = []
        for raw in (bad, good):
            form = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            if len(raw) < 8:
                self.both.append(zstandard.ZstdCompressor(compression_params=form))
                continue
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(compression_params=form)
            self.both.append(zstandard.ZstdCompressor(compression_params=form, dict_data=words))

    def __call__(self, text: str | None) -> float:
        parts = blocks(text or "")
        bad, good = (sum(len(c.compress(p)) for p in parts) for c in self.both)
        return (bad - good) / max(1, sum(map(len, parts)))


def calibrate(x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of Platt's scaling, by Newton's method with his smoothed targets; rows of a label weigh alike."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    if not n1 or not n0:
        return 0.0, 40.0 if n1 else -40.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    weight = np.where(y == 1, weights[1], weights[0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, z.T @ (weight * (t - p)) - 1e-6 * w)
        w = w + change * min(1.0, 50 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(sample: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> dict:
    """Dictionaries from the even places of the sample, calibrated on the odd ones.

    counts: documents of either label. In calibration each label weighs as much as it has documents, however many of
    them are in the sample, so the score is the same share of good documents at every size.
    """
    by = [[t for t, label in sample if label == k] for k in (0, 1)]
    bad, good = (dictionary(x[::2]) for x in by)
    sizes = Sizes(bad, good)
    rest = [(sizes(t), k) for k in (0, 1) for t in (by[k][1::2] or by[k])]
    x, y = np.array([a for a, _ in rest]), np.array([b for _, b in rest])
    have = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = [n / max(1, sum(counts)) * len(y) for n in counts] if counts else have
    slope, intercept = calibrate(x, y, (share[0] / have[0], share[1] / have[1]))
    return {"bad": bad, "good": good, "slope": slope, "intercept": intercept}


_READY: dict[int, Sizes] = {}


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    key = hash((model["bad"], model["good"]))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Sizes(model["bad"], model["good"])
    x = np.array([_READY[key](t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["intercept"], -500, 500)))


def compression_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, max_rows: int = 8_192, max_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`.

    Dictionaries and calibration come from labelled rows whose crc32(doc_id as text) mod `folds` isn't `fold`, a sample
    bounded by `max_rows` and `max_bytes`. Every row, repeated or not, is scored by its whole text; null and empty
    texts get the score of a difference of 0. A null doc_id is kept, not held out. Columns of `docs` other than doc_id
    and text are ignored; an empty table gives an empty result, and without labels of both kinds all scores are alike.
    """
    model = fit(labelled_sample(docs, labels, "quality", folds, fold, max_rows, max_bytes), label_counts(labels, "quality", folds, fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 256 KiB at most
    scored = rows_to_arrow(docs, lambda texts: {"score": scores(shared.value, texts)}, "doc_id long, score double")
    return scored.select("doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
