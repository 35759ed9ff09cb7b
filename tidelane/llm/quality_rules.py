"""Quality rules with risk-controlled thresholds.

Cutoffs on text statistics are chosen on labelled documents. A cutoff is accepted for a stratum only if an exact
binomial test rejects, at the corrected level, that it throws away more than the allowed share of good documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import durable, rows_to_arrow, text_key

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A document's stratum is the number of these word counts that it reaches.
STRATA = (100, 400)
#: What is compared with a cutoff, and the cutoffs, from lenient to strict: as many for each feature.
FEATURES = {
    "symbol_rate": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04)),
    "dup_line_rate": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "repeat_rate": ("n_repeat_words", "n_words", (0.29, 0.28, 0.27, 0.26, 0.25, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12)),
}
RULES = len(FEATURES["symbol_rate"][2])


def repeated(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of `size` words that occur twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, size)
    _, which, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(count[which.ravel()] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of STATS for one text; all are 0 for null."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), lines, dup, repeated(words)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and STATS of each row."""

    def stats(texts: list[str | None]) -> dict:
        return dict(zip(STATS, np.array([text_stats(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS)).T, strict=True))

    told = docs.select("doc_id", "text", text_key().alias("text_key"))
    return rows_to_arrow(told, stats, "doc_id long, text_key long, " + ", ".join(f"{s} long" for s in STATS), "text_key")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.col("n_words") >= n).cast("int") for n in STRATA)


def below(k: int, n: int, risk: float) -> float:
    """P(Bin(n, risk) <= k): the exact p-value of 'at least `risk` of the good documents are lost'."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


#: Of each stratum: its good documents, and for each feature how many of them each of its cutoffs rejects.
Counts = dict[int, tuple[int, dict[str, list[int]]]]


def select_rules(counts: Counts, risk: float, error: float) -> dict[int, dict[str, int]]:
    """The strictest certified cutoff of each feature in each stratum; none where not even the first is certified.

    A feature's cutoffs in a stratum are tested in their fixed order until one fails, which needs no correction. Over strata and
    features `error` is divided (Bonferroni), so all choices hold together; over features `risk` is divided, too, so that what
    they reject together stays within it. A feature that loses good documents at once doesn't stop the others.
    """
    level, share, chosen = error / (len(STRATA) + 1) / len(FEATURES), risk / len(FEATURES), {}
    for layer, (n, lost) in counts.items():
        for feature, each in lost.items():
            for i, k in enumerate(each):
                if below(k, n, share) > level:
                    break
                chosen.setdefault(layer, {})[feature] = i
    return chosen


def over(feature: str, i: int) -> Column:
    """Whether a document's rate is over the feature's i-th cutoff."""
    a, b, cutoffs = FEATURES[feature]
    return F.col(a) > cutoffs[i] * F.col(b)


def good_counts(stats: DataFrame, labels: DataFrame) -> Counts:
    """Counts over all documents labelled good that pass the base rules: a row for each stratum comes back.

    The binomial bound takes trials to be independent, so a doc_id counts once (its row with the smallest text key), and then
    so does a text, however many documents have it.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    told = stats.filter(~base_failed()).join(good, "doc_id", "left_semi")
    numbers = F.struct(*STATS)
    once = told.groupBy("doc_id").agg(F.min(F.struct("text_key", numbers.alias("s"))).alias("r"))
    texts = once.groupBy("r.text_key").agg(F.min("r.s").alias("s")).select("s.*")
    lost = [F.sum(over(f, i).cast("long")).alias(f"{f}_{i}") for f in FEATURES for i in range(RULES)]
    rows = texts.groupBy(stratum().alias("layer")).agg(F.count("*").alias("n"), *lost).collect()
    return {r.layer: (r.n, {f: [r[f"{f}_{i}"] for i in range(RULES)] for f in FEATURES}) for r in rows}


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, stratum for each row of `docs`.

    With probability 1 - `error` at least, each stratum's cutoffs together reject at most `risk` of its good documents: a
    stratum needs about 3 log(9 / error) / risk different good texts (777 here) before any cutoff can be certified, and keeps all
    that the base rules keep until then. Every row, repeated or not, is judged by its whole text; null and empty texts have no
    words and fail the base rules. A rate equal to the cutoff is kept. Labels of one doc_id count once (the largest);
    null ids match no label. doc_id must be a whole number. Columns of `docs` other than doc_id and text are ignored; an
    empty table gives an empty result.
    """
    stats = durable(document_stats(docs))  # a few numbers for each document, read twice
    strict = F.lit(False)
    for layer, rules in sorted(select_rules(good_counts(stats, labels), risk, error).items()):
        for feature, i in rules.items():
            strict = strict | ((stratum() == layer) & over(feature, i))
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select("doc_id", *wanted, base_failed().alias("base_failed"), (~base_failed() & ~strict).alias("kept"), "n_lines", stratum().alias("stratum"))
