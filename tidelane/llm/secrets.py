"""Secret scans by a trigram index: Boolean trigram queries from the rules, postings of each block, verification."""

from __future__ import annotations

import functools
import hashlib
import re
import re._constants as sre
import re._parser as sre_parse

import numpy as np
from pyspark.sql import DataFrame

from tidelane.llm.common import pieces, rows_to_arrow, small_batches

#: kind -> (pattern, flags, ("match", fewest characters of the match) or ("value", fewest of group 2)), the rules that are
#: looked for unless others are given. The first three, in this order, are the base kinds.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, ("value", 6)),
    "access": (r"AKIA[A-Z0-9]+", re.A, ("match", 20)),
    "hex": (r"[0-9a-f]+", re.A, ("match", 24)),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A, ("match", 0)),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", re.A, ("match", 0)),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A, ("match", 0)),
    "google": (r"AIza[0-9A-Za-z_-]{35}", re.A, ("match", 0)),
    "stripe": (r"[sr]k_live_[0-9a-zA-Z]{20,}", re.A, ("match", 0)),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", re.A, ("match", 0)),
}
BASE = ("assign", "access", "hex")
ALL = ("all",)


def either(parts: list) -> tuple:
    return ALL if ALL in parts or not parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def both(parts: list) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def trigrams(text: str, unsure: str = "") -> tuple:
    """The trigrams of ASCII characters without any of `unsure`; the others demand nothing, as the index has bytes."""
    three = [text[i : i + 3] for i in range(len(text) - 2)]
    return both([("tri", t) for t in three if t.isascii() and not set(t) & set(unsure)])


def trigram_query(pattern: str, flags: int = 0, most: int = 16) -> tuple:
    """What every match of `pattern` contains, in lower case: ("tri", abc), ("and", ...), ("or", ...) or ALL.

    Runs of literals, small classes and alternatives are multiplied out to at most `most` exact strings; where that
    ends, the strings so far give their trigrams and a new run begins. Parts that may be absent demand nothing, nor do
    i, k and s where letters of other alphabets match them in either case.
    """
    unsure = "" if flags & re.A or "(?a" in pattern else "iks"

    def walk(items) -> tuple:
        done, exact = [], {""}

        def close():
            done.append(either([trigrams(x, unsure) for x in exact]))

        for op, arg in items:
            options = alternatives(op, arg)
            if options is not None and len(exact) * len(options) <= most:
                exact = {a + b for a in exact for b in options}
                continue
            close()
            exact = {""}
            if op is sre.SUBPATTERN:
                done.append(walk(arg[3]))
            elif op is sre.BRANCH:
                done.append(either([walk(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                done.append(walk(arg[2]))
        close()
        return both(done)

    def lower(c: int) -> str:
        return chr(c).lower() if c < 128 else chr(c)

    def alternatives(op, arg) -> set[str] | None:
        """The strings that this part stands for, if they are few."""
        if op is sre.LITERAL:
            return {lower(arg)}
        if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {lower(c) for _, c in arg}
        if op is sre.SUBPATTERN:
            return product(arg[3])
        if op is sre.BRANCH:
            parts = [product(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] in (0, 1):
            one = product(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def product(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            options = alternatives(op, arg)
            if options is None or len(out) * len(options) > most:
                return None
            out = {a + b for a in out for b in options}
        return out

    return walk(sre_parse.parse(pattern, flags))


def mandatory(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(mandatory(q) for q in query[1:])) if query != ALL else set()


#: The rule for hex with its length test in the pattern: a run of at least so many characters is faster to look for.
LONG_HEX = re.compile(r"[0-9a-f]{24,}", re.A)


def code(tri: str) -> int:
    a, b, c = tri.encode("ascii")
    return a << 16 | b << 8 | c


class Rules:
    """Rules ready to be looked for: compiled, with their trigram queries and the codes of the trigrams those name."""

    def __init__(self, rules: dict):
        self.kinds = {kind: i for i, kind in enumerate(rules)}
        self.least = {kind: least for kind, (_, _, least) in rules.items()}
        self.queries = {kind: trigram_query(pattern, flags) for kind, (pattern, flags, _) in rules.items()}
        self.compiled = {kind: LONG_HEX if rule == RULES["hex"] else re.compile(rule[0], rule[1]) for kind, rule in rules.items()}
        self.wanted = sorted({code(t) for q in self.queries.values() for t in mandatory(q)})
        self.listed = np.zeros(1 << 24, dtype=np.uint8)
        self.listed[self.wanted] = 1

    def matches(self, kind: str, text: str) -> list[tuple[int, int]]:
        what, least = self.least[kind]
        return [m.span() for m in self.compiled[kind].finditer(text) if (len(m[2] or "") if what == "value" else m.end() - m.start()) >= least]


@functools.lru_cache(maxsize=4)
def _prepared(rules: tuple) -> Rules:
    return Rules(dict(rules))


def prepared(rules: dict | None) -> Rules:
    """Made once a worker process for each set of rules."""
    return _prepared(tuple((RULES if rules is None else rules).items()))


class Index:
    """Postings of the trigrams that some query names, over one block of texts; letters count in lower case."""

    def __init__(self, texts: list[str], rules: Rules):
        self.n = len(texts)
        wanted, place = rules.wanted, rules.listed
        data = [t.encode("utf-8", "replace").lower() for t in texts]
        ends = np.cumsum([len(d) + 3 for d in data])
        b = np.frombuffer(b"\0\0\0".join(data) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        grams = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        at = np.flatnonzero(place[grams])
        found, row = grams[at], np.searchsorted(ends, at, side="right")
        order = np.argsort(found, kind="stable")
        found, row = found[order], row[order]
        cut = np.searchsorted(found, [*wanted, 1 << 24])
        self.postings = {w: np.unique(row[cut[i] : cut[i + 1]]) for i, w in enumerate(wanted)}

    def rows(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[code(query[1])]
        parts = sorted((self.rows(q) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def scan(texts: list[str | None], rules: dict | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text's secrets, by start and then kind as listed; a null text has none."""
    texts, look = [t or "" for t in texts], prepared(rules)
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if texts:
        index = Index(texts, look)
        for kind, query in look.queries.items():
            for i in index.rows(query):
                found[i] += [(a, b, kind) for a, b in look.matches(kind, texts[i])]
    return [sorted(f, key=lambda s: (s[0], look.kinds[s[2]])) for f in found]


def digest(texts: list[str | None], rules: dict | None = None) -> dict:
    out: dict = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
    for spans in scan(texts, rules):
        for k in BASE:
            out[f"n_{k}"].append(sum(s[2] == k for s in spans))
        text = lambda kept: ",".join(f"{k}:{a}:{b}" for a, b, k in kept)
        out["base_sha256"].append(hashlib.sha256(text(s for s in spans if s[2] in BASE).encode()).hexdigest())
        out["spans"].append(text(spans))
    return out


def secret_scan(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of `docs`.

    `rules` has the form of RULES and takes its place; base kinds that it lacks are counted as 0. A rule may use any
    pattern of `re`; what its trigram query cannot tell (look-around, back references, letters beyond ASCII) makes it
    read more texts, never fewer.

    Each block of rows gets an index of its own, so postings never leave the task. Rules whose query is ALL read every
    text of the block; the others read the rows that their postings leave. Null and empty texts have no spans; repeated
    rows and null ids give a row each. Columns of `docs` other than doc_id and text are ignored.
    """
    return rows_to_arrow(docs, functools.partial(digest, rules=rules), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, str]], by: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced."""
    out, at, merged = [], 0, []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """`docs` with the secrets in `text` masked (those of `rules`, as in `secret_scan`); n_chars follows the text where there is such a column and a secret.

    Null and empty texts and all other columns stay as they are; repeated rows are masked alike; an empty table stays empty.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                new = [mask(t, s) if s else t for t, s in zip(texts, scan(texts, rules), strict=True)]
                cols = {f.name: part.column(f.name) for f in part.schema}
                if "n_chars" in cols:
                    kind = part.schema.field("n_chars").type
                    old = part.column("n_chars").to_pylist()
                    cols["n_chars"] = pa.array([o if a is b else len(b) for o, a, b in zip(old, texts, new, strict=True)], kind)
                cols["text"] = pa.array(new, part.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
