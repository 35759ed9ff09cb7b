"""Awkward columns and rows, long texts, held-out accuracy, recall against all pairs, and the pipeline as a whole."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelane.llm import bpe, compression_quality, decontamination, linking, ngram_join, paragraphs, secrets, suffix_dedup, toxicity
from tidelane.llm.queries import vocabulary

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_clashing_names_and_maps(spark):
    """Filters keep columns that have the names they would use, and rows with columns that can't be compared."""
    schema = "doc_id long, text string, key_of_text long, number_of_row int, id_gone long, CONTAMINATED_doc long, contaminated_key long, __doc long, m map<string,int>"
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, i, 0, 0, 0, 0, 0, {"a": i}) for i, t in [(1, words), (2, words), (2, words), (3, "x y"), (3, "other words"), (None, words), (None, "lone words"), (4, None), (5, "")]]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id != 3) == [("1", words), ("4", None), ("5", ""), ("None", "lone words")]
    assert sum(r.doc_id == 3 for r in kept.collect()) == 1
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    assert secrets.mask_secrets(docs.drop("m")).count() == len(rows)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs.drop("m"), labels).columns == docs.drop("m").columns


def test_very_long_text(spark):
    """A text of 800,000 letters, with a copy of a passage at its far end, through the operators that compare texts."""
    draw = random.Random(2)
    long = " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "start " + long[-300:]), (3, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 300 and got[3].n_removed == len(long)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert bpe.Coder(vocabulary())(long)[2] == hashlib.sha256(long.encode()).hexdigest()


def test_anchors_don_t_depend_on_their_block(monkeypatch):
    draw = random.Random(3)
    data = np.frombuffer(bytes(draw.choice(b"ab cdefgh") for _ in range(5000)), np.uint8)
    whole = suffix_dedup.anchors(data)
    assert (np.diff(whole) >= 0).all() and ((whole - np.arange(len(whole))) < suffix_dedup.WIDTH).all()
    for a in range(0, 4000, 371):
        assert (suffix_dedup.anchors(data[a : a + 600]) + a == whole[a : a + 551]).all()
    monkeypatch.setattr(suffix_dedup, "STRIDE", 97)
    assert (suffix_dedup.anchors(data) == whole).all()


def test_hot_lists_lose_no_link(spark, monkeypatch):
    """Documents out of few common sentences, so that lists are long and have many components, against all pairs."""
    draw = random.Random(6)
    said = [" ".join(draw.choice("abcdefghijklmnopqrstuvw") * 3 for _ in range(8)) for _ in range(14)]
    texts = [" ".join(draw.sample(said, 11)) for _ in range(60)]
    texts += [t.replace(t.split()[5], "zz", 1) for t in texts[:25]]
    sets = linking.shingle_sets(ngram_join.lowered(texts), 3)
    group = list(range(len(texts)))
    for _ in group:
        for i in range(len(texts)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    group[i] = group[j] = min(group[i], group[j])
    monkeypatch.setattr(linking, "HOT", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == dict(enumerate(group))


def held_out_accuracy(frame, labels, label):
    rows = frame.filter("held_out").join(labels, "doc_id").select("predicted", label).filter(f"{label} is not null").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_classifiers_on_held_out_rows(tables):
    assert held_out_accuracy(toxicity.toxicity(tables["documents"], tables["labels"]), tables["labels"], "toxic") >= 0.9
    assert held_out_accuracy(compression_quality.compression_quality(tables["documents"], tables["labels"]), tables["labels"], "quality") >= 0.85


def test_paragraph_links_against_all_pairs(spark):
    """Of paragraphs that are linked by brute force, at least 0.95 come into one component; none of what isn't linked does."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    first = [[word() for _ in range(60)] for _ in range(40)]
    texts = [" ".join(w) for w in first]
    for w in first:
        changed = list(w)
        changed[draw.randrange(60)] = word()
        texts.append(" ".join(changed))
    cut = paragraphs.Cut(texts)
    hashes, counts = cut.shingles(np.arange(len(cut.first)))
    ends = np.cumsum(counts)
    sets = [set(hashes[e - n : e].tolist()) for e, n in zip(ends, counts, strict=True)]
    want = {(int(cut.owner[i]), int(cut.place[i])) for i in range(len(sets)) if cut.words[i] >= paragraphs.LEAST for j in range(len(sets)) if cut.owner[j] < cut.owner[i] and cut.words[j] >= paragraphs.LEAST and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    out = paragraphs.paragraph_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc_id, int(p)) for r in out for p in r.removed.split(",") if p}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_own_secret_rules_against_plain_search():
    """Rules with what trigrams can't tell find what a plain search finds, and every row keeps its place."""
    own = {
        "kelvin": (r"(?i)token\d+", 0, ("match", 0)),
        "around": (r"(?<=key=)[a-z]{4}(?!x)", re.A, ("match", 0)),
        "accent": (r"clé-[0-9]+|pass-[0-9]+", re.A, ("match", 7)),
        "twice": (r"(ab)?(\w+)=\2", re.A, ("value", 2)),
        "wide": (r"漢字鍵[0-9]{2}", 0, ("match", 0)),
        "dotted": (r"abİ[0-9]", re.I, ("match", 0)),
    }
    draw = random.Random(4)
    parts = ["to\u212aen12", "TOKEN7", "token", "key=abcd", "key=abcdx", "clé-1234", "pass-12", "pass-1", "qq=qq", "abz=z", "漢字鍵42", "abİ3", "ABi̇3", " ", "\n"]
    texts = ["", None] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    place = list(own)
    for text, spans in zip(texts, secrets.scan(texts, own), strict=True):
        want = [(*m.span(), k) for k, (p, f, (what, least)) in own.items() for m in re.finditer(p, text or "", f) if len(m[2] if what == "value" else m[0]) >= least]
        assert spans == sorted(want, key=lambda s: (s[0], place.index(s[2])))
    assert secrets.trigram_query("(?i)mask") == secrets.ALL and secrets.trigram_query("mark", re.A) != secrets.ALL


def test_added_secret_rules_against_plain_search():
    for kind, (pattern, flags, _) in list(secrets.RULES.items())[3:]:
        made = {"pem": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1B2" * 10, "slack": "xoxb-" + "1a-" * 6, "google": "AIza" + "x" * 35, "stripe": "sk_live_" + "9z" * 12, "jwt": "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12}[kind]
        text = f"é before {made} after"
        assert [(a, b) for a, b, k in secrets.scan(["", None, text])[2] if k == kind] == [m.span() for m in re.finditer(pattern, text, flags)]


def test_pipeline(spark, tables):
    """Each stage on its predecessor's rows, held against the operators' own verdicts."""
    docs, seen = tables["documents"], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA)).cache()
        seen.append((name, docs.count(), out.count()))
        if name != "bpe":
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _, _ in seen] == ["toxicity", "ngram_join", "decontamination", "secret_scan", "bpe"]
    assert all(a >= b > 0 for _, a, b in seen) and seen[0][1] > seen[0][2] and seen[1][1] > seen[1][2]
    assert seen[3][1] == seen[3][2] == seen[4][2]
    assert corpus_pipeline.run(spark, str(DATA.parent / "sf0.001")).count() > 0


def test_far_copies_meet_once_for_all_in_divided_lists(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(24):  # a tenth of the words replaced, so that about a third of the shingles differ
        words = list(base)
        for at in rng.sample(range(20, 400), 40):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    docs.append((24, docs[7][1] + " more"))
    seen, whole = [], linking.merged
    monkeypatch.setattr(linking, "HOT", 4)
    monkeypatch.setattr(linking, "merged", lambda lists: seen.append(lists.filter("weight > 1").count()) or whole(lists))
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [*((i, i) for i in range(24)), (24, 7)]
    assert seen == [0]
    a, b = ([1, 2, 3, 4, 5, 6, 7, 8] * 2, [1] * 32)
    words = spark.createDataFrame([(a,), (b,)], "signs array<long>").select(ngram_join.folded(F.col("signs"))).collect()
    assert [r[0] for r in words] == [[0] * 8, [0] * 8]


def test_near_copies_stand_in_no_list_for_every_two_tokens(spark, monkeypatch):
    """Copies with five words replaced share dozens of tokens of long lists, but are too far apart to link."""
    rng = random.Random(8)
    docs = []
    for i in range(24):
        words = [f"w{k}" for k in range(400)]
        for at in rng.sample(range(20, 400), 5):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    docs.append((24, docs[7][1] + " more"))
    seen, whole = [], linking.of_several

    def counted(lists):
        found = whole(lists)
        seen.append(found.count())
        return found

    monkeypatch.setattr(linking, "HOT", 4)
    monkeypatch.setattr(linking, "of_several", counted)
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [*((i, i) for i in range(24)), (24, 7)]
    assert len(seen) == 2 and seen[0] > 24 * 20 and seen[1] <= seen[0]


def test_documents_with_many_and_with_few_long_lists_meet(spark, monkeypatch):
    """Links between documents on either side of TOKENS, and on each of its sides, against all pairs."""
    draw = random.Random(9)
    said = [" ".join(draw.choice("abcdefghijklmnopqrstuvw") * 3 for _ in range(8)) for _ in range(14)]
    texts = [" ".join(draw.sample(said, draw.randint(9, 12))) for _ in range(60)]
    for t in texts[:50]:
        words = t.split()
        texts.append(" ".join([*words[:-2], "zz", *words[-1:]] if draw.random() < 0.5 else [*words, f"n{len(texts)}", "zz"]))
    sets = linking.shingle_sets(ngram_join.lowered(texts), 3)
    group = list(range(len(texts)))
    for _ in range(8):
        for i in range(len(texts)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    group[i] = group[j] = min(group[i], group[j])
    seen, whole = [], linking.in_whole_lists
    monkeypatch.setattr(linking, "HOT", 3)
    monkeypatch.setattr(linking, "TOKENS", 7)
    monkeypatch.setattr(linking, "in_whole_lists", lambda warm, n: seen.append({r.many for r in warm.select("many").distinct().collect()}) or whole(warm, n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == dict(enumerate(group))
    assert seen == [{True, False}]


def test_in_whole_lists_all_meet_but_the_rest_itself(spark):
    rows = [(t, i, 9, 0, i, 9, 1, 2, i < 3) for t, ids in ((7, (1, 2, 3, 4)), (8, (2, 5)), (9, (4, 5))) for i in ids]
    warm = spark.createDataFrame(rows, "token long, id long, n int, pos int, component long, met int, weight int, least int, many boolean")
    lists = linking.in_whole_lists(warm, 2).collect()
    met = {(x.id, y.id) for x in lists for y in lists if x.token == y.token and x.asks and y.posts and x.id != y.id}
    assert met == {(a, b) for ids in ((1, 2, 3, 4), (2, 5)) for a in ids for b in ids if a != b and min(a, b) < 3}
    assert {(x.id, x.least) for x in lists if x.asks} == {(1, 2), (2, 2), (3, 1), (4, 1), (5, 1)}
