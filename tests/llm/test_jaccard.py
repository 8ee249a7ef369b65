"""The Jaccard join against all pairs in plain Python."""

import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest

from anamnesis.llm import jaccard

LOW = str.maketrans(ascii_uppercase, ascii_lowercase)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def wanted(rows, size=3, like=(90, 100)):
    sets = [shingles(t, size) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=sorted)
    top = {s: s for s in kinds}

    def root(s):
        while top[s] != s:
            s = top[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if like[1] * len(a & b) >= like[0] * len(a | b):
                top[root(a)] = root(b)
    least: dict = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return Counter((d, len(s), least.get(root(s)) if s else d) for (d, _), s in zip(rows, sets))


def check(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "k", 1, "x") for d, t in rows], "doc_id bigint, text string, key string, node int, digest string").repartition(3)
    got = jaccard.similar(docs, **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    got = Counter(map(tuple, got.collect()))
    want = wanted(rows, how.get("size", 3), how.get("like", (90, 100)))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    return len({c for _, n, c in want if n})


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        at = random.randrange(len(out) + 1)
        out[at : at + random.choice([0, 1, 1, 2])] = [f"w{random.randrange(10**6)}"] * random.choice([0, 1, 1])
    return " ".join(out)


ODD = [(None, "no id at all here"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "two one"), (9, "a b c"), (10, "a b c d"), (None, "A B C"), (11, "x " * 100_000), (11, "x x x"), (12, "é 😀 \u0000 ﬁ"), (12, "é 😀 \u0000 ﬁ")]


def test_odd_rows(spark):
    check(spark, ODD)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_all_sizes(spark, seed):
    random.seed(seed)
    rows = list(ODD)
    for group in range(40):
        words = [f"v{random.randrange(400)}" for _ in range(random.choice([3, 8, 12, 13, 20, 21, 30, 45, 60, 100, 150, 300]))]
        rows += [(1000 * group + 100 + i, edited(words, random.choice([0, 0, 1, 1, 2, 3, 5, len(words) // 20]))) for i in range(random.choice([1, 2, 6, 20]))]
    assert check(spark, rows) > 40


def test_a_large_group(spark):
    """One base, hundreds of texts around it: many alike, many only nearly so, some alike with each other and not with the base."""
    random.seed(7)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(base, random.choice([1, 1, 2, 3, 4, 6, 8]))) for i in range(400)]
    far = edited(base, 9).split()
    rows += [(1000 + i, edited(far, random.choice([0, 1, 2]))) for i in range(60)]
    rows += [(2000 + i, " ".join(base[i : i + 130])) for i in range(20)] + [(3000, " ".join(base))] * 50
    assert check(spark, rows) > 20


def test_a_chain_and_templates(spark):
    random.seed(8)
    words = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(60)]
    rows += [(100 + i, " ".join(["dear"] + [f"t{k}" for k in range(12)] + [f"name{random.randrange(30)}"] + [f"u{k}" for k in range(10)])) for i in range(120)]
    check(spark, rows)


def test_other_settings(spark):
    random.seed(9)
    rows = [(i, edited([f"v{g}x{k}" for k in range(random.choice([6, 20, 50]))], random.choice([1, 2, 4]))) for g in range(15) for i in range(100 * g, 100 * g + 6)]
    check(spark, rows, size=2, like=(1, 2))
    check(spark, rows, size=1, like=(1, 1))
    with pytest.raises(ValueError):
        jaccard.similar(spark.createDataFrame([], "doc_id bigint, text string"), like=(3, 2))


def test_no_link_is_made_of_all_pairs(spark):
    """A group twice as large gives about twice the pairs that are compared, not four times."""
    random.seed(10)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, random.choice([1, 2, 3, 4, 6])) for _ in range(600)]
    met = []
    for n in (300, 600):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id bigint, text string")
        told = jaccard.materialize(jaccard.prints(docs, 3, 90, 100).withColumn("row", jaccard.F.monotonically_increasing_id()), "test-prints")
        kinds = jaccard.materialize(told.groupBy("h1", "h2", "n").agg(jaccard.F.min("row").alias("node"), jaccard.F.min("digest").alias("digest")), "test-kinds")
        found = jaccard.differences(jaccard.stars(told, kinds, 90, 100), kinds, docs, 3, 90, 100)
        met.append((found.count(), jaccard.from_the_centre(found).count()))
    (a, b), (c, d) = met
    assert c < 3 * a and d < 3 * b and c < 600 * 20


def test_keys_keep_the_bound():
    """Sets within the bound share a key, whatever they differ in."""
    random.seed(11)
    for _ in range(300):
        n = random.choice([5, 9, 10, 19, 20, 60, 200])
        h = np.array([random.getrandbits(64) for _ in range(n + 40)], np.uint64)
        a, b = h[:n], h[random.randint(0, max(1, n // 19)) : n + random.randint(0, max(1, n // 19))]
        inter, union = len(set(a.tolist()) & set(b.tolist())), len(set(a.tolist()) | set(b.tolist()))
        if 100 * inter >= 90 * union and inter < union:
            (x, gx), (y, gy) = (jaccard.keys_of(s, 90, 100) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist()) or set(x.tolist()) & set(gy.tolist()) or set(gx.tolist()) & set(y.tolist())


def test_no_rows(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_link_of_texts_is_lost(spark):
    """Pairs that barely are alike by 0.8, others that barely aren't, and a passage that more texts have than are paired with each other."""
    random.seed(12)
    word = lambda: f"v{random.randrange(10**6)}"
    passage, rows = [word() for _ in range(12)], []
    for _ in range(300):
        base = [word() for _ in range(90)] + passage
        copy, edits = list(base), random.choice([1, 2, 2, 2, 3])
        for at in random.sample(range(5, 85, 8), edits):
            copy[at] = word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    want = wanted(rows, 5, (80, 100))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    digests = {r.digest: r.doc_id for r in docs.select("doc_id", jaccard.digest(jaccard.F.col("text")).alias("digest")).collect()}
    groups: dict = {}
    for r in jaccard.texts_alike(docs).collect():
        groups.setdefault(r.root, []).append(digests[r.digest])
    got = Counter((d, min(g)) for g in groups.values() for d in g)
    assert got == Counter((d, c) for d, _, c in want) and 300 < len(groups) < 450


def test_strangers_share_no_segments():
    random.seed(13)
    seen = Counter()
    for _ in range(3000):
        h = np.array([random.getrandbits(64) for _ in range(random.randint(70, 100))], np.uint64)
        seen.update(np.concatenate(jaccard.keys_of(h, 90, 100)).tolist())
    assert max(seen.values()) == 1


def groups_of_texts(spark, rows):
    """(doc_id, least doc_id of its group) by texts_alike; texts differ."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    digests = {r.digest: r.doc_id for r in docs.select("doc_id", jaccard.digest(jaccard.F.col("text")).alias("digest")).collect()}
    groups: dict = {}
    for r in jaccard.texts_alike(docs).collect():
        groups.setdefault(r.root, []).append(digests[r.digest])
    return Counter((d, min(g)) for g in groups.values() for d in g)


def starred(spark, rows):
    """What prints and stars make of texts at similarity 0.8."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    often = spark.sparkContext.broadcast(jaccard.common(docs, 5))
    told = jaccard.materialize(jaccard.prints(docs, 5, 8, 10, often).withColumn("row", jaccard.F.monotonically_increasing_id()), "test-prints")
    kinds = jaccard.materialize(told.groupBy("h1", "h2", "n").agg(jaccard.F.min("row").alias("node"), jaccard.F.min("digest").alias("digest")), "test-kinds")
    return told, jaccard.stars(told, kinds, 8, 10, jaccard.FEW)


@pytest.mark.parametrize("rate", [16, 10**9])
def test_passages_of_many_texts_of_all_sizes(spark, monkeypatch, rate):
    """Keys with far more members than are paired: strangers of many sizes, groups of near copies among them, links that only just hold."""
    monkeypatch.setattr(jaccard, "RATE", rate)
    random.seed(14)
    word = lambda: f"v{random.randrange(10**6)}"
    passage, texts = [word() for _ in range(30)], []
    for i in range(240):
        base = [word() for _ in range(int(8 * 1.02 ** (i % 200)))] + passage
        texts.append(" ".join(base))
        for _ in range(random.choice([0, 0, 1, 3])):
            copy = list(base)
            for at in random.sample(range(len(base)), random.choice([1, 1, 2, 3, max(1, len(base) // 50)])):
                copy[at] = word()
            texts.append(" ".join(copy))
            base = copy if random.random() < 0.5 else base
    rows = list(enumerate(dict.fromkeys(texts)))
    want = wanted(rows, 5, (80, 100))
    assert groups_of_texts(spark, rows) == Counter((d, c) for d, _, c in want) and 200 < len({c for _, _, c in want}) < len(rows) - 50


def test_strangers_are_not_compared(spark, monkeypatch):
    """A passage that more texts have than are paired, long ones and texts of all sizes: no two of them are compared, nor with one of them."""
    monkeypatch.setattr(jaccard, "RATE", 10**9)
    random.seed(15)
    word = lambda: f"v{random.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    sizes = [6000 + i for i in range(12)] + [int(300 * 1.05**i) for i in range(60)]
    told, star = starred(spark, [(i, " ".join([word() for _ in range(n)] + passage)) for i, n in enumerate(sizes)])
    shared = told.select(jaccard.F.explode("home").alias("key")).groupBy("key").count()
    assert shared.agg(jaccard.F.max("count")).head()[0] > 2 * jaccard.FEW and star.count() == 0


def test_common_words_are_no_keys(spark):
    """Texts that share shingles of common words by chance, of which the sample has few twice, have keys of rare words."""
    random.seed(16)
    text = lambda i: " ".join([f"c{random.randrange(12)}" for _ in range(60)] + [f"r{i}x{k}" for k in range(30)])
    told, star = starred(spark, [(i, text(i)) for i in range(400)])
    shared = told.select(jaccard.F.explode("home").alias("key")).groupBy("key").count().where("count > 1")
    assert shared.count() == 0 and star.count() == 0
