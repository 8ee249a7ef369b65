"""Phrases against plain Python, on odd rows and with both ways of joining."""

import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pytest

from anamnesis.llm import phrases


def brute(rows, least, most, cover=50):
    low = str.maketrans(ascii_uppercase, ascii_lowercase)
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in found.items():
        if len(p) == 3:
            covered |= {(lang, q) for q in (p[:2], p[1:]) if 100 * a >= cover * f[lang, q]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang in {x[0] for x in out}:
        for i, (_, s, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:most]):
            ranked.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(ranked)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    words = ["a", "B", "the", "é", "of", "x|y", " ", "THE", "q", "z"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!", " "]
    out = [(i, "".join(random.choice(words[: 3 + i % 8]) + random.choice(ends) for _ in range(random.randint(0, 60))), random.choice(["en", "de", None, "und"])) for i in range(300)]
    return out + [(1000, None, "en"), (None, "", "en"), (1001, " \t.,", None), (1002, "only here once", "xx"), (1004, "a b a b a b", "e\tn "), (1005, "a b", ""), (1003, "new york city " * 20_000, "en")] + [(7, "same old row again", "fr")] * 12


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_phrases(spark, rows, bound, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST", bound)
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], "doc_id bigint, text string, lang string, phrase string, w0 int").repartition(3)
    for least, most in ((10, 2000), (2, 7)):
        got = phrases.collocations(docs, least=least, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, most)


def test_products_beyond_64_bits(spark):
    table = lambda *r: spark.createDataFrame(r, "lang string, w0 string, f bigint")
    pair = spark.createDataFrame([("en", "a", "b", 3 * 10**14)], "lang string, w0 string, w1 string, f bigint")
    got = phrases.scored([table(("en", "a", 4 * 10**14), ("en", "b", 3 * 10**14 + 7)), pair], 2).collect()
    assert [r.score for r in got] == [10**6 * 9 * 10**28 // (4 * 10**14 * (3 * 10**14 + 7))]


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
