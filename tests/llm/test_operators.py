"""Each operator on odd rows and on empty tables, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from . import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import lines, lm, mixing, pieces, pii, quality, rules, simhash
from anamnesis.llm.queries import piece_model


def by_id(found):
    return {r.doc_id: r for r in found if r.doc_id is not None}


def test_pii(documents, rows):
    found = pii.find(documents).collect()
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        if doc is not None:
            spans, r = brute.base_spans(text), by_id(found)[doc]
            assert r.base_sha256 == brute.sha(brute.spans_text(spans)) and r.spans == brute.spans_text(spans)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


def test_pii_random_texts(spark, tmp_path):
    random.seed(5)
    bits = ["a", "b.", "@", "x-", ".", "1", "22", "255", "4111 1111 1111 1111", "+1 (555) 123-4567", "256", "-", " ", "\n", "é", "😀", "_", "%", "(", "0", "+"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 30)))) for i in range(400)] + [(1000, "1.2.3.4 " * 1500 + "é a@b.co")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/t")
    found = by_id(pii.find(spark.read.parquet(f"{tmp_path}/t")).collect())
    for doc, text in rows:
        assert found[doc].base_sha256 == brute.sha(brute.spans_text(brute.base_spans(text)))


def test_pii_learns_contexts(spark, tmp_path):
    rows = [(i, f"hello there reach me at user{i}@mail.example.com for more of these things") for i in range(40)]
    rows += [(100 + i, f"foo bar baz reach me at admin{i}@localhost for more of these things") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    found = by_id(pii.find(docs).collect())
    assert all(found[100 + i].n_email == 0 and found[100 + i].spans.startswith("email:24:") for i in range(20))
    assert all("<EMAIL>" in r.text and "@" not in r.text for r in pii.redact(docs).collect())


def test_redact_keeps_the_rest(documents, rows, spark):
    out = pii.redact(documents)
    assert out.columns == documents.columns and out.count() == len(rows)
    assert Counter((r.doc_id, *tuple(r)[2:]) for r in out.collect()) == Counter((r[0], *r[2:]) for r in rows)
    clash = spark.createDataFrame([(1, "mail me@example.com", "a", 5, "b")], "doc_id bigint, text string, same string, more int, d string")
    assert [tuple(r) for r in pii.redact(clash).collect()] == [(1, "mail <EMAIL>", "a", 5, "b")]
    got = by_id(out.collect())
    assert got[9].text == "mail <EMAIL> or <PHONE>, <IP>" and got[1].text is None and got[4].text == "x" * 200_000


def test_quality(documents, labels, rows):
    found = quality.classify(documents, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)


def test_quality_packs_counts():
    for buckets in ([], [0], [5, 5, 9, 262143], [7] * 300 + [8] * 70000):
        found, counts = quality.unpacked(*quality.packed(np.array(buckets, np.int64)))
        assert dict(zip(found.tolist(), counts.tolist())) == Counter(buckets) and found.tolist() == sorted(set(buckets))


def test_quality_without_labels(documents, labels):
    assert {r.score for r in quality.classify(documents, labels.where("false")).collect()} == {0.5}


def test_quality_learns(spark):
    random.seed(1)
    good, bad = ["river", "stone", "light", "table"], ["zzq", "###", "qxz!!", "vvv"]
    rows = [(i, " ".join(random.choices(good if i % 2 else bad, k=20)), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    found = quality.classify(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    held = [r for r in found.collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95


def test_score_is_the_mean_of_the_vectors():
    import numpy as np

    text = "some words here, some more"
    f = quality.features(text, 10)
    assert len(f) > 20 and f.max() < 1024
    gains = np.random.default_rng(1).normal(size=1024)
    assert np.isclose(gains[f].mean(), sum(gains[b] * n for b, n in Counter(f.tolist()).items()) / len(f))


def test_pieces(documents, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    found = pieces.encoded(documents, piece_model()).collect()
    assert len(found) == len(rows)
    want = Counter()
    for doc, text, *_ in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        want[doc, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in found) == want


def test_pieces_random_texts():
    import numpy as np
    import sentencepiece

    sp, p = sentencepiece.SentencePieceProcessor(model_file=piece_model()), pieces.Pieces(piece_model())
    random.seed(1)
    bits = ["a", "b", "th", "e", " ", "  ", "\n", "é", "▁", "   ", "梦", "Ⅷ", "1", "==", ".", "the ", "in", "\t", "\r\n", "😀", "-----"]
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        ids = sp.encode(text)
        assert np.frombuffer(p.encode(text), "<u4").tolist() == ids and p.decode([1, *ids, 2]) == sp.decode([1, *ids, 2])
        odd = [random.randrange(3, 259) if random.random() < 0.5 else random.randrange(32000) for _ in range(6)]
        assert p.decode(odd) == sp.decode(odd)


def test_rules(documents, labels, rows):
    found = rules.judge(documents, labels).collect()
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        if doc is not None:
            r, c = by_id(found)[doc], brute.counts(text)
            assert tuple(r)[1:6] == c and r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.base_failed and r.kept)


def test_rules_are_learned(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(300):
        w = random.sample(words, 80)
        rows.append((i, " ".join(x + "$" * 3 for x in w) if i % 3 == 0 else " ".join(w), int(i % 3 != 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    found = rules.judge(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in found)


def test_lm(documents, rows):
    found = lm.score(documents).collect()
    assert len(found) == len(rows)
    words = {i: [w for w in (r[1] or "").encode().lower().split()] + [b""] for i, r in enumerate(rows)}
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = c.total(), len(c)
    want = sorted((rows[i][0] or -1, held[i], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3)) for i, w in words.items())
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found)
    assert got == want and all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_lm_counts_never_fall_short(spark):
    import numpy as np

    random.seed(3)
    rows = [(i, " ".join(random.choices(["a", "b", "cc", "ddd", f"x{i}"], k=30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = lm.train(docs, 1000, 100)
    true = Counter()
    for one, two, _ in lm.ngrams(text for _, text in rows):
        true.update(one.tolist() + two.tolist())
    keys = np.array(list(true), np.uint64)
    got, least = model.counts(keys), lm.COUNT[1 + np.floor(np.log2(np.array(list(true.values())))).astype(int)]
    assert (got >= least).all() and (got > least).mean() < 0.1


def test_lm_scores_alike_beyond_the_broadcast(spark, documents, monkeypatch):
    random.seed(4)
    more = [(1000 + i, " ".join(random.choices(["a", "b", "cc", "ddd", f"x{i}", f"y{i % 7}"], k=60))) for i in range(300)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = []
    for most, shard in ((lm.MOST_BITS, lm.SHARD_BITS), (1 << 10, 1 << 12), (1 << 10, 1 << 30)):
        monkeypatch.setattr(lm, "MOST_BITS", most)
        monkeypatch.setattr(lm, "SHARD_BITS", shard)
        monkeypatch.setattr(lm, "TOGETHER", 5000)
        got.append(Counter((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect()))
    assert got[0] == got[1] == got[2] and got[0].total() == 315


def test_lm_goes_one_way_at_any_size(documents, monkeypatch):
    """Nothing is written in between, no n-grams go to the driver, and the plan doesn't turn with the filter's size."""
    from anamnesis.llm.common import materialize

    written, plans = [], []
    monkeypatch.setattr(lm, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    for most in (lm.MOST_BITS, 1 << 10):
        monkeypatch.setattr(lm, "MOST_BITS", most)
        plan = lm.score(documents)._jdf.queryExecution().executedPlan().toString()
        plans.append(Counter(re.findall(r"Exchange|FlatMapGroupsInArrow|FlatMapCoGroupsInArrow|MapInArrow", plan)))
    assert not written and plans[0] == plans[1] and plans[0]["FlatMapCoGroupsInArrow"] == 1


def test_lm_sends_in_proportion_to_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOGETHER", 250_000)
    monkeypatch.setattr(lm, "SHARD_BITS", 1 << 17)
    random.seed(8)
    texts = [" ".join(f"w{random.randrange(100_000)}" for _ in range(400)) for _ in range(1600)]
    sent = []
    for many in (400, 1600):
        docs = spark.createDataFrame(list(enumerate(texts[:many])), "doc_id bigint, text string")
        sizes = lm.Sizes(docs)
        cells = lm.asked(lm.dealt(docs, sizes), sizes)
        there, back = (df.select(sum(F.octet_length(c) for c in columns).alias("x")).agg(F.sum("x")).first()[0] for df, columns in ((cells, ("words", "times", "pairs", "both")), (lm.answered(cells, sizes), ("own", "both", "counts"))))
        sent.append((there + back) / sum(map(len, texts[:many])))
    assert sent[1] < 1.1 * sent[0]


def test_lm_score_by_plain_python(documents, rows):
    """The filter of so small a table has no errors: scores are those of exact counts, by levels."""
    texts = [[w for w in (r[1] or "").encode().lower().split()] + [None] for r in rows]
    seen = Counter()
    for r, ws in zip(rows, texts):
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10:
            seen.update(ws)
            seen.update(zip([None, *ws], ws))
    n, v = sum(c for w, c in seen.items() if not isinstance(w, tuple)), sum(not isinstance(w, tuple) for w in seen)

    def level(x):
        return lm.COUNT[seen[x].bit_length()]

    def value(before, w):
        own, context = level(w), level(before)
        both = min(level((before, w)), max(own, 1))
        return math.log10((both + lm.PRIOR * (own + 0.1) / (n + 0.1 * (v + 1))) / (max(context, both) + lm.PRIOR))

    want = sorted((r[0] or -1, round(sum(map(value, [None, *ws], ws)), 4)) for r, ws in zip(rows, texts))
    assert sorted((r.doc_id or -1, round(r.score, 4)) for r in lm.score(documents).collect()) == want


def test_lm_whole_model_has_a_bound(documents, monkeypatch):
    monkeypatch.setattr(lm, "MOST_BITS", 1 << 10)
    with pytest.raises(ValueError):
        lm.train(documents.select("doc_id", "text"), 1000, 100)


def test_simhash(documents, rows):
    found = simhash.near_duplicates(documents).collect()
    prints = [(r[0], brute.fingerprint(r[1])) for r in rows]
    want = sorted((d or -1, f"{f:016x}", c) for (d, f), c in zip(prints, brute.least_reachable(prints)))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in found) == want


def jaccard(a, b, size=5):
    def cut(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_first_of_each(documents, rows):
    out = simhash.first_of_each(documents)
    assert out.columns == documents.columns
    kept = out.collect()
    # Null and empty texts are one group, whose least id is 1; 8 is like 6 and 7.
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, 6, 9, 10, 11, 12, None])
    for r in kept:
        assert tuple(r) in {tuple(x) for x in rows}


def test_first_of_each_tells_rows_apart(spark, monkeypatch):
    prose = " ".join(f"w{i}" for i in range(100))
    rows = [(1, prose, 1), (2, prose, 2), (2, "quite another text", 3), (3, "one of two", 4), (3, "and two", 5), (3, "and two", 7), (3, "and two", 6), (None, prose, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, same int")
    for most in (simhash.BROADCAST, 1):
        monkeypatch.setattr(simhash, "BROADCAST", most)
        assert sorted(r.same for r in simhash.first_of_each(docs).collect()) == [1, 3, 4, 5]


def test_near_copies_are_found(spark):
    random.seed(8)
    words = [f"v{i}" for i in range(5000)]
    rows, near = [], 0
    for i in range(150):
        base = random.choices(words, k=200)
        copy = list(base)
        for at in random.sample(range(200), 3):
            copy[at] = random.choice(words)
        near += jaccard(" ".join(base), " ".join(copy)) >= 0.8
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    kept = [r.doc_id for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert all(2 * i in kept for i in range(150)) and near > 140 and 300 - len(kept) >= 0.9 * near


def test_simhash_hot_segment_and_large_group(spark):
    random.seed(5)
    low = random.getrandbits(26)
    strangers = [low | random.getrandbits(38) << 26 for _ in range(1000)]
    base, near = random.getrandbits(64), []
    for _ in range(2000):
        f = base
        for bit in random.sample(range(20), random.randint(0, 6)):
            f ^= 1 << 3 * bit
        near.append(f)
    table = [(i, f) for i, f in enumerate(strangers + near)]
    random.shuffle(table)
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame([(d, f - (f >> 63 << 64)) for d, f in table], "doc_id bigint, fp bigint")).collect()}
    assert [got[d] for d, _ in table] == brute.least_reachable(table)


def test_simhash_links_none_lost(spark):
    random.seed(3)
    prints = []
    for _ in range(20):
        base = random.getrandbits(64)
        for _ in range(random.choice([1, 3, 40])):
            f = base
            for _ in range(random.randint(0, 7)):
                f ^= 1 << random.randrange(64)
            prints.append(f)
    shared = random.getrandbits(26)
    prints += [shared | random.getrandbits(12) << 26 | random.getrandbits(4) << 60 for _ in range(200)]
    table = [(1000 + i, f) for i, f in enumerate(prints)]
    signed = [(d, f - (f >> 63 << 64)) for d, f in table]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(signed, "doc_id bigint, fp bigint")).collect()}
    assert [got[d] for d, _ in table] == brute.least_reachable(table)


def test_lines(documents, rows):
    found = lines.dedup(documents).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for (doc, text, *_), spans in zip(order, brute.repeated_spans([r[:2] for r in order], lines.units, lines.LEAST)):
        want[doc, tuple(spans)] += 1
    assert Counter((r.doc_id, tuple(tuple(x) for x in r.removed)) for r in found) == want
    for r in found:
        if r.removed and r.doc_id not in (None, 6):
            text = next(x[1] for x in rows if x[0] == r.doc_id)
            for s, e in reversed([tuple(x) for x in r.removed]):
                text = text[:s] + text[e:]
            assert r.text == text


def test_short_lines_and_copies(spark):
    apart = "One sentence here that no other text has, with rather more than twenty words in it so that a run would go too, and more."
    rows = [(1, "Licence two\nfirst text. Yes.\n"), (2, "second text\n  licence, TWO!\nYes. But third\nYes.\n"), (3, "Yes.\nlicence two"), (4, apart), (4, apart)]
    found = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert found == [(1, rows[0][1], 0), (2, "second text\n\nYes. But third\nYes.\n", 1), (3, "", 1), (4, "", 1), (4, apart, 0)]


def test_mixing(documents, rows):
    found = mixing.mix(documents).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    for source, size in sizes.items():
        mine = [r for r in found if r.source == source]
        assert {r.source_size for r in mine} == {size} and all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target + 20
    again = mixing.mix(documents).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    out = mixing.mixed(documents)
    assert out.columns == documents.columns and max(Counter((r.doc_id, r.source) for r in out.collect() if r.doc_id != 6).values()) <= 2


def test_mixing_takes_small_sources(spark):
    rows = [(i, "w " * 100, "big") for i in range(3000)] + [(5000 + i, "w " * n, s) for s, n in (("c", 3), ("d", 40), ("e", 700)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for slots in (1 << 8, 1 << 6):
        found = mixing.mix(docs, slots=slots).groupBy("source", "target").sum("taken").collect()
        assert len(found) == 4 and all(abs(r["sum(taken)"] - r.target) <= 0.02 * r.target + 2 for r in found if r.source != "big")
    assert {r.source for r in mixing.mixed(docs, slots=1 << 6).collect()} == {"big", "c", "d", "e"}


def test_mixing_rows_alike(spark):
    rows = [(1, "a b c", "s", k % 7) for k in range(500)] + [(i, "d e", "s", 0) for i in range(2, 50)] + [(i, "f", None, 0) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key int")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    for source in ("s", None):
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target + 2
    once, twice = (Counter(map(tuple, mixing.mixed(docs).collect())) for _ in range(2))
    assert once == twice and max(n for x, n in once.items() if x[0] != 1) <= 2


def test_lines_many_equal_rows(spark):
    text = "one line\nand another\n"
    found = lines.dedup(spark.createDataFrame([(1, text)] * 3000, "doc_id bigint, text string")).collect()
    assert Counter(r.text for r in found) == {text: 1, "": 2999}


def test_targets():
    got = mixing.targets([("b", 100), (None, 50), ("a", 10)])
    assert [g[0] for g in got] == ["a", "b", None] and got[0][3] == 20.0
    assert sum(g[3] for g in got) == pytest.approx(240.0) and all(g[3] <= 2 * g[1] for g in got)
    assert [g[3] for g in mixing.targets([("a", 0), ("b", 4)])] == [0.0, 6.0] and mixing.targets([]) == []


def test_empty_tables(nothing, labels):
    for found in (pii.find(nothing), pii.redact(nothing), quality.classify(nothing, labels), pieces.encoded(nothing, piece_model()), rules.judge(nothing, labels), lm.score(nothing), simhash.near_duplicates(nothing), lines.dedup(nothing), mixing.mix(nothing), mixing.mixed(nothing)):
        assert found.count() == 0


def test_lm_scores_do_not_depend_on_partitions(spark):
    random.seed(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(random.paretovariate(1)) % 500}" for _ in range(80))) for i in range(300)], "doc_id bigint, text string")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.doc_id: r.score for r in lm.score(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(abs(got[0][d] - got[1][d]) < 1e-9 for d in got[0]) and len(got[0]) == 300


def test_ascending_hashes_are_sent_as_gaps():
    from anamnesis.llm import lm

    for keys in (np.zeros(0, np.uint64), np.array([0, 0, 7, 1 << 38], np.uint64), np.sort(np.random.default_rng(1).integers(0, 1 << 32, 25_000).astype(np.uint64))):
        packed = lm.slim(keys)
        assert (lm.unslim(packed) == keys).all()
    assert len(packed) < 2.9 * len(keys)
