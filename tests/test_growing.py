"""A memory that grows by batches: against one run over all, and what each step reads and calls."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions import text
from anamnesis.operators import ingest, models, retrieval, standing, updates
from anamnesis.sources import batches, files
from anamnesis.sources.batches import Batches
from anamnesis.streaming import ingest as stream


@pytest.fixture
def store(spark, tmp_path):
    return Batches(spark, f"{tmp_path}/memory").create()


def incoming(spark, rows):
    return spark.createDataFrame([(u, f"s{a // 4}", r, a, "user", 1683504000000 + a, t) for u, r, a, t in rows], stream.INCOMING)


def story(n, seed=1):
    random.seed(seed)
    names = ["walnut", "table", "crane", "permit", "engine", "quota", "lathe", "linen"]
    say = ["Actually the {} changed to {}.", "We never approved the {}, {} or not.", "The {} invoice arrived with {} boxes.", "Nothing of note, {} {}."]
    return [(f"u{random.choice([0, 0, 0, 1, 2])}", "", i, random.choice(say).format(" ".join(random.sample(names, random.randint(2, 4))), random.randint(1, 99))) for i in range(n)]


def plain(store):
    return store.rows("messages").select("user_id", "session_id", "seq", "role", "ts", "content")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


PAIR = ("user_id", "seq", "n", "side_neg", "side_pos", "via")
LINK = ("user_id", "chain_id", "pos", "seq", "value")


def test_stream_keeps_requests_and_numbers(spark, store, tmp_path):
    told = [(f"u{min(i % 5, 2)}", ["", None][i % 2] if i % 7 == 0 else f"r{i // 2 % 40}", i, f"t{i}") for i in range(200)]
    for k in range(4):
        # Each run brings the last part again.
        part = [r for r in told[max(0, 50 * k - 50) : 50 * k + 50] if r[1] or r[2] >= 50 * k]
        incoming(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream.run(spark.readStream.schema(stream.INCOMING).parquet(f"{tmp_path}/in/part=*"), store, f"{tmp_path}/checkpoint")
    got = store.rows("messages")
    want = ingest.assign_seq(ingest.first_requests(incoming(spark, told)), ["arrival"], F.lit(0))
    assert rows(got, "user_id", "seq", "arrival", "content") == rows(want, "user_id", "seq", "arrival", "content")
    assert got.select("batch").distinct().count() == 4


def test_a_batch_again_changes_nothing(spark, store):
    told = story(60)
    for n in range(3):
        stream.append_batch(store, incoming(spark, told[20 * n : 20 * n + 20]), n)
        standing.scan(store, n)
    kinds = [k for k in batches.SCHEMAS if k != "marks"]
    before = {k: rows(store.stored(k), "*") for k in kinds}
    stream.append_batch(store, incoming(spark, told[20:40]), 1)
    standing.scan(store, 1)
    assert {k: rows(store.stored(k), "*") for k in kinds} == before


@pytest.mark.parametrize("cuts", [[0, 150], [0, 40, 41, 90, 150]])
def test_scans_equal_one(spark, store, cuts):
    told = story(150)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        stream.append_batch(store, incoming(spark, told[a:b]), n)
        standing.scan(store, n)
    last = len(cuts) - 2
    found = updates.events(plain(store))
    chained = updates.chains(found)
    assert rows(standing.chains(store, last), *LINK) == rows(chained, *LINK)
    assert rows(standing.conflicts(store, last), *PAIR) == rows(updates.conflicts(found, chained), *PAIR)
    read = {r.batch: r.n for r in store.rows("scanned").groupBy("batch").agg(F.sum("rows").alias("n")).collect()}
    assert read == {n: b - a for n, (a, b) in enumerate(zip(cuts, cuts[1:]))}


def test_latest_values_over_many_batches(spark, store, monkeypatch):
    monkeypatch.setattr(batches, "WHOLE", 3)
    told = story(24)
    for n in range(8):
        stream.append_batch(store, incoming(spark, told[3 * n : 3 * n + 3]), n)
    assert rows(store.rows("messages"), "user_id", "seq") == rows(ingest.assign_seq(incoming(spark, told), ["arrival"], F.lit(0)), "user_id", "seq")
    assert store.stored("marks").count() >= 2
    read = store.rows("counters", after=store.whole("counters", 7) - 1)
    assert read.select("batch").distinct().count() <= 3 and read.select("user_id").distinct().count() == 3


def test_scores_of_frozen_and_late_units(spark, store):
    told = story(90)
    for n in range(3):
        stream.append_batch(store, incoming(spark, told[30 * n : 30 * n + 30]), n)
        if n == 0:
            assert standing.freeze(store, n).count() == 3
    q = spark.createDataFrame([(1, "u0", "walnut crane zzz approved approved"), (2, "u1", "linen boxes invoice")], "query_id int, user_id string, query string")
    units = ingest.message_units(plain(store))
    upto = {r.user_id: r.upto for r in standing.last_segments(store, 2).collect()}
    frozen = units.join(spark.createDataFrame(list(upto.items()), "user_id string, upto bigint"), "user_id").where("seq < upto")
    index = retrieval.build_index(frozen)
    idf = {(r.user_id, r.term): r.idf for r in index.terms.collect()}
    avgdl = {r.user_id: r.avgdl for r in index.corpus.collect()}
    want = {(r.query_id, r.seq): r.score for r in retrieval.bm25(q, index).collect()}
    for u in units.collect():
        for query_id, user, text in q.collect():
            if user == u.user_id and u.seq >= upto[user]:
                words, mine = u.index_text.lower().replace(":", " ").replace(",", " ").replace(".", " ").split(), [v for (w, _), v in idf.items() if w == user]
                total = 0.0
                for t in text.split():
                    f = words.count(t)
                    total += idf.get((user, t), sum(mine) / len(mine)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avgdl[user]))
                if total:
                    want[query_id, u.seq] = total
    got = {(r.query_id, r.seq): r.score for r in standing.scores(store, q, 2).collect()}
    assert set(got) == {k for k in want} and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # Where too many wait an index is built anew, and then scores are those of all units.
    assert {r.user_id for r in standing.freeze(store, 2, waiting=20).collect()} == {"u0"}
    again = {(r.query_id, r.seq): r.score for r in standing.scores(store, q, 2).where("query_id = 1").collect()}
    exact = {(r.query_id, r.seq): r.score for r in retrieval.bm25(q, retrieval.build_index(units)).where("query_id = 1").collect()}
    assert set(again) == set(exact) and all(abs(again[k] - exact[k]) < 1e-9 for k in exact)


def counting(folder, fail=()):
    """An encoder that leaves a file a text it encodes."""

    def make():
        def encode(texts):
            import os
            import uuid

            if any(f in t for t in texts for f in fail):
                raise ValueError("not now")
            for _ in texts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return np.array([[len(t), t.count("e") + 1] for t in texts], np.float32)

        return encode

    return make


def test_a_unit_is_encoded_once(spark, store, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    told = story(30) + [("u0", "", 30, "  "), ("u0", "", 31, "late word")]
    for n in range(3):
        stream.append_batch(store, incoming(spark, told[11 * n : 11 * n + 11]), n)
        standing.encode(store, n, counting(str(tmp_path / "calls"), ["late"] if n == 2 else []), size=1)
    assert calls() == 30 and store.rows("vectors").count() == 30 and store.stored("pending", after=1).count() == 1
    stream.append_batch(store, incoming(spark, [("u9", "", 40, "more")]), 3)
    standing.encode(store, 3, counting(str(tmp_path / "calls")), size=1)
    assert calls() == 32 and store.rows("vectors").count() == 32 and store.stored("pending", after=2).count() == 0
    q = spark.createDataFrame([(1, "u0", [1.0, 0.0])], "query_id int, user_id string, vector array<float>")
    whole = models.encoded(plain(store), counting(str(tmp_path / "calls"))).where("embedding is not null")
    want = retrieval.dense(q, whole).where("dense_rank <= 5")
    assert rows(standing.vector_ranks(store, q, 3, 5), "seq", "rank") == rows(want, "seq", "dense_rank")


def test_clear_is_seen_by_all_readers(spark, store, tmp_path):
    told = story(60)
    make = counting(str(tmp_path))

    def step(n):
        stream.append_batch(store, incoming(spark, told[20 * n : 20 * n + 20]), n)
        standing.scan(store, n)
        standing.freeze(store, n)
        standing.encode(store, n, make)

    step(0)
    step(1)
    store.clear(spark.createDataFrame([("u0",)], "user_id string"), 1)
    store.clear(spark.createDataFrame([("u7",)], "user_id string"), 1)
    for kind in ("messages", "events", "chained", "leaders", "vectors", "postings", "segments", "counters"):
        assert store.rows(kind).where("user_id = 'u0'").count() == 0 and store.rows(kind).where("user_id = 'u1'").count() > 0
    assert standing.last_segments(store, 1).where("user_id = 'u0'").count() == 0
    step(2)
    later = [r for r in told[40:] if r[0] == "u0"]
    got = rows(store.rows("messages").where("user_id = 'u0'"), "seq", "content")
    assert got == sorted(((i, r[3]) for i, r in enumerate(later)), key=str)
    found = updates.events(plain(store))
    assert rows(standing.chains(store, 2), *LINK) == rows(updates.chains(found), *LINK)
    small = store.compacted(f"{tmp_path}/small")
    for kind in ("messages", "events", "chained", "vectors", "postings", "counters"):
        assert rows(small.stored(kind), "*") == rows(store.rows(kind), "*")


def asking(folder):
    def make():
        def ask(prompt):
            import os
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            if prompt.startswith("!"):
                raise ValueError("no")
            return prompt.upper()

        return ask

    return make


def test_memo_asks_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = lambda: len(list((tmp_path / "calls").iterdir()))
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "!c"), (5, "d")], "id int, prompt string")
    for n, want in ((1, 4), (2, 5)):
        said = models.remembered(prompts, f"{tmp_path}/log", asking(str(tmp_path / "calls")), tries=1, wait=0)
        assert rows(said, "id", "answer") == rows(said, "id", "answer") == [(1, "A"), (2, "B"), (3, "A"), (4, None), (5, "D")]
        assert calls() == want  # the second run only tries again what failed


def test_a_broken_run_resumes(spark, tmp_path):
    todo = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id bigint, text string")
    path, broken = f"{tmp_path}/out", []

    def work(part):
        broken.append(1)
        if len(broken) == 3:
            raise RuntimeError("lost")
        return part.select("id", F.upper("text").alias("answer"), F.when((F.col("id") % 10 == 0) & (len(broken) < 6), "failed").alias("error"))

    with pytest.raises(RuntimeError):
        files.append_resumable(todo, path, work, slices=5)
    half = files.resumed_rows(spark, path)
    assert 0 < half.count() < 60 and half.count() == half.select("id").distinct().count()
    files.append_resumable(todo, path, work, slices=5)
    files.append_resumable(todo, path, work, slices=5)
    assert rows(files.resumed_rows(spark, path), "id", "answer", "error") == sorted(((i, f"P{i}", None) for i in range(60)), key=str)
    assert files.append_resumable(todo, path, work, slices=5) == 0


def test_cards_follow_their_session(spark, tmp_path):
    m = spark.createDataFrame([("u", "s1", 0, "user", 1683504000000, "hello"), ("u", "s2", 1, "user", 1683504000000, "fail")], "user_id string, session_id string, seq bigint, role string, ts bigint, content string")

    def make():
        def ask(prompt):
            if "fail" in prompt:
                raise ValueError("no")
            return "Cards:\r\n[2023] A: x -\n - [no] y\n\t[2024] B: z\n"

        return ask

    got = ingest.card_units(m, f"{tmp_path}/log", make, "Cards of: ", tries=1, wait=0).orderBy("session_id", "place").collect()
    assert [(r.session_id, r.place, r.is_card) for r in got] == [("s1", 0, False), ("s1", 1, True), ("s1", 2, True), ("s2", 0, False)]
    assert got[0].content.endswith("user: hello") and [got[1].content, got[1].ts] == ["[2023] A: x", 1683504000000] and got[2].content.strip() == "[2024] B: z"


def test_requests_seen_need_no_python_and_the_first_message_counts(spark, store, tmp_path):
    """Of a request's messages in one micro-batch the first by arrival counts, in any order of files; no task runs Python for them."""
    told = [("u0", "r1", 5, "late"), ("u0", "r1", 2, "early"), ("u0", "r2", 7, "b"), ("u0", None, 9, "c"), ("u0", "", 8, "d")]
    incoming(spark, told).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    source = spark.readStream.schema(stream.INCOMING).parquet(f"{tmp_path}/in/part=*")
    stream.run(source, store, f"{tmp_path}/checkpoint")
    incoming(spark, [("u0", "r1", 1, "again"), ("u0", "r3", 11, "e")]).coalesce(1).write.parquet(f"{tmp_path}/in/part=1")
    stream.run(source, store, f"{tmp_path}/checkpoint")
    assert rows(store.rows("messages"), "seq", "arrival", "content") == [(0, 2, "early"), (1, 7, "b"), (2, 8, "d"), (3, 9, "c"), (4, 11, "e")]
    plan = stream.with_new_requests(spark.createDataFrame([], stream.INCOMING), store.stored("cleared"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_sentence_is_searched_for_words_once(spark):
    """Filters on the words and values of sentences read them, and don't find them again."""
    from anamnesis.functions import fixed

    units = incoming(spark, story(5)).withColumn("seq", F.col("arrival"))
    plan = updates.updates(updates.events(units))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(fixed.TOPIC_WORD) == 1


def test_a_scan_writes_its_tables_alone(spark, store):
    """No step of adding and scanning a batch writes the same rows a second time beside its tables."""
    stream.append_batch(store, incoming(spark, story(20)), 0)
    standing.scan(store, 0)
    assert not os.path.exists(f"{store.path}/_held")


def test_words_are_counted_where_their_unit_is(spark):
    units = spark.createDataFrame([("u0", 0, "a b a"), ("u0", 1, "")], "user_id string, seq bigint, index_text string")
    postings = retrieval.postings_of(units)
    assert rows(postings, "seq", "term", "tf", "dl") == [(0, "a", 2, 3), (0, "b", 1, 3)]
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", postings._jdf.queryExecution().executedPlan().toString())
    assert moved and not any("term" in by for by in moved)


def test_a_unit_is_counted_in_its_row(spark):
    """Words of a unit are counted without a table of all units' words."""
    units = spark.createDataFrame([("u0", 0, "b a b c a b"), ("u0", 1, ""), ("u1", 0, "z")], "user_id string, seq bigint, index_text string")
    postings = retrieval.postings_of(units)
    assert rows(postings, "user_id", "seq", "term", "tf", "dl") == [("u0", 0, "a", 2, 6), ("u0", 0, "b", 3, 6), ("u0", 0, "c", 1, 6), ("u1", 0, "z", 1, 1)]
    assert "Aggregate" not in postings._jdf.queryExecution().executedPlan().toString()


def test_latest_assertives_are_found_by_parts(spark, monkeypatch):
    """Only the parts that hold a user's latest assertives are put in order, not all of them."""
    monkeypatch.setattr(updates, "LATE", 7)
    found = spark.createDataFrame([(f"u{i % 2}", i // 2 * (1 + i % 2), n, False, ["1"], ["a", "b", "c"]) for i in range(101) for n in range(1 + i % 3)], "user_id string, seq bigint, n int, negated boolean, values array<string>, topic array<string>")
    got = updates.assertives(found, keep=10)
    told = sorted(((r.user_id, r.seq, r.n) for r in found.collect()), reverse=True)
    want = [x for u in ("u0", "u1") for x in sorted([t for t in told if t[0] == u][:10])]
    assert rows(got, "user_id", "seq", "n") == want
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()
    assert updates.assertives(found, keep=1000).count() == found.count()


def test_a_compacted_store_is_written_without_a_sort_by_batch(spark, store, tmp_path, monkeypatch):
    stream.append_batch(store, incoming(spark, story(9)), 0)
    seen, plain = [], Batches.rows
    monkeypatch.setattr(Batches, "rows", lambda self, *a, **k: (seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")), plain(self, *a, **k))[1])
    out = store.compacted(f"{tmp_path}/compacted")
    assert set(seen) == {str(batches.OPEN)} and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert out.rows("messages").count() == 9


def test_sentences_are_cut_without_a_pattern_compiled_for_each_row(spark):
    told = spark.createDataFrame([(" One.  Two!\n\n three \n.Four? ",), (None,), ("",)], "t string").select(text.sentences(F.col("t")).alias("s"))
    assert [r.s for r in told.collect()] == [["One.", "Two!", "three", ".Four?"], None, []]
    assert "split(t" not in told._jdf.queryExecution().optimizedPlan().toString()


def early(n=2010):
    """An assertive, then more on another topic than the reference keeps, then what contradicts the first."""
    lines = ["The walnut crane permit invoice arrived with 7 boxes."] + ["The turbine lathe warranty invoice came with 9 boxes."] * n + ["We never approved the walnut crane permit."]
    return [("u0", "", i, t) for i, t in enumerate(lines)]


def test_no_assertive_is_too_early_for_a_pair(spark):
    told = early()
    found = updates.events(incoming(spark, told).withColumn("seq", F.col("arrival")))
    want = [("u0", len(told) - 1, 0, told[-1][3], told[0][3], "assertive")]
    assert rows(updates.conflicts(found, updates.chains(found)), *PAIR) == want
    assert updates.conflicts(found, updates.chains(found), keep=2000).count() == 0


def test_no_assertive_of_an_earlier_scan_is_too_early_for_a_pair(spark, store):
    told = early()
    for n, part in enumerate((told[:1000], told[1000:])):
        stream.append_batch(store, incoming(spark, part), n)
        standing.scan(store, n)
    assert rows(standing.conflicts(store, 1), *PAIR) == [("u0", len(told) - 1, 0, told[-1][3], told[0][3], "assertive")]


def test_a_search_shows_the_conflict_with_an_early_assertive(spark):
    told = incoming(spark, early())
    messages = told.select("user_id", "session_id", F.col("arrival").alias("seq"), "role", "ts", "content")
    asked = spark.createDataFrame([(1, "u0", "Who approved the walnut crane permit today?")], "query_id int, user_id string, query string")
    from anamnesis.plans.search import Options, search

    got = {r.id: r.content for r in search(asked, messages, Options(top_k=5)).collect()}
    assert len(got) == 5 and "arrived with 7 boxes" in got["conflict-0"]
