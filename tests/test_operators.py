"""Memory operators on small tables."""

import random

from pyspark.sql import functions as F

from anamnesis.operators import evaluation, ingest, retrieval, updates
from anamnesis.plans.search import Options, search


def facts(spark, rows):
    return spark.createDataFrame([("u", "s", i, "user", 1683504000000 + i, t) for i, t in enumerate(rows)], "user_id string, session_id string, seq bigint, role string, ts bigint, content string")


def test_requests_count_once(spark):
    rows = [("u", "r", 1, "a"), ("u", "r", 2, "b"), ("v", "r", 3, "c"), ("u", "", 4, "d"), ("u", "", 5, "d"), ("u", None, 6, "e")]
    out = ingest.assign_seq(ingest.first_requests(spark.createDataFrame(rows, "user_id string, request_id string, arrival bigint, content string")), ["arrival"], F.floor(F.col("arrival") / 3))
    assert sorted((r.user_id, r.seq, r.content) for r in out.collect()) == [("u", 0, "a"), ("u", 1, "d"), ("u", 2, "d"), ("u", 3, "e"), ("v", 0, "c")]


def test_windows_and_packing(spark):
    m = facts(spark, ["word"] * 25)
    assert sorted(r.start for r in ingest.window_units(m).collect()) == [0, 10, 20]
    assert sorted((r.chunk, r.n) for r in ingest.packed_units(m, ["user_id"]).collect()) == [(0, 20), (1, 5)]
    long = facts(spark, ["a", "w " * 2500, "b"])
    assert sorted((r.chunk, r.n) for r in ingest.packed_units(long, ["user_id"]).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_neighbours_keep_the_first_pick(spark):
    units = facts(spark, ["x"] * 10).select("user_id", "session_id", "seq")
    ranking = spark.createDataFrame([(1, "u", "s", 5, 0.9, 1), (1, "u", "s", 4, 0.8, 2)], "query_id int, user_id string, session_id string, seq bigint, score double, rank int")
    picks = retrieval.expand(ranking, units).orderBy("pick").collect()
    assert [(r.seq, r.score) for r in picks] == [(5, 0.9), (4, 0.0), (6, 0.0), (3, 0.0)]


def fold(events):
    leaders, out = [], []
    for topic in events:
        shares = [(len(set(topic) & set(x)) / min(len(topic), len(x)), -i) for i, x in enumerate(leaders)]
        best = max(shares, default=(0, 0))
        if best[0] >= 0.5:
            out.append(-best[1])
        else:
            leaders.append(topic)
            out.append(len(leaders) - 1)
    return out


def test_chains_are_the_sequential_fold(spark):
    random.seed(4)
    names = ["walnut", "table", "crane", "permit", "engine", "quota", "lathe", "linen"]
    topics = [random.sample(names, random.randint(2, 4)) for _ in range(80)]
    m = facts(spark, [f"Actually the {' '.join(t)} changed to 5." for t in topics])
    got = updates.chains(updates.events(m)).orderBy("seq").collect()
    assert [r.chain_id for r in got] == fold([[w for w in t] for t in topics])
    ids = [r.chain_id for r in got]
    assert [r.pos for r in got] == [ids[:i].count(c) for i, c in enumerate(ids)]


def test_chains_of_many_users(spark):
    random.seed(5)
    names = ["walnut", "table", "crane", "permit", "engine", "quota", "lathe", "linen", "voucher", "turbine"]
    said = [(random.choice(["u", "v", None]), i, random.sample(names, random.randint(2, 6))) for i in range(300)]
    m = spark.createDataFrame([(u, "s", i * 50_000, "user", i, f"Actually the {' '.join(t)} changed to 5.") for u, i, t in said], "user_id string, session_id string, seq bigint, role string, ts bigint, content string")
    got = updates.chains(updates.events(m)).collect()
    assert len(got) == len(said)
    for user in ("u", "v", None):
        rows = sorted((r for r in got if r.user_id == user), key=lambda r: r.seq)
        mine = [(i * 50_000, t) for u, i, t in said if u == user]
        ids = [r.chain_id for r in rows]
        assert [r.seq for r in rows] == [i for i, _ in mine] and ids == fold([t for _, t in mine])
        assert [r.pos for r in rows] == [ids[:k].count(c) for k, c in enumerate(ids)]
    assert updates.chains(updates.events(m.limit(0))).count() == 0


def test_cards(spark):
    m = facts(spark, ["Actually the walnut table catalog changed to 10 today.", "We never approved the walnut table catalog proposal.", "Actually the walnut table catalog changed to 12 today."])
    q = spark.createDataFrame([(1, "u", "What is the current walnut table catalog?"), (2, "u", "What is the current walnut table catalog proposal?"), (3, "u", "When did the walnut table catalog change?"), (4, "nobody", "x")], "query_id int, user_id string, query string")
    out = search(q, m, Options(top_k=3)).collect()
    ids = {k: [r.id for r in sorted(out, key=lambda r: r.pos) if r.query_id == k] for k in (1, 2, 3, 4)}
    assert ids[1][0] == "upd-2" and ids[2][0] == "conflict-0" and ids[3][0].startswith("mem-") and ids[4] == []
    assert all(len(v) <= 3 for v in ids.values())


def test_fusion_and_users_apart(spark):
    units = spark.createDataFrame([("u", "s", 0, "blue kayak", [1.0, 0.0]), ("u", "s", 1, "red car", [0.0, 1.0]), ("u", "s", 2, "green hat", [-1.0, 0.0]), ("v", "s", 0, "blue kayak", [1.0, 0.0])], "user_id string, session_id string, seq bigint, index_text string, embedding array<double>")
    q = spark.createDataFrame([(1, "u", "kayak", [1.0, 0.0])], "query_id int, user_id string, query string, vector array<double>")
    got = retrieval.fused(q, units, retrieval.build_index(units)).orderBy("rank").collect()
    assert [r.seq for r in got] == [0, 1, 2] and round(got[0].score, 5) == 0.02459 and round(got[1].score, 6) == round(1 / 62, 6)


def test_order_metrics(spark):
    rows = [([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [3, 2, 1]), ([1], [1]), ([1, 2], [])]
    df = evaluation.event_order(spark.createDataFrame(rows, "reference array<int>, system array<int>"))
    assert [(r.f1, r.tau_norm) for r in df.collect()] == [(1.0, 1.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)]


def test_recall(spark):
    df = spark.createDataFrame([("blue kayak kayak", "kayak trip"), ("a", "b")], "g string, c string").select(evaluation.evidence_recall(F.col("g"), F.col("c")).alias("r"))
    assert [(round(r.r.recall, 4), r.r.n) for r in df.collect()] == [(0.6667, 3), (1.0, 0)]


def test_timeline_and_traits(spark):
    from anamnesis.operators import cards

    m = facts(spark, ["The walnut table came.", "Nothing of note here.", "A walnut chair " + "x" * 400 + " end"]).withColumn("ts", F.col("ts") + F.col("seq") * 20 * 86400000)
    q = spark.createDataFrame([(1, "u", "How many days between the walnut things?"), (2, "u", "Tell me about walnut"), (3, "u", "How long ago was the walnut bought?")], "query_id int, user_id string, query string")
    picked = q.join(m, "user_id").select("query_id", "user_id", "seq", F.col("seq").alias("pos"))
    got = {r.query_id: r.content for r in cards.timeline(q, picked, m).collect()}
    assert set(got) == {1, 3}
    lines = got[1].split("\n")
    assert lines[0].startswith("[TIMELINE") and lines[1] == "(1) [08 May 2023] The walnut table came." and lines[2] == "(2) [17 Jun 2023] (+40d) A walnut chair..."
    assert "[40d (~5w) before latest] The walnut" in got[3] and got[3].endswith("[ANCHOR | latest activity date in memory: 17 Jun 2023]")
    traits = spark.createDataFrame([("u", 1, "[X] "), ("u", 2, "[LIKES] tea"), ("u", 3, "[likes] TEA"), ("u", 4, "[HABIT] runs")], "user_id string, pos int, line string")
    asked = spark.createDataFrame([(1, "u", "Plan a day"), (2, "u", "Which doctor?")], "query_id int, user_id string, query string")
    assert {r.query_id: r.content.split("\n")[1:] for r in cards.persona(asked, traits).collect()} == {1: ["- [LIKES] tea", "- [HABIT] runs"]}


def test_reports(spark):
    from anamnesis.operators import reports

    judged = spark.createDataFrame([("a", True, 1.0, None), ("b", False, None, "failed"), ("c", False, 0.5, "")], "id string, is_correct boolean, score double, error string")
    inputs = spark.createDataFrame([("a", 0, "old", "x"), ("a", 1, "new", "in May")], "id string, at int, category string, gold string")
    answers = spark.createDataFrame([("b", 0, "two days ago")], "id string, at int, answer string")
    rows = reports.with_inputs(judged, inputs, answers)
    assert sorted((r.id, r.category, r.gold, r.answer) for r in rows.collect()) == [("a", "new", "in May", ""), ("b", "?", "", "two days ago"), ("c", "?", "", "")]
    got = {(r.kind, r.name): (r.right, r.n) for r in reports.score_sets(rows).collect()}
    assert got == {("category", "new"): (1, 1), ("category", "?"): (0, 2), ("timed", "time"): (1, 1), ("timed", "plain"): (0, 2), ("relative", "relative"): (0, 1), ("relative", "fixed"): (1, 2), ("total", "TOTAL"): (1, 3)}
    assert sorted((r.category, r.n, r.errors, r.total) for r in reports.group_totals(rows, "category").collect()) == [("?", 2, 1, 25.0), ("new", 1, 0, 100.0)]
    means = spark.createDataFrame([([1.0, 0.5],), ([],)], "s array<double>").select(reports.rubric_mean(F.col("s")).alias("m"))
    assert [r.m for r in means.collect()] == [0.75, None]


def test_a_conflict_is_picked_first_and_tested_then(spark):
    words = ["walnut", "crane", "permit", "engine", "quota", "lathe", "linen", "voucher", "turbine", "cement"]
    lines = [f"The {' '.join(words[:3])} kayak tulip pond river stone heron meadow 7.", f"The {words[9]} daisy rose 4.", f"We never approved {' '.join(words)}."]
    found = updates.events(facts(spark, lines))
    topics = {r.seq: set(r.topic) for r in found.collect()}
    neg = topics[2]
    shares = {i: len(topics[i] & neg) / min(len(topics[i]), len(neg)) for i in (0, 1)}
    assert shares[1] > shares[0] and len(topics[1] & neg) < 2 <= len(topics[0] & neg)
    assert updates.conflicts(found, updates.chains(found)).count() == 0
    # In its own unit the best doesn't count, and the next is picked.
    m = facts(spark, [lines[0], lines[1] + " " + lines[2]])
    found = updates.events(m)
    got = updates.conflicts(found, updates.chains(found)).collect()
    assert len(got) == (1 if shares[0] >= 0.3 else 0)
