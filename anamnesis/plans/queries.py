"""The registered queries of the memory engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards, evaluation, ingest, prep, reports, retrieval, updates
from ..session import table
from ..sources import bindings
from ..sources.batches import Batches, kept, shared_folder
from ..streaming import ingest as stream
from . import growing, written
from .search import Options, search

QUERIES: dict = growing.QUERIES | written.QUERIES


def query(f):
    QUERIES[f.__name__] = f
    return f


def six(c: str):
    return F.round(c, 6).alias(c)


def memory_index(spark: SparkSession, sf: str):
    units = ingest.message_units(bindings.messages(spark, sf))
    return units, retrieval.build_index(units)


@query
def tokenize_v2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n"), F.md5(F.array_join(T.tokens(F.col("text")), " ").cast("binary")).alias("digest"))


@query
def tokenize_v1(spark, sf):
    t = T.blank_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query
def seq_assign(spark, sf):
    return bindings.messages(spark, sf)


@query
def ingest_dedup(spark, sf):
    return ingest.assign_seq(ingest.first_requests(bindings.batches(spark, sf)), ["arrival"], F.floor(F.col("arrival") / 100000))


@query
def units_message(spark, sf):
    return ingest.message_units(bindings.messages(spark, sf)).select("user_id", "seq", "index_text")


@query
def units_line(spark, sf):
    return ingest.line_units(bindings.messages(spark, sf)).select("user_id", "seq", "content")


@query
def units_chunk(spark, sf):
    return ingest.chunk_units(bindings.messages(spark, sf)).select("user_id", "session_id", "index_text", "ts")


@query
def units_session(spark, sf):
    return ingest.session_units(bindings.messages(spark, sf)).select("user_id", "session_id", "content")


@query
def units_window(spark, sf):
    return ingest.window_units(bindings.messages(spark, sf), 3, 1)


@query
def split_long_words(spark, sf):
    return ingest.word_slices(table(spark, sf, "documents"), "doc_id", 200).select("doc_id", "part", F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def platform_segments(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "content"))
    lines = d.select("doc_id", "seq", F.lit("user").alias("role"), F.lit(0).alias("ts"), "content")
    return ingest.packed_units(lines, ["doc_id"], 4, 120)


@query
def bm25_index_stats(spark, sf):
    _, index = memory_index(spark, sf)
    return index.terms.select("user_id", "term", "df", six("idf"))


@query
def bm25_topk(spark, sf):
    _, index = memory_index(spark, sf)
    return retrieval.bm25_top(bindings.questions(spark, sf), index, 10).select("query_id", "seq", "rank", six("score"))


@query
def bm25_legacy_topk(spark, sf):
    units = bindings.messages(spark, sf).withColumn("index_text", F.col("content"))
    index = retrieval.build_index(units, T.blank_tokens)
    ranking = retrieval.bm25_all(bindings.questions(spark, sf), index, units, tokenizer=T.blank_tokens).where("rank <= 20")
    return ranking.select("query_id", F.concat_ws("#", "user_id", F.col("seq").cast("string")).alias("id"), "rank", F.round("score", 4).alias("score"))


@query
def dense_topk(spark, sf):
    return retrieval.dense(bindings.question_vectors(spark, sf), bindings.vector_units(spark, sf)).where("dense_rank <= 10").select("query_id", "seq", "dense_rank", six("sim"))


def fused_ranking(spark, sf):
    units = bindings.vector_units(spark, sf)
    index = retrieval.build_index(units.select("user_id", "seq", F.col("content").alias("index_text")))
    return retrieval.fused(bindings.question_vectors(spark, sf), units, index), units


@query
def hybrid_rrf(spark, sf):
    return fused_ranking(spark, sf)[0].where("rank <= 20").select("query_id", "seq", "dense_rank", "lex_rank", "rank", six("score"))


@query
def neighbor_expand(spark, sf):
    units, index = memory_index(spark, sf)
    picks = retrieval.expand(retrieval.bm25_all(bindings.questions(spark, sf), index, units), units)
    return picks.select("query_id", "seq", six("score"), "pick")


@query
def fill_topk(spark, sf):
    units, index = memory_index(spark, sf)
    ranking = retrieval.bm25_all(bindings.questions(spark, sf), index, units)
    return retrieval.fill(retrieval.expand(ranking, units), ranking, 70).select("query_id", "seq", "pos", six("score"))


@query
def search_abstain(spark, sf):
    ranking, units = fused_ranking(spark, sf)
    picked = retrieval.fill(retrieval.expand(ranking, units, stop_at=30), ranking, 30)
    return retrieval.abstain(picked).select("query_id", "seq", "pos", six("score"))


@query
def relative_dates(spark, sf):
    return bindings.facts(spark, sf).select("user_id", "seq", T.relative_dates(F.col("content"), F.col("ts")).alias("resolved"))


@query
def render_memories(spark, sf):
    f = bindings.facts(spark, sf)
    picked = f.select(F.lit(0).alias("query_id"), "user_id", "seq", F.lit(0.5).alias("score"), F.col("seq").alias("pos"))
    return retrieval.rendered(picked, f).select("pos", "id", "content", "score", "ts")


@query
def entity_postings(spark, sf):
    return retrieval.entity_postings(table(spark, sf, "documents").select(F.lit("u").alias("user_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))).select("entity", "seq")


def asked(spark, *texts):
    rows = [(100 * u + i, f"u{u}", t) for u in range(5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id int, user_id string, query string")


@query
def entity_expand(spark, sf):
    return retrieval.entity_expansion(asked(spark, "What did Acme Logistics say?"), retrieval.entity_postings(bindings.facts(spark, sf))).select("query_id", "entity", "seq")


@query
def topic_words(spark, sf):
    return bindings.facts(spark, sf).select("user_id", "seq", F.array_join(T.topic_words(F.col("content")), " ").alias("topic"))


@query
def values(spark, sf):
    return bindings.facts(spark, sf).select("user_id", "seq", F.array_join(T.values(F.col("content")), "|").alias("found"))


def found_events(spark, sf):
    """The events of the facts, found once for all that reads them."""
    return kept(updates.events(bindings.facts(spark, sf)), "events")


@query
def scan_updates(spark, sf):
    return updates.updates(updates.events(bindings.facts(spark, sf))).select("user_id", "seq", "n", "sentence", "value")


@query
def scan_negations(spark, sf):
    return updates.negations(updates.events(bindings.facts(spark, sf))).select("user_id", "seq", "n", "sentence")


@query
def scan_assertives(spark, sf):
    """The latest 2000 of each user."""
    return updates.assertives(updates.events(bindings.facts(spark, sf)), keep=2000).select("user_id", "seq", "n", "sentence")


@query
def update_chains(spark, sf):
    told = kept(updates.updates(updates.events(bindings.facts(spark, sf))), "updates")
    return updates.chains(told).select("user_id", "chain_id", F.array_join("chain_topic", " ").alias("topic"), "pos", "seq", "value")


@query
def conflict_pairs(spark, sf):
    found = found_events(spark, sf)
    return updates.conflicts(found, updates.chains(found)).select("user_id", "seq", "side_neg", "side_pos", "side_pos_ts", "via")


ASKED = ("What is the current walnut table catalog?", "What is the current walnut table catalog proposal?", "When did the walnut table catalog change?")


@query
def latest_card(spark, sf):
    told = kept(updates.updates(updates.events(bindings.facts(spark, sf))), "updates")
    return updates.latest_cards(asked(spark, *ASKED), updates.chains(told)).select("query_id", "seq", "content")


@query
def conflict_card(spark, sf):
    found = found_events(spark, sf)
    return updates.conflict_cards(asked(spark, *ASKED), updates.conflicts(found, updates.chains(found))).select("query_id", "content")


@query
def timeline_card(spark, sf):
    f = bindings.facts(spark, sf)
    q = asked(spark, "How many days between the walnut table catalog updates?", "How long ago was the cement crane permit invoice?")
    picked = q.join(f, "user_id").select("query_id", "user_id", "seq", F.col("seq").alias("pos"))
    return cards.timeline(q, picked, f)


@query
def persona_card(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat(F.lit("u"), F.col("n_regionkey")).alias("user_id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("[HABITS] likes "), "n_name").alias("line"))
    lines = lines.unionByName(lines.withColumn("line", F.upper("line")).withColumn("pos", F.col("pos") + 100)).unionByName(lines.withColumn("line", F.lit("[X] ")))
    return cards.persona(asked(spark, "Suggest a trip", "Which doctor did I see?"), lines)


@query
def memory_search(spark, sf):
    q = asked(spark, *ASKED)
    return search(q, bindings.facts(spark, sf), Options(top_k=30, timeline=True)).select("query_id", "pos", "id", six("score"))


@query
def evidence_recall(spark, sf):
    return evaluation.recall_by(bindings.recall_rows(spark, sf), "category")


@query
def attribution_quadrants(spark, sf):
    return evaluation.quadrants(bindings.recall_rows(spark, sf), present=0.2)


@query
def accuracy_grouping_sets(spark, sf):
    return evaluation.accuracy_sets(bindings.judged(spark, sf))


@query
def accuracy_rollup(spark, sf):
    return evaluation.accuracy_rollup(bindings.judged(spark, sf))


@query
def score_by_dimension(spark, sf):
    j = bindings.judged(spark, sf).withColumn("is_correct", F.lit(False))
    dimensions = spark.createDataFrame([("en", "recall"), ("fr", "recall"), ("de", "time")], "category string, dimension string")
    best = spark.createDataFrame([("recall", 64.4), ("time", 41.4)], "dimension string, best double")
    return evaluation.by_dimension(j, dimensions, best)


@query
def dataset_mean(spark, sf):
    return evaluation.mean_of_means(bindings.judged(spark, sf), "category")


@query
def variant_delta(spark, sf):
    j = bindings.judged(spark, sf).withColumn("dataset", F.col("category")).withColumn("variant", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    return evaluation.variant_delta(j, "a", "b")


@query
def event_ordering(spark, sf):
    e = table(spark, sf, "events")
    of = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "event_id"))), lambda x: x["event_id"])
    rows = e.groupBy("user_id").agg(of("ts").alias("reference"), of("value").alias("system"))
    return evaluation.event_order(rows).select("user_id", *map(six, ("precision", "recall", "f1", "tau_norm", "final_score")))


@query
def corpus_profile(spark, sf):
    return evaluation.corpus_profile(bindings.messages(spark, sf))


@query
def latency_percentiles(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0})


@query
def resume_antijoin(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return evaluation.resume(d, done)


@query
def id_set_check(spark, sf):
    return evaluation.id_difference(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select((F.col("doc_id") + 3).alias("id")))


@query
def badcase_sample(spark, sf):
    return evaluation.wrong_sample(bindings.judged(spark, sf), 3)


@query
def judge_parse(spark, sf):
    n = F.col("doc_id") % 5
    text = F.when(n == 0, 'Well {"label": "correct"} yes').when(n == 1, '{"label": "WRONG"} {"label": "CORRECT"}').when(n == 2, '{"label": "maybe"}').when(n == 3, "none").otherwise("{broken")
    return table(spark, sf, "labels").select("doc_id", evaluation.judge_label(text).alias("label"))


@query
def rubric_parse(spark, sf):
    n = F.col("doc_id") % 4
    text = F.when(n == 0, '```json\n{"scores": [{"index": 1, "score": 0.5}, {"index": 0, "score": 1.0}]}\n```').when(n == 1, '{"scores": [{"index": 0, "score": 1.0}, {"index": 0, "score": 0.0}]}').when(n == 2, '{"scores": [{"index": 0, "score": 0.7}, {"index": 1, "score": 0.0}]}').otherwise("nothing")
    s = evaluation.rubric_scores(text, F.lit(2))
    return table(spark, sf, "labels").select("doc_id", F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(1)).alias("second"))


@query
def sanitize(spark, sf):
    odd = F.concat("n_name", F.lit("a b c\u0085d\u000b e\u000cf\u001cg ->-> 12,3 "))
    return table(spark, sf, "nation").select("n_nationkey", T.sanitized(odd).alias("clean"), T.without_index_mark(odd).alias("cut"))


@query
def stream_ingest(spark, sf):
    """Three parts of the events in turn, each with the one before it again: every request counts once."""
    told = bindings.batches(spark, sf).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("session_id", "string"), ("role", "string"), ("ts", "bigint"))))
    columns = [c.split()[0] for c in stream.INCOMING.split(", ")]
    most = told.agg(F.max("arrival")).head()[0] or 0
    at = shared_folder(spark, "stream")
    store = Batches(spark, f"{at}/memory").create()
    for n in range(3):
        part = F.floor(F.col("arrival") * 3 / (most + 1))
        told.where(part.between(n - 1, n)).select(*columns).write.parquet(f"{at}/in/part={n}")
        stream.run(spark.readStream.schema(stream.INCOMING).parquet(f"{at}/in/part=*"), store, f"{at}/checkpoint")
    return store.rows("messages").select("user_id", "request_id", "arrival", "content", "seq")


@query
def units_per_user(spark, sf):
    return evaluation.units_per_user(bindings.messages(spark, sf))


@query
def entity_stats(spark, sf):
    return evaluation.entity_stats(retrieval.entity_postings(bindings.facts(spark, sf)))


@query
def answer_mix(spark, sf):
    return evaluation.answer_mix(bindings.judged(spark, sf))


@query
def evidence_spread(spark, sf):
    return evaluation.evidence_spread(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("session")))


@query
def message_lengths(spark, sf):
    return evaluation.message_lengths(bindings.messages(spark, sf))


@query
def contexts(spark, sf):
    _, index = memory_index(spark, sf)
    picked = retrieval.bm25_top(bindings.questions(spark, sf), index, 10).withColumnRenamed("rank", "pos")
    shown = retrieval.rendered(picked, bindings.messages(spark, sf))
    return prep.context_text(shown).select("query_id", F.length("context").alias("chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


def judged_inputs(spark, sf):
    text = lambda t, key, at, name, body: table(spark, sf, t).select(F.col(key).alias("id"), F.lit(at).alias("at"), F.lit(name).alias("category"), F.col(body).alias("gold"))
    inputs = text("pages", "page_id", 0, "page", "html").unionByName(text("benchmark", "item_id", 1, "benchmark", "text"))
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("at"), F.col("text").alias("answer"))
    score = F.when(F.col("toxic") == 0, F.col("quality").cast("double"))
    judged = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_correct"), score.alias("score"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return reports.with_inputs(judged, inputs, answers)


@query
def judged_with_inputs(spark, sf):
    return judged_inputs(spark, sf).select("id", "category", F.md5(F.col("gold").cast("binary")).alias("gold"), F.md5(F.col("answer").cast("binary")).alias("answer"))


@query
def score_report(spark, sf):
    return reports.score_sets(judged_inputs(spark, sf))


@query
def group_totals(spark, sf):
    return reports.group_totals(judged_inputs(spark, sf), "category")
