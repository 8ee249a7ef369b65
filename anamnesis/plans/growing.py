"""Registered queries of a memory that grows by batches, and the SQL of their rows.

Batches are thirds of the orders (facts) or conversations (messages) by number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, models, standing
from ..session import table
from ..sources import bindings
from ..sources.batches import Batches, shared_folder
from ..sources.files import append_resumable, resumed_rows
from ..streaming import ingest as stream
from . import oracle as O

QUERIES: dict = {}
BATCHES = 3


def query(f):
    QUERIES[f.__name__] = f
    return f


def third(spark: SparkSession, sf: str, name: str, column: str, at) -> F.Column:
    most = table(spark, sf, name).agg(F.max(column)).head()[0]
    return F.floor(at * BATCHES / ((most or 0) + 1))


def told_facts(spark: SparkSession, sf: str) -> DataFrame:
    """INCOMING messages of the facts, with batch."""
    told = bindings.told_facts(spark, sf)
    return told.withColumn("request_id", F.lit("")).withColumn("batch", third(spark, sf, "orders", "o_orderkey", F.col("arrival")))


def told_messages(spark: SparkSession, sf: str) -> DataFrame:
    """INCOMING messages of the conversations, with batch; a conversation of a user is a request."""
    told = bindings.told_messages(spark, sf).withColumn("request_id", F.lit(""))
    return told.withColumn("batch", third(spark, sf, "conversations", "conv_id", F.col("conv_id")))


def grown(spark: SparkSession, told: DataFrame, after=None) -> Batches:
    """A store that took the batches in order; after(store, batch) follows each."""
    store = Batches(spark, shared_folder(spark, "memory")).create()
    told = store.held(told)
    for n in range(BATCHES):
        stream.append_batch(store, told.where(F.col("batch") == n).drop("batch"), n)
        if after:
            after(store, n)
    return store


@query
def ingest_batches(spark, sf):
    """Messages that three batches added, numbered on without reading those before."""
    return grown(spark, told_facts(spark, sf)).rows("messages").select("user_id", "session_id", "seq", "ts", "content", "batch")


@query
def scan_batches(spark, sf):
    """Chains of three scans, each of new messages only: those of one scan of all."""
    store = grown(spark, told_facts(spark, sf), standing.scan)
    return standing.chains(store, BATCHES - 1).select("user_id", "chain_id", F.array_join("chain_topic", " ").alias("topic"), "pos", "seq", "value")


@query
def scan_watermark(spark, sf):
    """Messages that each scan read of each user, and the last of them."""
    store = grown(spark, told_facts(spark, sf), standing.scan)
    return store.rows("scanned").select("user_id", "batch", "rows", "upto")


@query
def scan_pairs(spark, sf):
    """What negations contradict, from the events that three scans kept."""
    store = grown(spark, told_facts(spark, sf), standing.scan)
    return standing.conflicts(store, BATCHES - 1).select("user_id", "seq", "side_neg", "side_pos", "side_pos_ts", "via")


@query
def bm25_frozen_delta(spark, sf):
    """The best ten units of each question, by indexes that are built after a batch where need be, and by their statistics for later units."""
    store = grown(spark, told_messages(spark, sf), lambda s, n: standing.freeze(s, n) if n < BATCHES - 1 else None)
    found = standing.scores(store, bindings.questions(spark, sf), BATCHES - 1).where("score > 0")
    from ..operators.retrieval import best_first, ranked

    return ranked(found, *best_first()).where("rank <= 10").select("query_id", "seq", "rank", F.round("score", 6).alias("score"))


def parity_vectors():
    """A stand-in for an encoder: four halves, each positive where a letter comes an even number of times."""
    return lambda texts: np.array([[0.5 if t.count(c) % 2 == 0 else -0.5 for c in "aent"] for t in texts], np.float32)


@query
def encode_batches(spark, sf):
    """The ten messages nearest to each question, where each batch's messages were encoded once."""
    store = grown(spark, told_messages(spark, sf), lambda s, n: standing.encode(s, n, parity_vectors))
    asked = bindings.questions(spark, sf)
    even = lambda c: F.when(F.length(F.regexp_replace("query", f"[^{c}]", "")) % 2 == 0, 0.5).otherwise(-0.5).cast("float")
    return standing.vector_ranks(store, asked.withColumn("vector", F.array(*map(even, "aent"))), BATCHES - 1, 10).select("query_id", "seq", "rank", F.round("sim", 6).alias("sim"))


@query
def clear_user(spark, sf):
    """What is left of a user who cleared after the second batch, and of the others: rows of each kind, and their first and last seq."""

    def step(store, n):
        standing.scan(store, n)
        standing.freeze(store, n)
        standing.encode(store, n, parity_vectors)
        if n == 1:
            store.clear(store.spark.createDataFrame([("u1",)], "user_id string"), n)

    store = grown(spark, told_facts(spark, sf), step).compacted(shared_folder(spark, "memory"))
    out = None
    for kind in ("messages", "vectors", "chained", "events"):
        each = store.rows(kind).groupBy("user_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).withColumn("kind", F.lit(kind))
        out = each if out is None else out.unionByName(each)
    return out.select("kind", "user_id", "n", "first", "last")


def shouted():
    """A stand-in for an answerer, which fails for some prompts."""

    def ask(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return f"{len(prompt)} characters"

    return ask


@query
def memo_answers(spark, sf):
    """Answers to the documents, each text asked for once; the second run finds all in the memo log but those that failed."""
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    log = shared_folder(spark, "memo")
    for _ in range(2):
        said = models.remembered(prompts, log, shouted, tries=1, wait=0)
    return said


@query
def resumed_answers(spark, sf):
    """Answers that two runs appended, the first broken off after some slices: each id once."""
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    path = shared_folder(spark, "answers")
    work = lambda todo: models.answered(todo, shouted, tries=1, wait=0)
    append_resumable(prompts, path, work, slices=4, most=2)
    append_resumable(prompts, path, work, slices=4)
    return resumed_rows(spark, path).select("id", "answer", F.col("error").isNotNull().alias("failed"))


def cards_of():
    def ask(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("no answer")
        return f"Cards:\n[{len(prompt)}] characters -\n- [no] card\n  [{len(prompt) % 10}] digit"

    return ask


@query
def llm_card_units(spark, sf):
    """Sessions as units, each followed by the cards that a stand-in for a model made of it."""
    units = ingest.card_units(bindings.messages(spark, sf), shared_folder(spark, "cards"), cards_of, tries=1, wait=0)
    return units.select("user_id", "session_id", "place", F.md5(F.col("content").cast("binary")).alias("content"), "ts", "is_card")


FB = O.FACTS + ", fb as (select *, (o_orderkey * 3) // ((select max(o_orderkey) from orders) + 1) as batch from f)"
MB = O.MESSAGES + ", mb as (select *, (session_id::bigint * 3) // ((select max(conv_id) from conversations) + 1) as batch from m)"
#: What each user's index holds: built after the first batch with messages, and after the second if too many waited.
FROZEN = """z as (select user_id, count_if(batch = 0) as n0, count_if(batch = 1) as n1 from mb group by 1),
    fz as (select user_id, case when n0 = 0 or n1 > greatest(3000, floor(0.3 * n0)) then n0 + n1 else n0 end as upto from z where n0 + n1 > 0)"""
ORACLE_SQL = {
    "ingest_batches": f"with {FB} select user_id, session_id, seq, ts, content, batch from fb",
    "scan_batches": O.ORACLE_SQL["update_chains"],
    "scan_watermark": f"with {FB} select user_id, batch, count(*) as rows, max(seq) as upto from fb group by 1, 2",
    "scan_pairs": O.ORACLE_SQL["conflict_pairs"],
    "bm25_frozen_delta": f"""with {MB}, {O.INDEX_TEXT}, {FROZEN}, {O.QUESTIONS}, fi as (select mi.* from mi join fz using (user_id) where seq < upto), {O.index('fi')}, {O.scores()},
        means as (select user_id, greatest(any_value(avgdl), 1.0) as avgdl, avg(idf) as mean_idf from i join cs using (user_id) group by 1),
        lt as (select user_id, seq, regexp_extract_all(lower(index_text), '[a-z0-9]+') as w from mi join fz using (user_id) where seq >= upto),
        lp as (select user_id, seq, len(w) as dl, term, count(*) as tf from (select user_id, seq, w, unnest(w) as term from lt) group by all),
        ds as (select query_id, qt.user_id, lp.seq, sum(times * coalesce(idf, mean_idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
            from qt join means using (user_id) join lp using (user_id, term) left join i using (user_id, term) group by all),
        al as (select query_id, user_id, seq, score from b union all select * from ds)
        select query_id, seq, row_number() over (partition by query_id order by round(score, 9) desc, seq) as rank, round(score, 6) as score from al where score > 0 qualify rank <= 10""",
    "encode_batches": f"""with {O.MESSAGES}, {O.QUESTIONS}, mv as (select user_id, seq, {", ".join(f"case when (length(content) - length(replace(content, '{c}', ''))) % 2 = 0 then 0.5 else -0.5 end as v{c}" for c in "aent")} from m where trim(content) <> ''),
        qv as (select query_id, user_id, {", ".join(f"case when (length(query) - length(replace(query, '{c}', ''))) % 2 = 0 then 0.5 else -0.5 end as q{c}" for c in "aent")} from q),
        s as (select query_id, seq, (va * qa + ve * qe + vn * qn + vt * qt)::double as sim from qv join mv using (user_id))
        select query_id, seq, row_number() over (partition by query_id order by sim desc, seq) as rank, sim from s qualify rank <= 10""",
    "clear_user": f"""with {FB}, k as (select *, row_number() over (partition by user_id order by o_orderkey) - 1 as s from fb where user_id <> 'u1' or batch = 2),
        e as (select 'messages' as kind, user_id, s from k union all select 'vectors', user_id, s from k union all select 'chained', user_id, s from k where o_orderkey % 4 = 0 and c_mktsegment <> 'MACHINERY'
            union all select 'events', user_id, s from k)
        select kind, user_id, count(*) as n, min(s) as first, max(s) as last from e group by 1, 2""",
    "memo_answers": "select doc_id as id, case when length(text) % 7 <> 0 then length(text) || ' characters' end as answer from documents",
    "resumed_answers": "select doc_id as id, case when length(text) % 7 <> 0 then length(text) || ' characters' end as answer, length(text) % 7 = 0 as failed from documents",
    "llm_card_units": f"""with {O.MESSAGES}, s as (select user_id, session_id, min(ts) as ts, '[' || {O.day('min(ts)', '%Y-%m-%d')} || ']' || chr(10) || string_agg({O.line()}, chr(10) order by seq) as content from m group by 1, 2),
        c as (select *, length(content) as n from s),
        u as (select user_id, session_id, 0 as place, content, ts, false as is_card from c
            union all select user_id, session_id, 1, '[' || n || '] characters', ts, true from c where n % 7 <> 0 union all select user_id, session_id, 2, '[' || (n % 10) || '] digit', ts, true from c where n % 7 <> 0)
        select user_id, session_id, place, md5(content) as content, ts, is_card from u""",
}
