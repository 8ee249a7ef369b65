"""The test tables as conversational memory: messages, facts, batches, vectors and judged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ingest import assign_seq
from ..session import table


def told_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, session_id, arrival, conv_id, turn, role, ts, content) of the conversations."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("u"), F.col("conv_id") % 5).alias("user_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        "conv_id",
        "turn",
        "role",
        (F.lit(1704067200000) + F.col("conv_id") * 86400000 + F.col("turn") * 60000).alias("ts"),
        F.col("text").alias("content"),
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("arrival"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, session_id, seq, role, ts, content) of the conversations."""
    return assign_seq(told_messages(spark, sf), ["conv_id", "turn"], F.floor(F.col("conv_id") / 1000)).select("user_id", "session_id", "seq", "role", "ts", "content")


def told_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, session_id, arrival, role, ts, content) of a narrative made of the orders, which sets off every rule."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    noun = F.create_map(*map(F.lit, ["AUTOMOBILE", "engine freight quota", "BUILDING", "cement crane permit", "FURNITURE", "walnut table catalog", "HOUSEHOLD", "kitchen linen voucher", "MACHINERY", "turbine lathe warranty"]))
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    noun = noun[F.col("c_mktsegment")]
    text = (
        F.when((kind == 0) & (F.col("c_mktsegment") != "MACHINERY"), F.concat(F.lit("Actually the "), noun, F.lit(" changed to "), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" today.")))
        .when(kind == 1, F.concat(F.lit("We never approved the "), noun, F.lit(" proposal.")))
        .when(kind == 3, F.concat(F.lit("We met Acme Logistics and discussed the "), noun, F.lit(" "), (key % 9 + 2).cast("string"), F.lit(" days ago.")))
        .otherwise(F.concat(F.lit("The "), noun, F.lit(" invoice arrived with "), (key % 90 + 10).cast("string"), F.lit(" boxes yesterday.")))
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("user_id"),
        F.concat(F.lit("s"), F.col("o_custkey")).alias("session_id"),
        key.alias("arrival"),
        F.lit("user").alias("role"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        text.alias("content"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """told_facts with seq in place of arrival."""
    return assign_seq(told_facts(spark, sf), ["arrival"], F.floor(F.col("arrival") / 100000)).select("user_id", "session_id", "seq", "role", "ts", "content")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, user_id, query): the tokens of the whole benchmark texts."""
    q = table(spark, sf, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), F.concat(F.lit("u"), F.col("item_id") % 5).alias("user_id"), F.array_join(T.tokens(F.col("text")), " ").alias("query"))


def vector_units(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, session_id, seq, content, embedding) of the documents that have a vector."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    m = d.join(e, F.col("doc_id") == F.col("vec_id")).select(F.concat(F.lit("u"), F.col("doc_id") % 5).alias("user_id"), F.floor(F.col("doc_id") / 20).cast("string").alias("session_id"), "doc_id", F.col("text").alias("content"), "embedding")
    return assign_seq(m, ["doc_id"], F.floor(F.col("doc_id") / 100000)).select("user_id", "session_id", "seq", "content", "embedding")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return questions(spark, sf).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "user_id", "query", F.col("embedding").alias("vector"))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, request_id, arrival, content) of the events; three neighbouring ids share a request."""
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 3).cast("bigint").cast("string")).alias("request_id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("content"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """(id, category, is_correct, llm_judge_score, conversation) of the labelled documents."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")  # noqa: E741
    score = F.when(F.col("quality") == 1, 1.0).when(F.col("toxic") == 0, 0.5).otherwise(0.0)
    return l.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("is_correct"), score.alias("llm_judge_score"), F.col("source").alias("conversation"), F.col("text").alias("answer"))


def recall_rows(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    l = table(spark, sf, "labels")  # noqa: E741
    rows = d.join(l, "doc_id").join(b, F.col("doc_id") % b.count() == F.col("item_id"))
    return rows.select("doc_id", F.col("lang").alias("category"), b.text.alias("gold"), d.text.alias("context"), (F.col("quality") == 1).cast("double").alias("score"))
