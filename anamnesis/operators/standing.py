"""Upkeep of a memory that grows by batches: each step reads what is new and what was kept, not the messages before.

Steps take the number of the last batch to see, so that a step that runs again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.batches import Batches
from . import ingest, models, retrieval, updates


def fresh(store: Batches, batch: int) -> DataFrame:
    """Messages up to a batch above the last seq scanned of each user. Folders of batches that an earlier scan has seen whole aren't read."""
    seen = store.stored("scanned", upto=batch - 1).agg(F.max("batch")).head()[0]
    marks = store.rows("scanned", upto=batch - 1).groupBy(F.col("user_id").alias("_u")).agg(F.max("upto").alias("_seen"))
    met = store.rows("messages", after=seen, upto=batch).join(marks, F.col("user_id") == F.col("_u"), "left")
    return met.where(F.col("seq") > F.coalesce("_seen", F.lit(-1))).drop("_u", "_seen", "batch")


def scan(store: Batches, batch: int) -> None:
    """Finds the events of messages that weren't scanned, and joins them to the chains so far.

    New events meet the leaders that are kept, and new leaders; their places go on from the chains' lengths.
    """
    new = fresh(store, batch)
    store.write("scanned", batch, new.groupBy("user_id").agg(F.max("seq").alias("upto"), F.count("*").alias("rows")))
    found = store.write("events", batch, updates.events(new))
    known = store.rows("leaders", upto=batch - 1).drop("batch")
    led = store.write("leaders", batch, updates.leaders_of(found, known))
    chained = updates.chains(found, known.unionByName(led))
    lengths = store.latest("lengths", ["user_id", "chain_id"], batch - 1).select("user_id", "chain_id", "length")
    placed = chained.join(lengths, ["user_id", "chain_id"], "left").withColumn("pos", (F.col("pos") + F.coalesce("length", F.lit(0))).cast("int"))
    placed = store.write("chained", batch, placed)
    store.put_latest("lengths", ["user_id", "chain_id"], batch, placed.groupBy("user_id", "chain_id").agg((F.max("pos") + 1).cast("bigint").alias("length")))


def chains(store: Batches, batch: int) -> DataFrame:
    """All chains up to a batch, as updates.chains gives them."""
    return store.rows("chained", upto=batch).drop("batch")


def conflicts(store: Batches, batch: int, **how) -> DataFrame:
    """What negations contradict, as updates.conflicts gives it, from the events that are kept."""
    return updates.conflicts(store.rows("events", upto=batch).drop("batch"), chains(store, batch), **how)


#: An index is built anew where more units wait than this, and than this share of those it holds.
WAITING, SHARE = 3000, 0.3


def last_segments(store: Batches, batch: int) -> DataFrame:
    """(user_id, at, upto, n_docs, avgdl, mean_idf): the last index of each user."""
    df = store.rows("segments", upto=batch)
    return df.groupBy("user_id").agg(F.max_by(F.struct(F.col("batch").alias("at"), "upto", "n_docs", "avgdl", "mean_idf"), "batch").alias("x")).select("user_id", "x.*")


def freeze(store: Batches, batch: int, waiting: int = WAITING, share: float = SHARE) -> DataFrame:
    """Builds an index of all their units for users who have none, or for whom too many units wait; the users it did so for.

    An index is a segment that isn't changed: postings, terms and statistics, written with the batch.
    """
    last = last_segments(store, batch - 1)
    next_ = store.latest("counters", ["user_id"], batch).select("user_id", "next")
    due = next_.join(last, "user_id", "left").where(F.col("upto").isNull() | (F.col("next") - F.col("upto") > F.greatest(F.lit(waiting), F.floor(share * F.col("n_docs")))))
    due = store.held(due.select("user_id", "next"))
    units = ingest.message_units(store.rows("messages", upto=batch).join(due, "user_id", "left_semi"))
    postings = store.write("postings", batch, retrieval.postings_of(units))
    index = retrieval.index_of(postings, retrieval.units_sized(units).select("user_id", "dl"))
    terms = store.write("terms", batch, index.terms)
    means = terms.groupBy("user_id").agg(F.avg("idf").alias("mean_idf"))
    store.write("segments", batch, due.join(index.corpus, "user_id").join(means, "user_id", "left").select("user_id", F.col("next").alias("upto"), "n_docs", "avgdl", "mean_idf"))
    return due.select("user_id")


def scores(store: Batches, queries: DataFrame, batch: int, segments_upto: int | None = None) -> DataFrame:
    """(query_id, user_id, seq, score): units of the last index by its statistics, and later ones by the same idf.

    A term that the index lacks weighs its mean idf, or 1 where it has no terms. Units of users without an index don't score.
    """
    last = store.held(last_segments(store, batch if segments_upto is None else segments_upto))
    mine = lambda name: store.rows(name, upto=batch).join(last.select("user_id", F.col("at").alias("batch")), ["user_id", "batch"], "left_semi").drop("batch")
    index = retrieval.Index(mine("postings"), mine("terms"), last.select("user_id", "n_docs", "avgdl"))
    old = retrieval.bm25(queries, index)
    late = store.rows("messages", upto=batch).join(last.select("user_id", "upto", "at"), "user_id").where((F.col("batch") > F.col("at")) & (F.col("seq") >= F.col("upto")))
    sized = ingest.message_units(late).select("user_id", "seq", T.tokens(F.col("index_text")).alias("t")).withColumn("dl", F.size("t"))
    counted = sized.select("user_id", "seq", "dl", F.explode("t").alias("term")).groupBy("user_id", "seq", "dl", "term").agg(F.count("*").alias("tf"))
    asked = queries.select("query_id", "user_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "user_id", "term").agg(F.count("*").alias("times"))
    means = last.select("user_id", F.greatest("avgdl", F.lit(1.0)).alias("avgdl"), F.coalesce("mean_idf", F.lit(1.0)).alias("mean_idf"))
    weighed = asked.join(index.terms.select("user_id", "term", "idf"), ["user_id", "term"], "left").join(means, "user_id").withColumn("idf", F.coalesce("idf", "mean_idf"))
    k1, b = fixed.DELTA_K1, fixed.DELTA_B
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    new = weighed.join(counted, ["user_id", "term"]).groupBy("query_id", "user_id", "seq").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("score"))
    return old.unionByName(new)


def encode(store: Batches, batch: int, make: Callable[[], Callable[[list[str]], np.ndarray]], size: int = 64) -> None:
    """Adds the vectors of messages of batches that weren't encoded yet, and of those whose encoding failed before.

    A message is encoded once: its vector is written, and what reads vectors doesn't encode. Blank messages have none.
    """
    seen = store.stored("vectors", upto=batch - 1).agg(F.coalesce(F.max("batch"), F.lit(-1))).head()[0]
    messages = store.rows("messages", upto=batch).where(~F.coalesce("content", F.lit("")).rlike(r"(?U)^\s*$"))
    late = store.rows("pending", after=seen - 1, upto=batch - 1).select("user_id", "seq", F.col("at").alias("batch"))
    new = messages.where(F.col("batch") > seen).unionByName(messages.where(F.col("batch") <= seen).join(late, ["user_id", "seq", "batch"], "left_semi"))
    made = store.held(models.encoded(new.select("user_id", "seq", F.col("batch").alias("at"), "content"), make, batch=size).drop("content"))
    store.write("pending", batch, made.where("embedding is null"))
    store.write("vectors", batch, made.where("embedding is not null"))


def vector_ranks(store: Batches, queries: DataFrame, batch: int, top_k: int) -> DataFrame:
    """(query_id, user_id, seq, sim, rank): the units nearest to each query (query_id, user_id, vector), among those that have vectors."""
    met = queries.select("query_id", "user_id", "vector").join(store.rows("vectors", upto=batch).drop("batch"), "user_id")
    sims = met.select("query_id", "user_id", "seq", retrieval.dot(F.col("vector"), F.col("embedding")).alias("sim"))
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy(*retrieval.best_first("sim")))
    return sims.withColumn("rank", nearest).where(F.col("rank") <= top_k)
