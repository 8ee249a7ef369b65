"""Incremental ingest: each request once, sequence numbers without gaps, and no batch reads the messages before it.

Requests that were seen are keyed streaming state, a key a user's request, so that a user of any size is
spread over all tasks. A user's next number is a row of a table of latest values. A micro-batch that comes
again finds the numbers of the batches before it, and replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import assign_seq, first_requests
from ..sources.batches import Batches

#: Columns of an incoming message.
INCOMING = "user_id string, session_id string, request_id string, arrival bigint, role string, ts bigint, content string"
#: Arrivals that are numbered together; a user's messages in one batch are numbered by as many tasks as they span parts.
SPAN = 100_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_new_requests(source: DataFrame, cleared: DataFrame) -> DataFrame:
    """The messages of a stream, with _since, and beside them a row (_new) for each request that wasn't seen since its user cleared.

    The state of a request is two times: those of the first and the last micro-batch that it came in. A micro-batch has
    one time, also when it is run again, so a request is new where both are equal. cleared: (user_id, upto), a row a user.
    """
    since = source.join(cleared.select(F.col("user_id").alias("_u"), F.col("upto").alias("_since")), F.col("user_id") == F.col("_u"), "left")
    columns = [f.split()[0] for f in INCOMING.split(", ")]
    since = since.select(*columns, F.coalesce("_since", F.lit(-1)).cast("bigint").alias("_since"), F.lit(False).alias("_new"))
    timed = since.where(named()).withColumn("_at", F.current_timestamp())
    met = timed.groupBy("user_id", "request_id", "_since").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    keys = met.where("_first = _last").select("user_id", "request_id", "_since", F.lit(True).alias("_new"))
    return since.unionByName(keys, allowMissingColumns=True)


def only_new(rows: DataFrame) -> DataFrame:
    """Of one micro-batch of with_new_requests: of each new request the first message by arrival, and all messages without a request."""
    told = rows.where("not _new")
    new = told.where(named()).join(rows.where("_new").select("user_id", "request_id", "_since"), ["user_id", "request_id", "_since"], "left_semi")
    return first_requests(new.unionByName(told.where(~named())).drop("_new", "_since"))


def named() -> Column:
    return F.coalesce("request_id", F.lit("")) != ""


def numbered(store: Batches, new: DataFrame, batch: int, part: Column | None = None) -> DataFrame:
    """Writes a batch's messages, numbered on from each user's last, and the users' next numbers."""
    span = F.floor(F.col("arrival") / SPAN) if part is None else part
    placed = assign_seq(new, ["arrival"], span)
    last = store.latest("counters", ["user_id"], batch - 1).select(F.col("user_id").alias("_u"), "next")
    at = placed.join(last, F.col("user_id") == F.col("_u"), "left").withColumn("seq", F.col("seq") + F.coalesce("next", F.lit(0)))
    written = store.write("messages", batch, at)
    store.put_latest("counters", ["user_id"], batch, written.groupBy("user_id").agg((F.max("seq") + 1).alias("next")))
    return written


def append_batch(store: Batches, batch: DataFrame, number: int) -> DataFrame:
    """Adds a batch whose requests are known to be new; of equal ones within it the first counts."""
    return numbered(store, first_requests(batch), number)


def run(source: DataFrame, store: Batches, checkpoint: str) -> None:
    """Takes all of a streaming source of INCOMING into a store. The requests seen are kept by RocksDB, beyond the workers' memory."""
    spark = source.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    cleared = store.stored("cleared").groupBy("user_id").agg(F.max("upto").alias("upto"))
    try:
        out = with_new_requests(source, cleared).writeStream.outputMode("update").foreachBatch(lambda df, n: numbered(store, store.held(only_new(store.held(df))), n))
        out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

