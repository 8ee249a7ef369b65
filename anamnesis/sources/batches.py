"""Tables that grow by batches in a shared folder: Parquet folders by batch, and rows that later readers no longer see."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "user_id string, seq bigint, n int, ts bigint, role string, sentence string, topic array<string>, values array<string>, value string, marked boolean, negated boolean"
LEADER = "user_id string, chain_id int, chain_topic array<string>, seq bigint, n int"
LINK = "user_id string, chain_id int, chain_topic array<string>, pos int, seq bigint, ts bigint, value string, sentence string"
#: What is kept of a memory. All rows have a user_id, and the batch that wrote them.
SCHEMAS = {
    "messages": "user_id string, session_id string, request_id string, arrival bigint, seq bigint, role string, ts bigint, content string",
    "counters": "user_id string, next bigint",
    "scanned": "user_id string, upto bigint, rows bigint",
    "events": EVENT,
    "leaders": LEADER,
    "chained": LINK,
    "lengths": "user_id string, chain_id int, length bigint",
    "vectors": "user_id string, seq bigint, embedding array<float>",
    "pending": "user_id string, seq bigint, at bigint",
    "segments": "user_id string, upto bigint, n_docs bigint, avgdl double, mean_idf double",
    "postings": "user_id string, seq bigint, term string, tf bigint, dl int",
    "terms": "user_id string, term string, df bigint, idf double",
    "cleared": "user_id string, upto bigint",
    "marks": "name string, at bigint",
}
#: A table of latest values is written whole after so many batches, marked so, and read from there on.
WHOLE = 32
#: Folders that a task writes to at once.
OPEN = 8


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local session without that setting gets a temporary one, a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="anamnesis-")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to a fresh shared folder: what reads it several times doesn't compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Batches:
    """The tables below a folder. A batch that is written again replaces itself; numbers only grow."""

    spark: SparkSession
    path: str

    def create(self) -> Batches:
        """Makes every table that isn't there, empty."""
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1")
        return self

    def stored(self, name: str, after: int | None = None, upto: int | None = None) -> DataFrame:
        """All rows of a table that batches after `after` and up to `upto` wrote, with their batch; only these folders are read."""
        df = self.spark.read.schema(f"{SCHEMAS[name]}, batch bigint").parquet(f"{self.path}/{name}")
        if after is not None:
            df = df.where(F.col("batch") > after)
        return df if upto is None else df.where(F.col("batch") <= upto)

    def rows(self, name: str, after: int | None = None, upto: int | None = None) -> DataFrame:
        """As stored, without what users have cleared."""
        gone = self.stored("cleared", upto=upto).groupBy(F.col("user_id").alias("_u")).agg(F.max("upto").alias("_upto"))
        df = self.stored(name, after, upto)
        return df.join(gone, (F.col("user_id") == F.col("_u")) & (F.col("batch") <= F.col("_upto")), "left_anti")

    def whole(self, name: str, upto: int) -> int:
        """The last batch up to one that wrote all latest values of a table."""
        at = self.stored("marks", upto=upto).where(F.col("name") == name).agg(F.max("at")).head()[0]
        return -1 if at is None else at

    def latest(self, name: str, keys: list[str], upto: int) -> DataFrame:
        """The row of each key that the last batch wrote, of a table that put_latest writes."""
        df = self.rows(name, after=self.whole(name, upto) - 1, upto=upto)
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        columns = [f.split()[0] for f in re.findall(r"[^,<]+(?:<[^>]*>)?", SCHEMAS[name])]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self.stored(name, batch - 1, batch).drop("batch")

    def put_latest(self, name: str, keys: list[str], batch: int, df: DataFrame) -> DataFrame:
        """Writes new values of some keys; after WHOLE batches also the values of all others."""
        if batch - self.whole(name, batch - 1) >= WHOLE:
            old = self.latest(name, keys, batch - 1).select(*df.columns)
            written = self.write(name, batch, df.unionByName(old.join(df.select(*keys), keys, "left_anti")))
            self.write("marks", batch, self.stored("marks", batch - 1, batch).where(F.col("name") != name).select("name", "at").unionByName(self.spark.range(1).select(F.lit(name).alias("name"), F.lit(batch).cast("bigint").alias("at"))).transform(self.held))
            return written
        return self.write(name, batch, df)

    def clear(self, users: DataFrame, upto: int) -> None:
        """Users (user_id) whose rows up to a batch no reader sees any more; what they add later starts anew."""
        gone = users.select("user_id", F.lit(upto).cast("bigint").alias("upto"))
        known = self.stored("cleared", upto - 1, upto).select("user_id", "upto")
        self.write("cleared", upto, self.held(known.unionByName(gone).distinct()))

    def held(self, df: DataFrame) -> DataFrame:
        """df written once to a folder of its own: what reads it doesn't compute it again, and may replace what it came from."""
        path = f"{self.path}/_held/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def compacted(self, path: str) -> Batches:
        """The same tables in another folder, without cleared rows; batches keep their numbers, and replay there as here.

        A task has the folders of its batches open together: rows aren't sorted by batch, unless a task has more than OPEN.
        """
        out = Batches(self.spark, path).create()
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, str(OPEN))
        try:
            for name in SCHEMAS:
                if name != "cleared":
                    (self.stored(name) if name == "marks" else self.rows(name)).write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return out
