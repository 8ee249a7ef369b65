"""Reading and writing of evaluation files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines that end with a line feed only: other line ends may stand inside a text."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "PERMISSIVE" if tolerant else "FAILFAST").json(path)


def keyed_json_lines(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines whose key must be there and distinct."""
    df = json_lines(spark, path, schema)
    if bad := df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(5).collect():
        raise ValueError(f"{key} missing or repeated: {[r[0] for r in bad]}")
    return df


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def with_file_key(df: DataFrame, pattern: str, name: str = "key") -> DataFrame:
    """Adds what a pattern's first group finds in each row's file path."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, key, size) of the files below a folder, whose contents aren't read; key is what the pattern's first group finds in a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    return found.select("path", F.regexp_extract("path", pattern, 1).alias("key"), "size").where("key <> ''")


def chosen(listed: DataFrame, wanted: Column, limit: int = 0) -> DataFrame:
    """Of a listing the wanted files of the first keys in order (all, if limit is 0); keys without such a file are skipped, but count."""
    if not limit:
        return listed.where(wanted)
    # The files are listed once: each key has its wanted ones beside it.
    columns = [c for c in listed.columns if c != "key"]
    each = listed.groupBy("key").agg(F.collect_list(F.when(wanted, F.struct(*columns))).alias("x"))
    return each.orderBy("key").limit(limit).select("key", F.explode("x").alias("x")).select(*(F.col("x")[c].alias(c) if c != "key" else F.col("key") for c in listed.columns))


def read_chosen(spark: SparkSession, files: DataFrame, schema: str, most: int = 10_000) -> DataFrame:
    """JSON lines of chosen files, with key; only these are read. More than `most` are an error: read the folder then, with with_file_key."""
    named = files.select("path", "key").limit(most + 1).collect()
    if len(named) > most:
        raise ValueError(f"more than {most} files")
    if not named:
        return spark.createDataFrame([], f"{schema}, key string")
    rows = spark.read.schema(schema).json([r.path for r in named]).withColumn("_at", F.col("_metadata.file_path"))
    tail = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    keys = spark.createDataFrame([(r.path, r.key) for r in named], "_path string, key string")
    return rows.join(keys, tail(F.col("_at")) == tail(F.col("_path"))).drop("_at", "_path")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("lineSep", "\n").json(path)


def load_source(spark: SparkSession, rows: int, users: int = 64, seed: int = 7) -> DataFrame:
    """Synthetic adds of one to five messages: (user_id, request_id, messages)."""
    n = (F.rand(seed) * 5).cast("int") + 1
    return spark.range(rows).select(F.concat(F.lit("u"), F.col("id") % users).alias("user_id"), F.concat(F.lit("r"), "id").alias("request_id"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("message "), i.cast("string"))).alias("messages"))


def memo(keys: DataFrame, log: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys with what a memo log of a schema (k, ...) knows of each; what it doesn't know is computed, a row a key, and written to it first.

    keys have column k; a key that compute leaves out has nulls. Of a key that two runs wrote at one time one row counts.
    """
    spark = keys.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(log)
    known = lambda: spark.read.schema(schema).parquet(log).dropDuplicates(["k"])
    compute(keys.join(known().select("k"), "k", "left_anti").dropDuplicates(["k"])).write.mode("append").parquet(log)
    return keys.join(known(), "k", "left")


def append_resumable(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], slices: int = 16, most: int | None = None) -> int:
    """Does the rows of todo that aren't done, a slice of ids at a time, and returns how many slices it committed.

    work gives (id, ..., error). A slice's rows are written first, and then its ids to the log of done ones:
    a run that breaks leaves no half of a slice behind, and the next one does what is missing. Rows that
    ended in an error are tried again. most: slices that a run does at most.
    """
    spark, count = todo.sparkSession, 0
    kind = dict(todo.dtypes)["id"]
    log = f"id {kind}, failed boolean, slice int, commit bigint"
    spark.createDataFrame([], f"id {kind}, failed boolean, slice int").write.mode("ignore").parquet(f"{path}/done/commit=0")
    sliced = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    done = spark.read.schema(log).parquet(f"{path}/done")
    left = todo.join(done.where("not failed").select("id"), "id", "left_anti").select(sliced.alias("s")).distinct()
    for (n,) in sorted(left.collect())[:most]:
        done = spark.read.schema(log).parquet(f"{path}/done")
        commit = (done.agg(F.max("commit")).head()[0] or 0) + 1
        rest = todo.where(sliced == n).join(done.where((F.col("slice") == n) & ~F.col("failed")).select("id"), "id", "left_anti")
        work(rest).write.mode("overwrite").parquet(f"{path}/rows/commit={commit}")
        rows = spark.read.parquet(f"{path}/rows/commit={commit}")
        rows.select("id", F.col("error").isNotNull().alias("failed"), F.lit(n).alias("slice")).write.mode("overwrite").parquet(f"{path}/done/commit={commit}")
        count += 1
    return count


def resumed_rows(spark: SparkSession, path: str) -> DataFrame:
    """What append_resumable has committed: each id once, by its last try."""
    done = spark.read.parquet(f"{path}/done").groupBy("id").agg(F.max("commit").alias("commit"))
    return spark.read.parquet(f"{path}/rows").join(done, ["id", "commit"]).drop("commit")
