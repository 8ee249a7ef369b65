"""Shared-folder tables and small helpers of the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, so that one Arrow batch is never wholly duplicated.
SLICE = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is absent, a local session (tests) gets a temporary folder; a cluster fails, as
    its machines share no folder that could be guessed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = local_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="anamnesis-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int = 4 * SLICE) -> Iterator[None]:
    """What is run meanwhile sends Python so many rows at a time at most, so that a task holds few texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole(df: DataFrame) -> Column:
    """A row as one column, so that none of its names can clash with others."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def free_name(df: DataFrame, name: str) -> str:
    """name, or as many underscores before it as it takes for df not to have it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def rows(batch, *columns: str) -> Iterator[tuple]:
    """The named columns of an Arrow batch as Python tuples, a slice at a time."""
    for at in range(0, batch.num_rows, SLICE):
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).slice(at, SLICE).to_pylist() for c in columns))
