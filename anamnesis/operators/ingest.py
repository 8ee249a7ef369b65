"""Ingest: idempotent batches, sequence numbers, and the units that messages are stored as."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import models


def first_requests(batches: DataFrame) -> DataFrame:
    """Drops rows of a (user_id, request_id) that came before; rows without a request_id all stay."""
    named = F.coalesce(F.col("request_id"), F.lit("")) != ""
    first = batches.where(named).groupBy("user_id", "request_id").agg(F.min_by(F.struct(*batches.columns), "arrival").alias("x")).select("x.*")
    return first.unionByName(batches.where(~named)).select(*batches.columns)


def assign_seq(messages: DataFrame, order: list[str], part: Column) -> DataFrame:
    """Adds seq: 0, 1, 2 ... for each user in order.

    part must not fall in that order (a day, a range of ids). Tasks number within a part; parts are
    then placed by their counts, so that a user of any size is numbered by many tasks.
    """
    df = messages.withColumn("_part", part)
    base = df.groupBy("user_id", "_part").count()
    before = Window.partitionBy("user_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("user_id", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = df.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "_part").orderBy(*order)))
    return inside.join(base, ["user_id", "_part"]).withColumn("seq", F.col("_base") + F.col("_n") - 1).drop("_part", "_n", "_base")


def message_line(role: Column, ts: Column, content: Column) -> Column:
    """[date] role: content, without the date where that is unknown."""
    return F.concat(F.when(T.known(ts), F.concat(F.lit("["), T.date_text(ts, "yyyy-MM-dd"), F.lit("] "))).otherwise(""), role, F.lit(": "), content)


def in_order(messages: DataFrame, by: list[str]) -> DataFrame:
    """by and an array of (seq, role, ts, content) in order of seq."""
    return messages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "ts", "content"))).alias("m"))


def joined_lines(m: Column) -> Column:
    lines = F.array_join(F.transform(m, lambda x: message_line(x["role"], x["ts"], x["content"])), "\n")
    first = m[0]["ts"]
    return F.concat(F.when(T.known(first), F.concat(F.lit("["), T.date_text(first, "yyyy-MM-dd"), F.lit("]\n"))).otherwise(""), lines)


def message_units(messages: DataFrame) -> DataFrame:
    """A unit a message, with its index text."""
    return messages.select("user_id", "session_id", "seq", "content", T.index_text(F.col("role"), F.col("ts"), F.col("content")).alias("index_text"))


def chunk_units(messages: DataFrame) -> DataFrame:
    """A unit a session: roles, first known time and joined lines."""
    df = in_order(messages, ["user_id", "session_id"])
    m = F.col("m")
    ts = F.get(F.filter(F.transform(m, lambda x: x["ts"]), lambda t: T.known(t)), F.lit(0))
    roles = F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["role"]))), "/")
    body = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    df = df.select("user_id", "session_id", roles.alias("role"), ts.alias("ts"), body.alias("content"))
    return df.withColumn("index_text", F.concat(F.lit("Speakers: "), "role", F.lit("\nEvent date: "), T.date_text(F.col("ts")), F.lit("\n"), "content"))


def session_units(messages: DataFrame) -> DataFrame:
    df = in_order(messages, ["user_id", "session_id"])
    return df.select("user_id", "session_id", joined_lines(F.col("m")).alias("content"), F.col("m")[0]["ts"].alias("ts"))


def line_units(messages: DataFrame) -> DataFrame:
    return messages.select("user_id", "session_id", "seq", message_line(F.col("role"), F.col("ts"), F.col("content")).alias("content"), "ts")


def window_units(messages: DataFrame, window: int = 10, overlap: int = 0) -> DataFrame:
    """A unit a sliding window of messages; the first window that reaches the end is the last."""
    step = max(1, window - overlap)
    df = in_order(messages, ["user_id", "session_id"])
    n = F.size("m")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    df = df.withColumn("start", F.explode(starts)).where((F.col("start") == 0) | (F.col("start") - step + window < n))
    part = F.slice("m", F.col("start") + 1, F.lit(window))
    return df.select("user_id", "session_id", "start", joined_lines(part).alias("content"))


def packed_units(messages: DataFrame, by: list[str], most: int = 20, words: int = 2000) -> DataFrame:
    """(by, chunk, n, words): messages packed in order into chunks of at most `most` and `words` words; a longer message is alone.

    A fold over the array of sizes of one group.
    """
    sized = messages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", F.size(T.blank_tokens(F.col("content"))).alias("w")))).alias("m"))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("words"), F.array().cast("array<struct<chunk:int,w:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["words"] + x["w"] > words))
        chunk = a["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x["w"]).otherwise(a["words"] + x["w"]).alias("words"), F.concat(a["out"], F.array(F.struct(chunk.alias("chunk"), x["w"].alias("w")))).alias("out"))

    placed = sized.select(*by, F.explode(F.aggregate("m", zero, step)["out"]).alias("x"))
    return placed.groupBy(*by, F.col("x.chunk").alias("chunk")).agg(F.count("*").alias("n"), F.sum("x.w").alias("words"))


def word_slices(texts: DataFrame, key: str, size: int = 2000) -> DataFrame:
    """(key, part, content): texts cut into slices of size words."""
    words = T.blank_tokens(F.col("text"))
    df = texts.select(key, words.alias("w")).where(F.size("w") > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))))
    return df.select(key, "part", F.array_join(F.slice("w", F.col("part") * size + 1, F.lit(size)), " ").alias("content"))


#: Ends of a line of a model's answer.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def card_units(messages: DataFrame, log: str, make: Callable[[], Callable[[str], str]], prompt: str = "", **how) -> DataFrame:
    """(user_id, session_id, place, content, ts, is_card): a unit a session, and after it the fact cards that a model made of it.

    Lines of an answer that start with a bracket are cards, without spaces and dashes around. A session is
    asked for once (models.remembered); a failing call gives no cards, and its session stays.
    """
    told = session_units(messages).withColumn("id", F.struct("user_id", "session_id"))
    said = models.remembered(told.select("id", F.concat(F.lit(prompt), "content").alias("prompt")), log, make, **how)
    lines = F.filter(F.split(F.coalesce("answer", F.lit("")), LINE_END, -1), lambda x: F.regexp_replace(x, r"(?U)^\s+", "").startswith("["))
    cards = told.select("id", "ts").join(said, "id").select("id", "ts", F.posexplode(F.transform(lines, lambda x: F.btrim(x, F.lit(" -")))).alias("n", "content"))
    columns = ["id.user_id", "id.session_id", "place", "content", "ts", "is_card"]
    units = told.withColumn("place", F.lit(0)).withColumn("is_card", F.lit(False)).select(*columns)
    return units.unionByName(cards.withColumn("place", F.col("n") + 1).withColumn("is_card", F.lit(True)).select(*columns))


STRATEGIES = {"session": session_units, "message": line_units, "window": window_units, "llm_cards": card_units}
