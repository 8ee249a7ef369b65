"""Preparing evaluation inputs: fields under several names, times, prompts, questions and histories."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: First message day of data without times.
FIRST_DAY = 1704067200000


def first_present(record: Column, *keys: str) -> Column:
    """The value of the first key that a JSON record has, null included; an error if it has none."""
    here = F.json_object_keys(record)
    out = None
    for k in keys:
        test, value = F.array_contains(here, k), F.get_json_object(record, f"$.{k}")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.raise_error(F.lit(f"none of {', '.join(keys)}")).cast("string"))


def first_filled(record: Column, *keys: str) -> Column:
    """The first value that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in keys), F.lit(""))


def gold(record: Column) -> Column:
    return first_present(record, "gold_answer", "golden_answer", "reference_answer", "correct_answer")


def ideal(record: Column) -> Column:
    return first_filled(record, "ideal_response", "ideal_answer", "ideal_summary", "answer")


def context(record: Column) -> Column:
    """The context under any of its names, or else both speakers' memories."""
    speakers = F.concat_ws("\n\n", F.get_json_object(record, "$.speaker_1_memories"), F.get_json_object(record, "$.speaker_2_memories"))
    return F.coalesce(*(F.get_json_object(record, f"$.{k}") for k in ("context", "retrieved_context", "memories")), F.nullif(speakers, F.lit("")), F.raise_error(F.lit("no context")).cast("string"))


def category(record: Column, kind_first: bool = True) -> Column:
    keys = ("question_type", "category", "cat", "type") if kind_first else ("category", "question_type", "cat", "type")
    return F.coalesce(*(F.get_json_object(record, f"$.{k}") for k in keys), F.lit("?"))


def flat_text(value: Column) -> Column:
    """A JSON value as text: lists line by line, objects as JSON, null and false as nothing."""
    items = F.from_json(value, "array<string>")
    listed = F.array_join(F.filter(items, lambda x: x.isNotNull()), "\n")
    return F.when(value.isNull() | value.isin("", "null", "false", "0"), "").when(value.startswith("["), F.coalesce(listed, value)).otherwise(value)


def rubrics(record: Column) -> Column:
    """The rubric texts of a record, as strings or objects under several names, trimmed and not empty."""
    raw = F.coalesce(*(F.get_json_object(record, f"$.{k}") for k in ("rubric_nuggets", "rubrics", "rubric")))
    items = F.from_json(raw, "array<string>")
    named = lambda x: F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in ("rubric_criteria", "criterion", "text")), x)
    out = F.filter(F.transform(items, lambda x: F.trim(F.when(x.startswith("{"), named(x)).otherwise(x))), lambda x: x != "")
    return F.when(F.coalesce(F.size(out), F.lit(0)) > 0, out)


def time_of(text: Column) -> Column:
    """Epoch milliseconds, in UTC, of '7:55 pm on 9 June, 2023', '2023/05/20 (Sat) 02:21' (its day) or 'March-15-2024'; else null."""
    forms = ["h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy"]
    tidy = F.regexp_replace(F.regexp_replace(text, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    found = [F.try_to_timestamp(tidy, F.lit(f)) for f in forms]
    found += [F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy/MM/dd")), F.try_to_timestamp(text, F.lit("MMMM-d-yyyy"))]
    return F.unix_millis(F.coalesce(*found))


def made_up_time(batch: Column) -> Column:
    return F.lit(FIRST_DAY) + batch * 86400000


def filled(template: str, values: dict[str, Column], form: str = r"\{\{(\w+)\}\}") -> Column:
    """A template with its places filled in one pass: what is put in isn't looked at again."""
    parts, at = [], 0
    for m in re.finditer(form, template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] in values else F.lit(m[0])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def context_text(picked: DataFrame) -> DataFrame:
    """(query_id, context): the results of each query as one text, in order. picked: (query_id, pos, id, content)."""
    each = F.concat(F.lit("[memory "), "id", F.lit("] "), "content")
    rows = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", each.alias("t")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("context"))


def mean_context(contexts: DataFrame) -> DataFrame:
    return contexts.agg(F.floor(F.coalesce(F.sum(F.length("context")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_chars"))


def kept_lines(text: Column, start: str = "[") -> Column:
    """The lines of a model's answer that start as they should, without dashes and spaces around."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" -"))), lambda x: x.startswith(start))


def literal_content(text: Column) -> Column:
    """The content of a Python literal of a message, or the text as it is; literals only, nothing is run."""

    def one(literal):
        try:
            return ast.literal_eval(literal)["content"]
        except (ValueError, SyntaxError, TypeError, KeyError, MemoryError, RecursionError):
            return literal

    def contents(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(contents, StringType())(text)


def conversation_of(name: Column) -> Column:
    return F.substring_index(name, "#", 1)


def question_and_history(dialogues: DataFrame) -> DataFrame:
    """(id, question, history): the last message of each dialogue (or the last user message, if it isn't one) and what stands before it.

    dialogues: (id, messages array of (role, content)). Of equal messages the first is taken for the place.
    """
    m = F.col("messages")
    asks = F.filter(m, lambda x: x["role"] == "user")
    last = F.when(F.element_at(m, -1)["role"] == "user", F.element_at(m, -1)).otherwise(F.coalesce(F.try_element_at(asks, F.lit(-1)), F.element_at(m, -1)))
    df = dialogues.where(F.size("messages") > 0).withColumn("q", last)
    return df.select("id", F.col("q.content").alias("question"), F.slice("messages", 1, F.array_position("messages", F.col("q")) - 1).alias("history"))


def flat_questions(records: DataFrame) -> DataFrame:
    """(id, question_type, question): a row a question of a map of types to lists. records: (user_id, questions map<string, array<string>>)."""
    each = records.select("user_id", F.explode("questions").alias("question_type", "list")).select("user_id", "question_type", F.posexplode("list").alias("n", "question"))
    return each.select(F.concat("user_id", F.lit("#"), "question_type", F.lit("_"), F.col("n").cast("string")).alias("id"), "question_type", "question")


def zipped(records: DataFrame, a: str, b: str) -> DataFrame:
    """A row a pair of two arrays, by position, as far as the shorter goes."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.slice(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), F.lit(1), n)
    return records.select("id", F.posexplode(pairs).alias("n", "p")).select("id", "n", F.col("p.x").alias(a), F.col("p.y").alias(b))


def batches_of(messages: DataFrame, size: int = 20) -> DataFrame:
    return messages.withColumn("batch", F.floor(F.col("seq") / size))
