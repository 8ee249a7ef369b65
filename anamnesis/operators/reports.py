"""Reports over judged rows, joined with the inputs and answers they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def last_rows(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each id in order."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def with_inputs(judged: DataFrame, inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """judged (id, ...) beside category and gold of inputs (id, at, ...) and the answer of answers (id, at, answer).

    Of rows with one id the last counts; without input the category is '?', other texts that lack are empty.
    """
    a = last_rows(inputs.select("id", "at", "category", "gold"), "at").drop("at")
    b = last_rows(answers.select("id", "at", "answer"), "at").drop("at")
    df = judged.join(a, "id", "left").join(b, "id", "left")
    return df.withColumns({"category": F.coalesce("category", F.lit("?")), "gold": F.coalesce("gold", F.lit("")), "answer": F.coalesce("answer", F.lit(""))})


def score_sets(rows: DataFrame) -> DataFrame:
    """Right answers by category, by whether gold has a time, by whether only the answer has a relative one, and in all."""
    relative = T.has(F.col("answer"), fixed.RELATIVE_ANSWER) & ~T.has(F.col("gold"), fixed.RELATIVE_ANSWER)
    df = rows.withColumn("timed", F.when(T.has(F.col("gold"), fixed.TIME_ANSWER), "time").otherwise("plain")).withColumn("relative", F.when(relative, "relative").otherwise("fixed"))
    out = df.groupingSets([["category"], ["timed"], ["relative"], []], "category", "timed", "relative").agg(F.sum(F.col("is_correct").cast("int")).alias("right"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "timed").when(F.col("g") == 6, "relative").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("category", "timed", "relative", F.lit("TOTAL")).alias("name"), "right", "n")


def group_totals(rows: DataFrame, group: str) -> DataFrame:
    """Per group: rows, errors, and the mean score in per cent; a row without a score counts as zero."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.round(100 * F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("total"))


def rubric_mean(scores: Column) -> Column:
    """The mean of a row's rubric scores; null where it has none."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
