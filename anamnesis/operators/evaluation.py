"""Evaluation: recall of evidence, event order, parsing of judgements, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def evidence_recall(gold: Column, context: Column) -> Column:
    """(recall, n): the share of gold's content words, repeats included, that the context has; 1 where gold has none."""
    # Both word lists are bound as lambda variables: else they would be cut again for each word.
    both = F.array(F.struct(T.content_words(gold).alias("words"), F.array_distinct(T.content_words(context)).alias("there")))

    def of(x: Column) -> Column:
        n = F.size(x["words"])
        hit = F.size(F.filter(x["words"], lambda w: F.array_contains(x["there"], w)))
        return F.struct(F.when(n > 0, hit / n).otherwise(1.0).alias("recall"), n.alias("n"))

    return F.transform(both, of)[0]


def recall_by(rows: DataFrame, *by: str) -> DataFrame:
    """Mean recall of rows (gold, context, by) whose gold has content words."""
    df = rows.withColumn("r", evidence_recall(F.col("gold"), F.col("context"))).where("r.n > 0")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("r.recall"), 6).alias("recall"))


def quadrants(rows: DataFrame, present: float = 0.6, right: float = 0.999) -> DataFrame:
    """Per category and in all: whether evidence was present (P) or absent (A) and the answer right (P) or wrong (W)."""
    df = rows.withColumn("r", evidence_recall(F.col("gold"), F.col("context"))).where("r.n > 0")
    there, good = F.col("r.recall") >= present, F.col("score") >= right
    n = lambda c: F.count_if(c)
    out = df.rollup("category").agg(n(there & good).alias("pp"), n(there & ~good).alias("pw"), n(~there & ~good).alias("aw"), n(~there & good).alias("ap"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "pp", "pw", "aw", "ap")


def kendall(a: Column, b: Column) -> Column:
    """Kendall's tau-b of two arrays of ranks of one length; zero where it isn't defined."""
    n = F.size(a)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda l: F.transform(F.sequence(l + 1, n - 1), lambda r: F.struct((F.get(a, l) - F.get(a, r)).alias("x"), (F.get(b, l) - F.get(b, r)).alias("y")))))
    pairs = F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    of = lambda test: F.size(F.filter(pairs, test)).cast("double")
    same = of(lambda p: p["x"] * p["y"] > 0)
    against = of(lambda p: p["x"] * p["y"] < 0)
    only_a = of(lambda p: (p["x"] == 0) & (p["y"] != 0))
    only_b = of(lambda p: (p["y"] == 0) & (p["x"] != 0))
    under = F.sqrt((same + against + only_a) * (same + against + only_b))
    return F.when(under > 0, (same - against) / under).otherwise(0.0)


def event_order(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, tau_norm and final_score of the arrays reference and system."""
    ref, sys_ = F.col("reference"), F.col("system")
    hit = F.size(F.array_intersect(ref, sys_))
    extra = F.size(F.filter(sys_, lambda x: ~F.array_contains(ref, x)))
    lost = F.size(F.filter(ref, lambda x: ~F.array_contains(sys_, x)))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    df = rows.withColumn("precision", share(hit, extra)).withColumn("recall", share(hit, lost))
    df = df.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    union = F.array_union(ref, sys_)

    def ranks(of: Column) -> Column:
        # Of an event named twice the last place counts.
        place = lambda x: F.size(of) - F.array_position(F.reverse(of), x) + 1
        return F.transform("_union", lambda x: F.when(F.array_contains(of, x), place(x)).otherwise(F.size("_union") + 1).cast("int"))

    df = df.withColumn("_union", union).withColumn("_a", ranks(ref)).withColumn("_b", ranks(sys_))
    df = df.withColumn("tau_norm", (kendall(F.col("_a"), F.col("_b")) + 1) / 2).drop("_union", "_a", "_b")
    return df.withColumn("final_score", F.col("tau_norm") * F.col("f1"))


def judge_label(answer: Column) -> Column:
    """CORRECT or WRONG, from the first braces of a judge's answer; null if it says neither."""
    label = F.upper(F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*?\}", 0), "$.label"))
    return F.when(label.isin("CORRECT", "WRONG"), label)


def rubric_scores(answer: Column, n: Column) -> Column:
    """The scores, in order of index, of a judge's answer on n rubrics; null unless each index comes once with 0, 0.5 or 1."""
    body = F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    found = F.from_json(F.get_json_object(F.regexp_extract(body, r"(?s)\{.*\}", 0), "$.scores"), "array<struct<index:int,score:double>>")
    order = F.array_sort(found)
    ok = (F.size(found) == n) & (F.transform(order, lambda x: x["index"]) == F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))) & F.forall(found, lambda x: x["score"].isin(0.0, 0.5, 1.0))
    return F.when(ok, F.transform(order, lambda x: x["score"]))


def scored() -> Column:
    return F.when(F.col("is_correct"), 1.0).otherwise(F.coalesce("llm_judge_score", F.lit(0.0)))


def accuracy_sets(judged: DataFrame) -> DataFrame:
    """Accuracy by category, by conversation, by kind of answer, and in all, in one pass."""
    df = judged.withColumn("timed", F.when(T.has(F.col("answer"), fixed.TIME_ANSWER), "time").otherwise("plain"))
    out = df.groupingSets([["category"], ["conversation"], ["timed"], []], "category", "conversation", "timed").agg(F.sum(F.col("is_correct").cast("int")).alias("right"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "conversation").when(F.col("g") == 6, "timed").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("category", "conversation", "timed", F.lit("TOTAL")).alias("name"), "right", "n", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))


def accuracy_rollup(judged: DataFrame) -> DataFrame:
    out = judged.rollup("category").agg(F.sum(F.col("is_correct").cast("int")).alias("right"), F.count("*").alias("n"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "right", "n")


def by_dimension(judged: DataFrame, dimensions: DataFrame, best: DataFrame) -> DataFrame:
    """Mean score by dimension, beside the best known; categories without a dimension count as '?'."""
    df = judged.join(F.broadcast(dimensions), "category", "left").groupBy(F.coalesce("dimension", F.lit("?")).alias("dimension")).agg(F.count("*").alias("n"), F.round(100 * F.avg(scored()), 6).alias("score"))
    return df.join(F.broadcast(best), "dimension", "left")


def mean_of_means(judged: DataFrame, dataset: str) -> DataFrame:
    """The mean over datasets of their mean scores, each weighing the same."""
    each = judged.groupBy(dataset).agg(F.avg(scored()).alias("s"))
    return each.agg(F.count("*").alias("datasets"), F.round(F.avg("s"), 6).alias("mean_score"))


def variant_delta(judged: DataFrame, baseline: str, variant: str) -> DataFrame:
    """Per dataset: scores of two variants and their difference. judged: (dataset, variant, ...)."""
    each = judged.groupBy("dataset", "variant").agg(F.avg(scored()).alias("s"))
    a = each.where(F.col("variant") == baseline).select("dataset", F.col("s").alias("a"))
    b = each.where(F.col("variant") == variant).select("dataset", F.col("s").alias("b"))
    return a.join(b, "dataset").select("dataset", F.round("a", 6).alias("baseline"), F.round("b", 6).alias("variant"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def nearest_rank(values: DataFrame, value: str, shares: dict[str, float], ceil: bool = True) -> DataFrame:
    """Percentiles as values of the sorted column: at int(share * n) - 1 from 0, at least 0; without ceil at int(share * n)."""
    n = values.count()
    order = values.select(value).orderBy(value)
    picks = {name: max(0, min(n - 1, int(q * n) - (1 if ceil else 0))) for name, q in shares.items()}
    # Sorted ranges are numbered one by one; only the few wanted rows are kept.
    numbered = order.withColumn("_part", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("c"), F.min("_m").alias("first"))
    starts = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = numbered.join(F.broadcast(starts), "_part").select(value, (F.col("_m") - F.col("first") + F.col("before")).alias("k"))
    return at.agg(*(F.max(F.when(F.col("k") == k, F.col(value))).alias(name) for name, k in picks.items()))


def resume(todo: DataFrame, done: DataFrame) -> DataFrame:
    """What is not done yet; rows that ended in an error count as not done."""
    return todo.join(done.where(F.col("error").isNull()), "id", "left_anti")


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, missing): ids that only one side has, and in which they're missing."""
    x, y = a.select("id").distinct().withColumn("in_a", F.lit(1)), b.select("id").distinct().withColumn("in_b", F.lit(1))
    return x.join(y, "id", "full_outer").where("in_a is null or in_b is null").select("id", F.when(F.col("in_a").isNull(), "a").otherwise("b").alias("missing"))


def wrong_sample(judged: DataFrame, per_category: int) -> DataFrame:
    """The first wrong answers of each category."""
    n = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    return judged.where(scored() < 1).withColumn("n", n).where(F.col("n") <= per_category).select("category", "id", "n")


def corpus_profile(messages: DataFrame) -> DataFrame:
    """Sizes of the conversations: sessions and words a user, in all."""
    words = F.size(T.blank_tokens(F.col("content")))
    each = messages.groupBy("user_id").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("messages"), F.sum(words).alias("words"))
    return each.agg(F.count("*").alias("users"), F.round(F.avg("sessions"), 6).alias("mean_sessions"), F.min("sessions").alias("min_sessions"), F.max("sessions").alias("max_sessions"), F.sum("messages").alias("messages"), F.sum("words").alias("words"))


def units_per_user(units: DataFrame) -> DataFrame:
    return units.groupBy("user_id").agg(F.count("*").alias("units"))


def entity_stats(postings: DataFrame, least: int = 2) -> DataFrame:
    """Per user: entities that are frequent enough, and all."""
    each = postings.groupBy("user_id", "entity").agg(F.count("*").alias("df"))
    return each.groupBy("user_id").agg(F.count_if(F.col("df") >= least).alias("active"), F.count("*").alias("raw"))


def answer_mix(judged: DataFrame) -> DataFrame:
    """Per category: its share of all rows, and the shares of its answers with a time and with a number."""
    df = judged.groupBy("category").agg(F.count("*").alias("n"), F.count_if(T.has(F.col("answer"), fixed.TIME_ANSWER)).alias("timed"), F.count_if(F.col("answer").rlike(r"\d")).alias("numbered"))
    df = df.withColumn("whole", F.sum("n").over(Window.partitionBy()))
    share = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return df.select("category", "n", share("n", "whole").alias("share"), share("timed", "n").alias("timed"), share("numbered", "n").alias("numbered"))


def evidence_spread(evidence: DataFrame) -> DataFrame:
    """Questions whose evidence lies in several sessions, and pieces of evidence a question. evidence: (id, session)."""
    each = evidence.groupBy("id").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("pieces"))
    return each.agg(F.count("*").alias("questions"), F.count_if(F.col("sessions") > 1).alias("across"), F.round(F.avg("pieces"), 6).alias("mean_pieces"), F.max("pieces").alias("most_pieces"))


def message_lengths(messages: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile (by rank) of the characters of messages."""
    sized = messages.select(F.length("content").alias("n"))
    means = sized.agg(F.round(F.avg("n"), 6).alias("mean_chars"), F.median("n").alias("median_chars"), F.lit(1).alias("k"))
    return means.join(nearest_rank(sized, "n", {"p95": 0.95}, ceil=False).withColumn("k", F.lit(1)), "k").drop("k")
