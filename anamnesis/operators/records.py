"""Records of evaluation files as VARIANT values: fields under several names, lists of any depth as text, evidence and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import kept
from .evaluation import evidence_recall

GOLD = ("gold_answer", "golden_answer", "reference_answer", "correct_answer")
#: Strings and what else stands before the next separator, and this: objects are shown with a space after each.
SEPARATED = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])'


def field(record: Column, *keys: str) -> Column:
    """The value (variant) of the first key that a record has, a JSON null included; null if it has none."""
    return F.coalesce(*(F.variant_get(record, f"$.{k}", "variant") for k in keys))


def kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING, BOOLEAN, VOID, or a number's type."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def shown(value: Column, raw: Column) -> Column:
    """A value that isn't a list as text: falsy ones as nothing, objects as JSON in their own order (raw), true as True."""
    of, text = kind(value), F.variant_get(value, "$", "string")
    number = F.when(F.try_variant_get(value, "$", "double") == 0, "").otherwise(text)
    return (
        F.when(value.isNull() | (of == "VOID"), "")
        .when(of == "STRING", text)
        .when(of == "BOOLEAN", F.when(text == "true", "True").otherwise(""))
        .when(of == "OBJECT", F.regexp_replace(raw, SEPARATED, "$1$2 "))
        .otherwise(number)
    )


def texts(records: DataFrame, value: str = "value") -> DataFrame:
    """(id, text) of records (id, value), value JSON text: strings as they are, lists line by line at any depth, objects as JSON.

    Lists are walked a level at a time, all records at once: the items of each level's lists are its rows,
    and a last sort by path puts a record's lines together. An empty list is an empty line. Text that isn't JSON is an error.
    """
    level = kept(records.select("id", F.get_json_object(value, "$").alias("raw"), F.parse_json(F.col(value)).alias("v"), F.array().cast("array<int>").alias("path")), "level")
    done = None
    while True:
        listed = F.coalesce((kind(F.col("v")) == "ARRAY") & (F.to_json("v") != "[]"), F.lit(False))
        leaves = level.where(~listed)
        empty = F.coalesce(kind(F.col("v")) == "ARRAY", F.lit(False))
        leaves = leaves.select("id", "path", F.when(empty, "").otherwise(shown(F.col("v"), F.col("raw"))).alias("line"))
        done = leaves if done is None else done.unionByName(leaves)
        inner = level.where(listed)
        if not inner.head(1):
            break
        items = inner.select("id", "raw", "path", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("pos", "v"))
        raw = F.call_function("get_json_object", F.col("raw"), F.concat(F.lit("$["), F.col("pos").cast("string"), F.lit("]")))
        # Kept, so that a level isn't made again from the first for each one below.
        level = kept(items.select("id", raw.alias("raw"), "v", F.concat("path", F.array("pos")).alias("path")), "level")
    lines = done.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("x"))
    return lines.select("id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def gold_texts(records: DataFrame) -> DataFrame:
    """(id, text): the gold answers of records (id, record), record JSON text; a record without one under any name is an error."""
    parsed = records.select("id", "record", F.parse_json("record").alias("p"))
    first = F.coalesce(*(F.when(F.variant_get("p", f"$.{k}", "variant").isNotNull(), F.lit(k)) for k in GOLD))
    parsed = parsed.select("id", "record", field(F.col("p"), *GOLD).alias("gold"), first.alias("first"))
    gold, first = F.col("gold"), F.col("first")
    found = F.coalesce(F.to_json(gold), F.raise_error(F.lit("no gold answer")).cast("string"))
    # Of an object or list its own text keeps the order of keys; scalars are taken as VARIANT shows them.
    own = F.coalesce(*(F.when(first == k, F.get_json_object("record", f"$.{k}")) for k in GOLD))
    value = F.when(kind(gold).isin("ARRAY", "OBJECT"), own).otherwise(found)
    return texts(parsed.select("id", value.alias("value")))


def evidence_text(gold: Column, rubric: Column, evidence: Column) -> Column:
    """What an answer's evidence is held against: marked evidence, else the gold answer, else the rubric's items. evidence and rubric are arrays."""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    blank = F.coalesce(gold, F.lit("")).rlike(r"(?U)^\s*$")
    return F.when(some(evidence), F.array_join(evidence, " ")).when(~blank, gold).when(some(rubric), F.array_join(rubric, " ")).otherwise("")


def recall_with_evidence(inputs: DataFrame, evidence: DataFrame, by: str = "category") -> DataFrame:
    """(name, n, recall) for each category and in all (TOTAL) of inputs (id, by, gold, rubric, context), with marked evidence (id, evidence) where there is some.

    Inputs whose evidence has no content words don't count.
    """
    met = inputs.join(evidence.select("id", "evidence"), "id", "left")
    target = evidence_text(F.col("gold"), F.col("rubric"), F.col("evidence"))
    told = met.withColumn("r", evidence_recall(target, F.coalesce("context", F.lit("")))).where("r.n > 0")
    out = told.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg("r.recall"), 6).alias("recall"), F.grouping(by).alias("g"))
    return out.where("n > 0").select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(by)).alias("name"), "n", "recall")


def scored_inputs(inputs: DataFrame, judged: DataFrame) -> DataFrame:
    """inputs with the score of their judgement (id, at, llm_judge_score, is_correct), the last of an id; inputs without one, or without a score, go."""
    last = judged.groupBy("id").agg(F.max_by(F.struct("llm_judge_score", "is_correct"), "at").alias("j"))
    score = F.coalesce(F.col("j.llm_judge_score"), F.col("j.is_correct").cast("double"))
    return inputs.join(last, "id").withColumn("score", score).drop("j").where("score is not null")


def done_answers(answers: DataFrame) -> DataFrame:
    """Answers (id, answer, error) that count as done: without an error, and not blank."""
    blank = F.coalesce("answer", F.lit("")).rlike(r"(?U)^\s*$")
    return answers.where(F.col("error").isNull() & ~blank)


def wrong_of(judged: DataFrame, inputs: DataFrame, words: str) -> DataFrame:
    """(id, category, question, gold, answer, recall, n): wrong answers whose category contains words, in any case; long texts are cut for the report.

    judged: (id, is_correct, llm_judge_score, answer); a score counts before is_correct. inputs: (id, category, question, gold, context).
    """
    right = F.when(F.col("llm_judge_score").isNotNull(), F.col("llm_judge_score") >= 1).otherwise(F.coalesce("is_correct", F.lit(False)))
    met = judged.where(~right).join(inputs, "id", "left").withColumn("category", F.coalesce("category", F.lit("?")))
    met = met.where(F.contains(F.lower("category"), F.lit(words.lower())))
    cut = lambda c, n: F.translate(F.substring(F.coalesce(c, F.lit("")), 1, n), "\n", " ").alias(c)
    r = evidence_recall(F.coalesce("gold", F.lit("")), F.coalesce("context", F.lit("")))
    return met.withColumn("r", r).select("id", "category", cut("question", 180), cut("gold", 150), cut("answer", 150), F.round("r.recall", 6).alias("recall"), F.col("r.n").alias("n"))

