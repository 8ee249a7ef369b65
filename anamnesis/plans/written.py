"""Registered queries over records and files, some of which they write first, and the SQL of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..session import table
from ..sources import bindings, files
from ..sources.batches import shared_folder
from . import oracle as O

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def nested_texts(spark, sf):
    """Gold answers of written records, under one of four names: nested lists, texts, numbers and objects as text."""
    d = table(spark, sf, "documents")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"^\[|\]$", "")
    n, text, lang = (F.col("doc_id") + 1).cast("string"), quoted(F.col("text")), quoted(F.col("lang"))
    thing = F.concat(F.lit('{"k":'), n, F.lit(',"l":'), lang, F.lit(',"x":[1,2],"b":{"c":null}}'))
    nest = F.concat(F.lit('[["a",['), text, F.lit(',["deep",'), n, F.lit("]]],"), thing, F.lit(",true,false,0,null,[],1.5]"))
    k = F.col("doc_id") % 4
    value = F.when(k == 0, nest).when(k == 1, text).when(k == 2, n).otherwise(thing)
    name = F.when(k == 0, "golden_answer").when(k == 1, "gold_answer").when(k == 2, "correct_answer").otherwise("reference_answer")
    at = shared_folder(spark, "records")
    d.select(F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"'), name, F.lit('":'), value, F.lit("}")).alias("value")).write.text(at)
    lines = spark.read.text(at, lineSep="\n").select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.col("value").alias("record"))
    return records.gold_texts(lines).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def recall_with_total(spark, sf):
    """Recall of each category and in all, of marked evidence, or else the gold answer, or else rubric items."""
    k = F.col("doc_id") % 3
    told = bindings.recall_rows(spark, sf).withColumn("id", F.col("doc_id"))
    inputs = told.select("id", "category", "context", F.when(k == 1, F.col("gold")).otherwise(" \n").alias("gold"), F.when(k == 2, F.split("gold", " ")).alias("rubric"))
    evidence = told.where(k == 0).select("id", F.split("gold", " ").alias("evidence"))
    return records.recall_with_evidence(inputs, evidence)


@query
def scored_inputs(spark, sf):
    """Documents with the last of their judgements, a score before right or wrong."""
    inputs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    mark = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.col("quality") / 2).alias("llm_judge_score"), F.when(F.col("doc_id") % 5 > 0, F.col("quality") == 1).alias("is_correct"))
    judged = mark.withColumn("at", F.lit(1)).unionByName(mark.where("id % 2 = 0").withColumn("at", F.lit(2)).withColumn("llm_judge_score", F.lit(0.25)))
    return records.scored_inputs(inputs, judged)


@query
def answers_to_redo(spark, sf):
    """Documents that have no answer yet: none, a blank one, or one that ended in an error."""
    d, label = table(spark, sf, "documents"), table(spark, sf, "labels")
    answers = label.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "yes").otherwise(" \n").alias("answer"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return d.select(F.col("doc_id").alias("id")).join(records.done_answers(answers).select("id"), "id", "left_anti")


@query
def wrong_by_words(spark, sf):
    """Wrong answers of categories whose name contains an E, with the recall of their gold answer."""
    told = bindings.recall_rows(spark, sf)
    inputs = told.select(F.col("doc_id").alias("id"), "category", F.col("gold").alias("question"), "gold", "context")
    judged = told.select(F.col("doc_id").alias("id"), (F.col("score") == 1).alias("is_correct"), F.when(F.col("doc_id") % 3 == 0, F.lit(0.5)).alias("llm_judge_score"), F.col("context").alias("answer"))
    return records.wrong_of(judged, inputs, "E").select("id", "category", F.md5(F.col("gold").cast("binary")).alias("gold"), F.md5(F.col("answer").cast("binary")).alias("answer"), "recall", "n")


def library_files(spark, sf, at):
    """Conversations as libraries, a folder each; every third has no chat."""
    c = table(spark, sf, "conversations").withColumn("lib", F.lpad(F.col("conv_id").cast("string"), 9, "0"))
    chat = c.where("conv_id % 3 <> 1").withColumn("kind", F.lit("chat"))
    ask = c.where("turn = 0").withColumn("kind", F.lit("questions"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = chat.unionByName(ask).select("lib", "kind", "turn", "role", "text").repartition(tasks, "lib")
    # Tasks move their own files to their place: with version 1 the driver moves all of them, one after the other.
    told.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("lib", "kind").json(at)


@query
def listed_libraries(spark, sf):
    """Messages of the first 60 libraries in order of name, those without a chat skipped; only the chosen files are read."""
    at = shared_folder(spark, "libraries")
    library_files(spark, sf, at)
    picked = files.chosen(files.listing(spark, at, "/lib=([0-9]+)/"), F.col("path").contains("/kind=chat/"), 60)
    told = files.read_chosen(spark, picked, "turn bigint, role string, text string")
    return told.groupBy(F.col("key").cast("bigint").alias("library")).agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


@query
def persona_histories(spark, sf):
    """Questions with the size of their persona's history, which is read once a persona; nothing where there is no history."""
    at = shared_folder(spark, "personas")
    library_files(spark, sf, at)
    asked = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 150).alias("persona"))
    listed = files.listing(spark, at, "/lib=([0-9]+)/").where(F.col("path").contains("/kind=chat/"))
    wanted = listed.join(asked.select(F.lpad(F.col("persona").cast("string"), 9, "0").alias("key")).distinct(), "key", "left_semi")
    told = files.read_chosen(spark, wanted, "turn bigint, role string, text string")
    each = told.groupBy(F.col("key").cast("bigint").alias("persona")).agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))
    return asked.join(each, "persona", "left").select("item_id", "persona", F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"), F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"))


THING = """'{"k": ' || (doc_id + 1) || ', "l": "' || lang || '", "x": [1, 2], "b": {"c": null}}'"""
ORACLE_SQL = {
    "nested_texts": f"""select doc_id as id, md5(case doc_id % 4 when 0 then 'a' || chr(10) || text || chr(10) || 'deep' || chr(10) || (doc_id + 1) || chr(10) || {THING} || chr(10) || 'True' || repeat(chr(10), 5) || '1.5'
        when 1 then text when 2 then (doc_id + 1)::varchar else {THING} end) as digest from documents""",
    "recall_with_total": f"with {O.RECALL} select coalesce(category, 'TOTAL') as name, count(*) as n, round(avg(recall), 6) as recall from re group by rollup (category)",
    "scored_inputs": """select doc_id as id, lang as category, case when doc_id % 2 = 0 then 0.25 when toxic = 0 then quality / 2 else quality end::double as score
        from documents join labels using (doc_id) where doc_id % 2 = 0 or toxic = 0 or doc_id % 5 > 0""",
    "answers_to_redo": "select doc_id as id from documents where doc_id not in (select doc_id from labels where quality = 1 and toxic <> 1)",
    "wrong_by_words": f"""with w as (select doc_id as id, d.lang as category, b.text as gold, d.text as answer, {O.content('b.text')} as g, {O.content('d.text')} as c
            from documents d join labels using (doc_id) join benchmark b on d.doc_id % (select count(*) from benchmark) = item_id where (doc_id % 3 = 0 or quality <> 1) and d.lang like '%e%')
        select id, category, md5(replace(left(gold, 150), chr(10), ' ')) as gold, md5(replace(left(answer, 150), chr(10), ' ')) as answer,
            round(case when len(g) > 0 then len(list_filter(g, lambda x: list_contains(c, x))) / len(g) else 1.0 end, 6) as recall, len(g)::int as n from w""",
    "listed_libraries": """with k as (select conv_id from (select distinct conv_id from conversations order by 1 limit 60) where conv_id % 3 <> 1)
        select conv_id as library, count(*) as messages, sum(length(text))::bigint as chars from conversations join k using (conv_id) group by 1""",
    "persona_histories": """with h as (select conv_id, count(*) as messages, sum(length(text))::bigint as chars from conversations where conv_id % 3 <> 1 group by 1)
        select item_id, item_id % 150 as persona, coalesce(messages, 0)::bigint as messages, coalesce(chars, 0)::bigint as chars from benchmark left join h on conv_id = item_id % 150""",
}
