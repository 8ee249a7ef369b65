import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import evaluation, models, prep
from anamnesis.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_fields_under_several_names(spark):
    x = F.col("x")
    assert one(spark, prep.gold(x), '{"golden_answer": "a", "correct_answer": "b"}') == "a"
    with pytest.raises(Exception, match="none of"):
        one(spark, prep.gold(x), "{}")
    assert one(spark, prep.ideal(x), '{"ideal_response": "", "answer": "z"}') == "z"
    assert one(spark, prep.context(x), '{"speaker_1_memories": "p", "speaker_2_memories": "q"}') == "p\n\nq"
    assert one(spark, prep.category(x, False), '{"question_type": "t", "category": "c"}') == "c"
    assert one(spark, prep.rubrics(x), '{"rubric": [" a ", {"criterion": "b"}, ""]}') == ["a", "b"]
    assert one(spark, prep.rubrics(x), '{"rubric": []}') is None
    assert one(spark, prep.flat_text(x), '["a", "b"]') == "a\nb" and one(spark, prep.flat_text(x), None) == ""


def test_times(spark):
    x = F.col("x")
    for text, want in (("7:55 pm on 9 June, 2023", 1686340500000), ("2023/05/20 (Sat) 02:21", 1684540800000), ("March-15-2024", 1710460800000), ("soon", None)):
        assert one(spark, prep.time_of(x), text) == want


def test_templates_are_filled_once(spark):
    assert one(spark, prep.filled("Q: {{q}} {{other}} C: {{c}}", {"q": F.col("x"), "c": F.lit("{{q}}")}), "{{c}}") == "Q: {{c}} {{other}} C: {{q}}"


def test_dialogues(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b"), ("user", "c")]), (2, [("user", "a"), ("assistant", "b")]), (3, [])], f"id int, messages {m}")
    got = {r.id: (r.question, len(r.history)) for r in prep.question_and_history(df).collect()}
    assert got == {1: ("c", 2), 2: ("a", 0)}
    q = spark.createDataFrame([("u", {"t": ["x", "y"]})], "user_id string, questions map<string, array<string>>")
    assert sorted(r.id for r in prep.flat_questions(q).collect()) == ["u#t_0", "u#t_1"]
    z = spark.createDataFrame([(1, ["a", "b"], ["x"])], "id int, s array<string>, d array<string>")
    assert [(r.n, r.s, r.d) for r in prep.zipped(z, "s", "d").collect()] == [(0, "a", "x")]
    assert one(spark, prep.literal_content(F.col("x")), "{'role': 'user', 'content': \"it's\"}") == "it's" and one(spark, prep.literal_content(F.col("x")), "plain") == "plain"
    assert one(spark, prep.kept_lines(F.col("x")), "- [A] b\nno\n [C] d -") == ["[A] b", "[C] d"]


def test_models_fail_softly(spark):
    units = spark.createDataFrame([(1, "ab"), (2, " "), (3, "abc")], "id int, content string")
    got = {r.id: r.embedding for r in models.encoded(units, lambda: lambda texts: np.array([[len(t), 0.0] for t in texts])).collect()}
    assert got[1] == [1.0, 0.0] and got[2] is None

    def broken():
        raise OSError("no model")

    assert all(r.embedding is None for r in models.encoded(units, broken).collect())
    prompts = units.select("id", F.col("content").alias("prompt"))
    ask = lambda: lambda p: p.upper() if p.strip() else 1 / 0
    out = {r.id: (r.answer, r.error is None) for r in models.answered(prompts, ask, tries=2, wait=0).collect()}
    assert out == {1: ("AB", True), 2: (None, False), 3: ("ABC", True)}
    rows = spark.createDataFrame([(["a", "b"], ["B!", "c", "B"])], "reference array<string>, system array<string>")
    assert models.aligned(rows, lambda: lambda r, s: s.lower().startswith(r)).first().system_aligned == ["b", "c", "B"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(('{"id": "1", "t": "x y"}\n{"id": "2", "t": "z"}\n').encode())
    df = files.keyed_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, t string")
    assert sorted(r.t for r in df.collect()) == ["x y", "z"]
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(ValueError, match="repeated"):
        files.keyed_json_lines(spark, str(tmp_path / "b.jsonl"), "id string")
    (tmp_path / "p_persona7.json").write_text(json.dumps([{"role": "user"}]))
    doc = files.json_document(spark, str(tmp_path / "p_persona7.json"), "role string")
    assert files.with_file_key(doc, "_persona([0-9]+)").first().key == "7"
    (tmp_path / "c.csv").write_text('a,b\n"x ""q""\ny",2\n')
    assert files.csv_table(spark, str(tmp_path / "c.csv")).first().a == 'x "q"\ny'
    assert files.load_source(spark, 50).select("request_id").distinct().count() == 50


def test_judgements(spark):
    x = F.col("x")
    assert one(spark, evaluation.judge_label(x), 'so {"label": "wrong"} {"label": "correct"}') == "WRONG"
    assert one(spark, evaluation.rubric_scores(x, F.lit(1)), '{"scores": [{"index": 0, "score": 0.5}]}') == [0.5]
    assert one(spark, evaluation.rubric_scores(x, F.lit(2)), '{"scores": [{"index": 0, "score": 0.5}]}') is None


def test_a_search_makes_its_messages_once(spark):
    from anamnesis.plans.search import Options, search

    told = spark.createDataFrame([("u0", "s", i, "user", 1683504000000 + i, f"Actually the walnut table changed to {i}.") for i in range(6)], "user_id string, session_id string, seq bigint, role string, ts bigint, content string")
    told = told.where(F.col("content") != "left out by its text")
    out = search(spark.createDataFrame([(1, "u0", "What is the current walnut table?")], "query_id int, user_id string, query string"), told, Options(top_k=3, timeline=True))
    assert out.count() == 3
    assert "left out by its text" not in out._jdf.queryExecution().optimizedPlan().toString()
