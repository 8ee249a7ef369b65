"""Text operators against hand-made rows and against Python's own regular expressions."""

import re

from pyspark.sql import functions as F

from anamnesis.functions import fixed
from anamnesis.functions import text as T

MAY = 1683504000000


def one(spark, column, text=None, ts=None):
    df = spark.createDataFrame([(text, ts)], "text string, ts bigint")
    return df.select(column.alias("x")).first().x


def test_tokens_and_stems(spark):
    assert one(spark, T.tokens(F.col("text")), "Éon's 3.5 KM") == ["on", "s", "3", "5", "km"]
    words = F.transform(F.split("text", " "), T.stem)
    assert one(spark, words, "ties weekly boxes meeting flask's") == ["tie", "week", "box", "meet", "flask'"]
    assert one(spark, T.blank_tokens(F.col("text")), " A b \n") == ["a", "b"]


def test_values_and_negations(spark):
    assert one(spark, T.values(F.col("text")), "5 km by March 27. at 3:30 PM") == ["5 k", "March 27", "3", "30"]
    for text, is_negation in (("This isn't ready.", False), ("I don't agree.", True), ("It never was.", True)):
        assert one(spark, T.has(F.col("text"), fixed.NEGATIONS), text) is is_negation


def test_dates(spark):
    for ts, said in ((0, "unknown date"), (None, "unknown date"), (MAY, "08 May 2023")):
        assert one(spark, T.date_text(F.col("ts")), "", ts) == said
    resolved = T.relative_dates(F.col("text"), F.col("ts"))
    assert one(spark, resolved, "Yesterday and last week", MAY) == " [Resolved relative dates: Yesterday = 07 May 2023; last week = week of 01 May 2023]"
    assert one(spark, resolved, "yesterday, Yesterday", MAY) == " [Resolved relative dates: yesterday = 07 May 2023]"
    assert one(spark, resolved, "one month ago", 1680220800000) == " [Resolved relative dates: one month ago = 28 February 2023]"
    assert one(spark, resolved, "99999999999 days ago", MAY) == " [Resolved relative dates: ]" or one(spark, resolved, "99999999999 days ago", MAY) == ""
    assert one(spark, resolved, "yesterday", 0) == ""


def test_gaps(spark):
    df = spark.createDataFrame([(13,), (14,), (59,), (60,)], "d bigint").select(T.gap_text(F.col("d")).alias("x"))
    assert [r.x for r in df.collect()] == ["13d", "14d (~2w)", "59d (~8w)", "60d (~2mo)"]


def test_entities_as_python_finds_them(spark):
    assert one(spark, F.transform(T.entities(F.col("text")), F.lower), "The Met and I visited New York with Bob") == ["the met", "new york", "bob"]
    for text in ("éAbc Déf Ghi-Jk", "Ab Cd ef", "", "I The Ok"):
        expected = [e for e in re.findall(fixed.ENTITY, text) if e not in fixed.NO_ENTITY and len(e) >= 3]
        assert one(spark, T.entities(F.col("text")), text) == expected


def test_sentences_and_cleaning(spark):
    assert one(spark, T.sentences(F.col("text")), " One. Two!\nThree? \n\n four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.sanitized(F.col("text")), "a b\u0085c\u000bd") == "a b c d"
    assert one(spark, T.without_index_mark(F.col("text")), "x ->-> 1,2 ") == "x"


def test_a_text_is_searched_for_relative_dates_once(spark):
    df = spark.createDataFrame([("Yesterday, TODAY and last night; yesterday, today, two days ago, Last Year", MAY)], "text string, ts bigint")
    shown = df.select(T.relative_dates(F.col("text"), F.col("ts")).alias("x"))
    assert shown.head()[0] == " [Resolved relative dates: last night = 07 May 2023; Yesterday = 07 May 2023; TODAY = 08 May 2023; Last Year = 2022; two days ago = 06 May 2023]"
    assert shown._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2
