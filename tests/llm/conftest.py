import pytest

#: Columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, key bigint, score double, same string, row int, words int, spans string"
PROSE = "The quick brown fox jumps over the lazy dog near the river bank today and rests. "


def row(doc, text, source="a"):
    return (doc, text, "en", source, len(text or ""), 1, 2, 0.5, "x", 3, 4, "y")


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, and exact and near copies."""
    out = [row(1, None), row(2, ""), row(3, " \n\t "), row(None, "no id at all"), row(None, None, None), row(4, "x" * 200_000), row(5, "a b " * 40_000, None)]
    out += [row(6, PROSE * 6), row(6, PROSE * 6), row(7, PROSE * 6), row(8, PROSE * 6 + "Indeed.", "b"), row(9, "mail me@example.com or +1 (555) 123-4567, 10.0.0.1", "b")]
    out += [row(10, "!!! ### " * 60, "ünï"), row(11, "é😀 ﬁ ▁▁ \u0000 ﻿", "ünï"), row(12, "İstanbul ÀÉ ß x\u0085y", "b")]
    return out


@pytest.fixture(scope="session")
def documents(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('none')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (10, 0, 0), (None, 1, 0), (5, None, 0), (6, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
