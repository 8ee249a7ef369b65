"""The pipeline's stages, each against plain Python on the rows that it got."""

import hashlib
import random
from collections import Counter

import pytest

from . import brute
from .test_operators import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    random.seed(6)
    at = tmp_path_factory.mktemp("sf")
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(random.choices(words, k=60))
        if i % 4 == 3:
            text = " ".join(w + "###" for w in text.split())
        elif i % 4 == 2:
            text += f" write to me{i}@example.com or 10.0.0.{i}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200 + i, rows[i][1], "en", "s0", rows[i][4]) for i in (0, 1, 2)] + [(300, None, None, None, None), (None, "no id " * 20, "en", "s1", 120)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, sf_dir):
    from anamnesis.llm.common import materialize
    from anamnesis.session import table

    docs, seen = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "test")
        seen[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = seen["quality"]
    assert {r.doc_id for r in after} >= {i for i in range(120) if i % 4 != 3} and not {i for i in range(120) if i % 4 == 3} & {r.doc_id for r in after}
    before, after = seen["near_dedup"]
    seen_texts, want = set(), []
    for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if not any(r.text == t or jaccard(r.text, t) >= 0.8 for t in seen_texts):
            seen_texts.add(r.text)
            want.append(r.doc_id)
    assert Counter(r.doc_id for r in after) == Counter(want)
    before, after = seen["pii"]
    assert not any(brute.base_spans(r.text) for r in after) and len(before) == len(after)
    clean = {r.doc_id: r.text for r in before if not brute.base_spans(r.text)}
    assert all(r.text == clean[r.doc_id] for r in after if r.doc_id in clean) and all(r.n_chars == len(r.text) for r in after if r.text)
    before, after = seen["mix"]
    assert max(Counter(r.doc_id for r in after if r.doc_id is not None).values()) <= 2 and {r.text for r in after} <= {r.text for r in before}
    before, after = seen["encode"]
    assert len(before) == len(after)
    assert Counter(r.decoded_sha256 for r in after) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50 and len(corpus_pipeline.STAGES) == 5


ODD = ["_quality", "a.b", "q`t", "_key", "_digest", "d", "_copies", "more", "same", "Score"]


def test_columns_of_any_name(spark, sf_dir, tmp_path):
    """Each stage keeps columns whose names need quotes or are its own, with their values."""
    from pyspark.sql import functions as F

    from anamnesis.llm.common import materialize, quoted
    from anamnesis.session import table

    docs = table(spark, sf_dir, "documents")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in ODD))
    docs = materialize(docs, "test-odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), "test-odd")
        assert out.columns == docs.columns, name
        found = out.select("doc_id", *(F.col(quoted(c)) for c in ODD)).collect()
        assert found, name
        for r in found:
            assert list(r)[1:] == [f"{c}={'?' if r.doc_id is None else r.doc_id}" for c in ODD], name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
