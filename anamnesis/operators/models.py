"""Calls of models that the caller supplies: encoders, answerers, judges. Nothing here reaches a network by itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import memo

#: Put before a query, not before documents, by encoders that were trained so.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def encoded(units: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "content", prefix: str = "", batch: int = 64) -> DataFrame:
    """units with embedding: unit vectors of their texts; null for blank texts, and for all if the model can't be made.

    make runs once in each worker. A failing batch leaves its rows null, and search then ranks by words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            encode = make()
        except Exception:
            encode = None
        for pdf in frames:
            out: list = [None] * len(pdf)
            filled = [i for i, t in enumerate(pdf[text]) if t and t.strip()]
            for at in range(0, len(filled) if encode else 0, batch):
                part = filled[at : at + batch]
                try:
                    vectors = np.asarray(encode([prefix + pdf[text].iloc[i] for i in part]), np.float32)
                    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                except Exception:
                    continue
                for i, v in zip(part, vectors):
                    out[i] = v
            yield pdf.assign(embedding=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in units.dtypes) + ", embedding array<float>"
    return units.mapInPandas(run, schema)


def answered(prompts: DataFrame, make: Callable[[], Callable[[str], str]], tries: int = 8, wait: float = 2.0) -> DataFrame:
    """(id, answer, error) of (id, prompt): a failing call is tried again after a growing wait, and then is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in frames:
            out = []
            for i, prompt in zip(pdf["id"], pdf["prompt"]):
                said, error = None, None
                for n in range(tries):
                    try:
                        said, error = ask(prompt), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < tries:
                            time.sleep(wait * (n + 1))
                out.append((i, said, error))
            yield pd.DataFrame(out, columns=["id", "answer", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, f"id {dict(prompts.dtypes)['id']}, answer string, error string")


def remembered(prompts: DataFrame, log: str, make: Callable[[], Callable[[str], str]], **how) -> DataFrame:
    """(id, answer) of prompts (id, prompt): one call for each prompt that a memo log doesn't know by its md5.

    New answers are written to the log (k, answer) first, and all are read from it, so that a call is made
    once, whatever reads the result; a second run makes none. A failing call leaves no row, and a null answer.
    """
    keyed = prompts.select("id", "prompt", F.md5(F.coalesce("prompt", F.lit("")).cast("binary")).alias("k"))

    def ask(keys: DataFrame) -> DataFrame:
        said = answered(keys.select(F.col("k").alias("id"), "prompt"), make, **how)
        return said.where("error is null").select(F.col("id").alias("k"), "answer")

    return memo(keyed, log, "k string, answer string", ask).select("id", "answer")


def aligned(rows: DataFrame, make: Callable[[], Callable[[str, str], bool]]) -> DataFrame:
    """rows with system_aligned: each event of system as the first unused event of reference that a model holds equal, or as it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same = make()
        for pdf in frames:
            out = []
            for reference, system in zip(pdf["reference"], pdf["system"]):
                free, names = list(dict.fromkeys(reference)), []
                for event in system:
                    match = next((r for r in free if r == event or same(r, event)), None)
                    names.append(event if match is None else match)
                    if match is not None:
                        free.remove(match)
                out.append(names)
            yield pdf.assign(system_aligned=out)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", system_aligned array<string>")
