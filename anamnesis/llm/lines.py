"""Substring dedup by hashing the lines of texts, and within lines the sentences.

Units are normalised (letters and digits in lower case, one space between words) and hashed; digests
are grouped over all documents, and the occurrence that is earliest by doc_id, then by place, stays.
Whole lines, from line feed to line feed, that equal an earlier whole line are removed whatever their
length. Within lines that differ, a run of neighbouring units that all occur earlier is removed if
it has at least LEAST words, so that short phrases that many texts share by chance aren't torn out.
Lines are compared with lines and units with units. Offsets are those of the original text, in code
points, ends exclusive.

Passages are copied into the middle of lines, which is why lines alone would not do.

Nulls: a null text stays null and has no units; a null doc_id ranks first. Of repeated rows one
keeps its units. Empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows

#: Words that a run within a line must have to be removed.
LEAST = 20
UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)")
WORD = re.compile(r"[^\W_]+")
#: lines: of each unit, the place of its line's digest among digests. Those of the lines come after those of the units.
PARTS = "row bigint, doc_id bigint, text string, digests array<bigint>, starts array<int>, ends array<int>, words array<int>, lines array<int>"


def digested(words: list[str], line: bool = False) -> int:
    from xxhash import xxh3_64_intdigest

    digest = xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace"), int(line))
    return digest - (digest >> 63 << 64)


def worded(text: str) -> Iterator[tuple[list[str], int, int]]:
    start = 0
    for m in UNIT.finditer(text):
        end = m.end()
        whole = end == len(text) or text[end - 1] == "\n" or text[end].isspace()
        if not whole or end == start:
            continue
        words = WORD.findall(text[start:end].lower())
        if words:
            yield words, start, end
        start = end


def units(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(digest, start, end, words) of each unit that has words: up to a line feed, or to a stop before white space."""
    for words, start, end in worded(text):
        yield digested(words), start, end, len(words)


def placed(text: str) -> tuple[list[int], ...]:
    """digests, starts, ends, words and lines of a text, as in PARTS."""
    found = list(worded(text))
    lines, of, at = [], [], 0
    for words, start, _ in found:
        # A unit has no line feed but at its end.
        if not lines or "\n" in text[at:start]:
            lines.append([])
        lines[-1] += words
        of.append(len(found) + len(lines) - 1)
        at = start
    digests = [digested(w) for w, _, _ in found] + [digested(w, line=True) for w in lines]
    return digests, [s for _, s, _ in found], [e for _, _, e in found], [len(w) for w, _, _ in found], of


def split(documents: DataFrame) -> DataFrame:
    """A row a document with its text and units; row tells rows apart once this is written."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 4
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc, text in rows(batch.slice(at, 512), "doc_id", "text"):
                    out.append((row, doc, text, *placed(text or "")))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in PARTS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, PARTS)


def later(parts: DataFrame) -> DataFrame:
    """(row, ats): the places of the digests that occur earlier."""
    each = parts.select("row", "doc_id", F.posexplode("digests").alias("at", "digest"))
    firsts = each.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first")).where("n > 1").select("digest", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))
    met = parts.select("row", F.posexplode("digests").alias("at", "digest")).join(materialize(firsts, "lines-firsts"), "digest")
    return met.where((F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at"))).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("ats"))


def dropped(words: list[int], lines: list[int], again: set[int], least: int) -> Iterator[tuple[int, int]]:
    """The first and the last of neighbouring units that go: those of repeated lines, and of repeated runs of at least so many words."""
    for repeated, run in groupby(range(len(words)), lambda i: i in again or lines[i] in again):
        if repeated:
            run = list(run)
            long = sum(words[i] for i in run) >= least
            for gone, part in groupby(run, lambda i: long or lines[i] in again):
                if gone:
                    part = list(part)
                    yield part[0], part[-1]


def removed(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, spans): what to remove of each text that loses something, an array of (start, end) in order."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            out = []
            for row, starts, ends, words, lines, ats in rows(batch, "row", "starts", "ends", "words", "lines", "ats"):
                spans = [{"start": starts[i], "end": ends[j]} for i, j in dropped(words, lines, set(ats), least)]
                if spans:
                    out.append((row, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "spans"])

    return parts.drop("digests", "text", "doc_id").join(later(parts), "row").mapInArrow(run, "row bigint, spans array<struct<start:int,end:int>>")


def dedup(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_removed, chars_removed, removed (array of (start, end)) and the text that stays.

    Rows are told apart by their number throughout, those alike in id and text too.
    """
    parts = materialize(split(documents), "lines-parts")
    gone = materialize(removed(parts, least), "lines-removed")
    none = F.array().cast("array<struct<start:int,end:int>>")
    met = parts.select("row", "doc_id", "text").join(gone, "row", "left")
    return finished(met.withColumn("spans", F.coalesce("spans", none)))


def finished(df: DataFrame) -> DataFrame:
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kept = F.aggregate(
        "spans",
        zero,
        lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("out")),
        lambda r: F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text))),
    )
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return df.select("doc_id", F.size("spans").cast("bigint").alias("n_removed"), lost.alias("chars_removed"), F.col("spans").alias("removed"), F.when(F.size("spans") == 0, text).otherwise(kept).alias("text"))
