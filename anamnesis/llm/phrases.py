"""Phrase collocations by level-wise (Apriori) counting.

Texts are lower-cased (A to Z), split at stops and line ends into pieces, and pieces at blanks and tabs
into words.  Words are counted first.  A phrase of k words is then counted only where both phrases of
k - 1 words in it are frequent, and every frequent phrase is cut in two in each way; the levels' tables
hold the counts of both parts, as no part is rarer than its whole.

The frequent phrases of a level go to all tasks while they are small (BROADCAST bytes); more of them
meet phrases that were counted first, by a join whose hot keys can be split.  Both ways give the same
rows.

A null text has no words, a null lang is `und`. Repeated rows count as often as they come. Pieces
never join words across a stop, and very long texts are read as pieces. No rows give no rows, nor does
a language without candidates. Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CUT, BLANK = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Words of a phrase, least count, per cent of a phrase's count that lets a longer one stand for it, rows of a language.
LONGEST, LEAST, COVER, MOST = 3, 10, 50, 2000
#: Bytes of a level's table that are sent to all tasks; what a row takes besides its words, and as a hash.
BROADCAST, ROW, HASHED = 64 << 20, 64, 32
#: Parts that a language's candidates are ranked in before their best are ranked together.
PARTS = 16


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, w): the words of each piece that has one."""
    text = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    cut = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, CUT, -1)).alias("piece"))
    cut = cut.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    return cut.select("lang", F.split("piece", BLANK, -1).alias("w"))


def names(k: int, first: int = 0) -> list[str]:
    return [f"w{i}" for i in range(first, first + k)]


def grams(cut: DataFrame, k: int) -> DataFrame:
    """(lang, w0, ...): each run of k words of a piece."""
    if k == 1:
        return cut.select("lang", F.explode("w").alias("w0"))
    each = cut.where(F.size("w") >= k).select("lang", "w", F.posexplode("w").alias("i", "w0")).where(F.col("i") <= F.size("w") - k)
    return each.select("lang", "w0", *(F.get("w", F.col("i") + at).alias(f"w{at}") for at in range(1, k)))


def sent(level: DataFrame) -> tuple[DataFrame, bool]:
    """A level's table for a join, and whether it is small enough to go to all tasks."""
    words = reduce(Column.__add__, (F.octet_length(c) for c in level.columns if c.startswith("w")))
    size = level.agg(F.coalesce(F.sum(words + ROW), F.lit(0))).head()[0]
    return (F.broadcast(level), True) if size <= BROADCAST else (level.hint("merge"), False)


def counted(level: DataFrame, first: int, name: str) -> DataFrame:
    """A level's table under the names that its words have in longer phrases, starting there."""
    k = sum(c.startswith("w") for c in level.columns)
    return level.select("lang", *(F.col(c).alias(f"w{first + i}") for i, c in enumerate(names(k))), F.col("f").alias(name))


def next_level(cut: DataFrame, k: int, below: DataFrame, least: int) -> DataFrame:
    """(lang, w0, ..., f): the phrases of k words that come at least so often; below has those of k - 1.

    Tasks that get the level below get a 64-bit hash for each of its phrases. What passes by chance is
    counted by its words like the rest, and isn't frequent, as no phrase is without frequent parts.
    """
    hashed = below.select(F.xxhash64("lang", *names(k - 1)).alias("_h"))
    small = below.count() * HASHED <= BROADCAST

    def both(df: DataFrame) -> DataFrame:
        for first in (0, 1):
            part = names(k - 1, first)
            if small:
                df = df.join(F.broadcast(hashed), F.xxhash64("lang", *part) == hashed["_h"], "left_semi")
            else:
                df = df.join(counted(below, first, "_f").drop("_f").hint("merge"), ["lang", *part], "left_semi")
        return df

    found = packed_counts(both(grams(cut, k)), k, least) if small else both(packed_counts(grams(cut, k), k, least))
    return materialize(found, f"phrases-{k}")


def packed_counts(df: DataFrame, k: int, least: int) -> DataFrame:
    """(lang, w0, ..., f) of what comes at least so often; phrases are shuffled as one string, which takes half the bytes of several."""
    words = [x for c in names(k, 1)[: k - 1] for x in (F.lit(" "), F.col(c))]
    packed = df.select(F.concat("lang", F.lit("\t"), "w0", *words).alias("p")).groupBy("p").agg(F.count("*").alias("f"))
    # Words have neither blanks nor tabs, a language may.
    phrase = F.substring_index("p", "\t", -1)
    lang = F.substring("p", F.lit(1), F.length("p") - F.length(phrase) - 1)
    words = F.split(phrase, " ", -1)
    return packed.where(F.col("f") >= least).select(lang.alias("lang"), *(words[i].alias(f"w{i}") for i in range(k)), "f")


def levels(documents: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and a table (lang, w0, ..., f) of the frequent phrases of 1, 2, ... words."""
    cut = pieces(documents)
    words = materialize(packed_counts(grams(cut, 1), 1, 1), "phrases-words")
    tables = [materialize(words.where(F.col("f") >= least), "phrases-1")]
    for k in range(2, longest + 1):
        tables.append(next_level(cut, k, tables[-1], least))
    return words.groupBy("lang").agg(F.sum("f").alias("n")), tables


def scored(tables: list[DataFrame], k: int) -> DataFrame:
    """(lang, w0, ..., a, l, r, score) of the phrases of k words, by the lowest-scoring of their cuts, the first of equal ones."""
    found = tables[k - 1].withColumnRenamed("f", "a")
    cuts = []
    for at in range(1, k):
        for part, first, name in ((tables[at - 1], 0, f"_l{at}"), (tables[k - at - 1], at, f"_r{at}")):
            size = k - at if first else at
            met = counted(part, first, name)
            found = found.join(F.broadcast(met) if sent(part)[1] else met.hint("merge"), ["lang", *names(size, first)])
        score = F.expr(f"(cast(1000000 as decimal(38, 0)) * a * a) div (cast(_l{at} as decimal(38, 0)) * _r{at})")
        cuts.append(F.struct(score.alias("score"), F.lit(at).alias("at"), F.col(f"_l{at}").alias("l"), F.col(f"_r{at}").alias("r")))
    best = F.array_min(F.array(*cuts))
    return found.withColumn("_b", best).select("lang", *names(k), "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").alias("score"))


def uncovered(tables: list[DataFrame], k: int, found: DataFrame, cover: int) -> DataFrame:
    """The phrases of k words that stand in no longer frequent phrase with `cover` per cent of their count."""
    for longer in range(k + 1, len(tables) + 1):
        inside = None
        for first in range(longer - k + 1):
            part = tables[longer - 1].select("lang", *(F.col(f"w{first + i}").alias(f"w{i}") for i in range(k)), "f")
            inside = part if inside is None else inside.unionByName(part)
        most = inside.groupBy("lang", *names(k)).agg(F.max("f").alias("_f"))
        found = found.join(most, ["lang", *names(k)], "left").where((100 * F.coalesce("_f", F.lit(0)) < cover * F.col("a"))).drop("_f")
    return found


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of each language, see above."""
    totals, tables = levels(documents, longest, least)
    out = None
    for k in range(2, longest + 1):
        kept = uncovered(tables, k, scored(tables, k), cover)
        kept = kept.select("lang", F.concat_ws(" ", *names(k)).alias("phrase"), "a", "l", "r", "score")
        out = kept if out is None else out.unionByName(kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that no task ranks all of a language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for by in (["lang", "_part"], ["lang"]):
        out = out.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most)
    return out.join(F.broadcast(totals), "lang").select("lang", F.col("_rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
