"""Lexical and vector retrieval, rank fusion, and what follows a ranking: neighbours, filling, cut-off.

Queries are tables (query_id, user_id, query); a search is a join, and all queries run at once.
Ties in a score go to the smaller seq. Scores are compared at nine decimals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


@dataclass
class Index:
    """postings (user_id, seq, term, tf, dl), terms (user_id, term, df, idf) and corpus (user_id, n_docs, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build_index(units: DataFrame, tokenizer=T.tokens, epsilon: float = fixed.BM25_EPSILON) -> Index:
    """The BM25 statistics of each user's units. A negative idf becomes epsilon times the mean of all, taken before."""
    return index_of(postings_of(units, tokenizer), units_sized(units, tokenizer).select("user_id", "dl"), epsilon)


def units_sized(units: DataFrame, tokenizer=T.tokens) -> DataFrame:
    return units.select("user_id", "seq", tokenizer(F.col("index_text")).alias("t")).withColumn("dl", F.size("t"))


def postings_of(units: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """(user_id, seq, term, tf, dl). Units are dealt out as texts, and the words of each are counted in its row: nothing is held but that row."""
    found = units_sized(units.select("user_id", "seq", "index_text").repartition("user_id", "seq"), tokenizer).select("user_id", "seq", "dl", F.explode(T.counted(F.col("t"))).alias("x"))
    return found.select("user_id", "seq", "dl", "x.term", "x.tf")


def index_of(postings: DataFrame, sizes: DataFrame, epsilon: float = fixed.BM25_EPSILON) -> Index:
    """The statistics of postings, and of sizes: (user_id, dl) of every unit, those without terms included."""
    corpus = sizes.groupBy("user_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("user_id", "term").agg(F.count("*").alias("df")).join(corpus, "user_id")
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("user_id").agg(F.avg("raw").alias("mean"))
    terms = raw.join(mean, "user_id").select("user_id", "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, terms, corpus)


def bm25(queries: DataFrame, index: Index, tokenizer=T.tokens, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(query_id, user_id, seq, score) of the units that share a term with the query; a repeated term counts again."""
    terms = queries.select("query_id", "user_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "user_id", "term").agg(F.count("*").alias("times"))
    weighed = terms.join(index.terms, ["user_id", "term"]).join(index.corpus, "user_id")
    met = weighed.join(index.postings, ["user_id", "term"])
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return met.groupBy("query_id", "user_id", "seq").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def ranked(scored: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn(name, F.row_number().over(by))


def best_first(column: str = "score") -> list[Column]:
    return [F.round(column, 9).desc(), F.col("seq").asc()]


def bm25_top(queries: DataFrame, index: Index, k: int, **how) -> DataFrame:
    return ranked(bm25(queries, index, **how).where("score > 0"), *best_first()).where(F.col("rank") <= k)


def bm25_all(queries: DataFrame, index: Index, units: DataFrame, **how) -> DataFrame:
    """Every unit of the query's user, ranked; those without a shared term score zero."""
    every = queries.select("query_id", "user_id").join(units.select("user_id", "session_id", "seq"), "user_id")
    scored = every.join(bm25(queries, index, **how), ["query_id", "user_id", "seq"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(scored, *best_first())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, user_id, session_id, seq, sim, dense_rank): each unit of the user by its product with the query's vector."""
    met = queries.select("query_id", "user_id", "vector").join(units, "user_id")
    return ranked(met.select("query_id", "user_id", "session_id", "seq", dot(F.col("vector"), F.col("embedding")).alias("sim")), *best_first("sim"), name="dense_rank")


def fused(queries: DataFrame, units: DataFrame, index: Index, k: int = fixed.RRF_K) -> DataFrame:
    """Weighted reciprocal ranks of the vector ranking and, where BM25 is positive, the lexical one."""
    lexical = ranked(bm25(queries, index).where("score > 0"), *best_first(), name="lex_rank").select("query_id", "seq", "lex_rank")
    both = dense(queries, units).join(lexical, ["query_id", "seq"], "left")
    score = F.lit(fixed.DENSE_WEIGHT) / (k + F.col("dense_rank")) + F.coalesce(F.lit(fixed.LEXICAL_WEIGHT) / (k + F.col("lex_rank")), F.lit(0.0))
    return ranked(both.withColumn("score", score), F.round("score", 9).desc(), F.round("sim", 9).desc(), F.col("seq").asc())


def expand(ranking: DataFrame, units: DataFrame, seeds: int = 20, span: int = 1, stop_at: int | None = None) -> DataFrame:
    """(query_id, user_id, seq, score, pick): seeds in order of rank, each followed by its neighbours in the session.

    Neighbours score zero, and a unit counts where it is picked first. With stop_at, seeds after that
    many picks are not taken. A range join would do; offsets make it an equality join.
    """
    offsets = [0] + [x for d in range(1, span + 1) for x in (-d, d)]
    slot = F.posexplode(F.array(*map(F.lit, offsets))).alias("slot", "off")
    seed = ranking.where(F.col("rank") <= seeds).select("query_id", "user_id", "session_id", F.col("seq").alias("seed"), "score", "rank", slot)
    at = seed.withColumn("seq", F.col("seed") + F.col("off"))
    met = at.join(units.select("user_id", "seq", F.col("session_id").alias("_session")), ["user_id", "seq"]).where((F.col("off") == 0) | (F.col("_session") == F.col("session_id")))
    met = met.withColumn("score", F.when(F.col("off") == 0, F.col("score")).otherwise(0.0)).withColumn("pick", F.col("rank") * len(offsets) + F.col("slot"))
    first = met.groupBy("query_id", "user_id", "seq").agg(F.min_by(F.struct("score", "pick", "rank"), "pick").alias("x")).select("query_id", "user_id", "seq", "x.*")
    if stop_at is None:
        return first.drop("rank")
    each = first.groupBy("query_id", "rank").count()
    before = F.sum("count").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    open_ = each.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < stop_at).select("query_id", "rank")
    return first.join(open_, ["query_id", "rank"], "left_semi").drop("rank")


def spare(seeds: int, span: int) -> int:
    """More than the picks that seeds and their neighbours can be."""
    return (seeds + 2) * (2 * span + 1)


def fill(picks: DataFrame, ranking: DataFrame, top_k: int, seeds: int = 20, span: int = 1) -> DataFrame:
    """The picks, then the rest of the ranking with its scores, up to top_k; pos counts from 1."""
    last = spare(seeds, span)
    rest = ranking.where(F.col("rank") <= top_k + last).select("query_id", "user_id", "seq", "score", (F.col("rank") + last).alias("pick"))
    first = picks.unionByName(rest).groupBy("query_id", "user_id", "seq").agg(F.min_by(F.struct("score", "pick"), "pick").alias("x")).select("query_id", "user_id", "seq", "x.*")
    return ranked(first, F.col("pick"), name="pos").where(F.col("pos") <= top_k).drop("pick")


def abstain(picked: DataFrame, floor: float = 0.004, least: int = 10) -> DataFrame:
    """Of results with more than `least` rows, those that score at least floor."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    kept = picked.withColumn("_n", n).where((F.col("_n") <= least) | (F.col("score") >= floor)).drop("_n")
    return ranked(kept.drop("pos"), F.col("_pos"), name="pos").drop("_pos") if "_pos" in kept.columns else kept


def entity_postings(units: DataFrame) -> DataFrame:
    """(user_id, entity, seq): capitalised phrases in lower case, once a unit."""
    return units.select("user_id", "seq", F.explode(F.transform(T.entities(F.col("content")), F.lower)).alias("entity")).distinct()


def entity_expansion(queries: DataFrame, postings: DataFrame, least: int = 2, each: int = 8) -> DataFrame:
    """(query_id, user_id, entity, seq): for each entity of the query that is frequent enough, its earliest units."""
    asked = queries.select("query_id", "user_id", F.explode(F.array_distinct(F.transform(T.entities(F.col("query")), F.lower))).alias("entity"))
    frequent = postings.groupBy("user_id", "entity").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    met = asked.join(frequent, ["user_id", "entity"]).join(postings, ["user_id", "entity"])
    n = F.row_number().over(Window.partitionBy("query_id", "entity").orderBy("seq"))
    return met.withColumn("n", n).where(F.col("n") <= each).select("query_id", "user_id", "entity", "seq")


def rendered(picked: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, pos, id, content, score, ts): results as they are shown, with their relative dates resolved."""
    met = picked.join(units.select("user_id", "seq", "role", "ts", "content"), ["user_id", "seq"])
    shown = F.concat(F.lit("[mem-"), F.col("seq").cast("string"), F.lit(" | "), "role", F.lit(" | "), T.date_text(F.col("ts")), F.lit("] "), "content", T.relative_dates(F.col("content"), F.col("ts")))
    return met.select("query_id", "pos", F.concat(F.lit("mem-"), F.col("seq").cast("string")).alias("id"), shown.alias("content"), F.round("score", 6).alias("score"), "ts")
