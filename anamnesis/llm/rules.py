"""Quality rules: counts of each text, and a decision list learned from labelled documents.

Sequential covering: a rule is a conjunction of thresholds that picks out bad documents. It grows,
condition by condition, on statistics of two thirds of a bounded sample of labelled rows that no
earlier rule covers; it is pruned to the prefix that does best on the rest, and joins the list if it
is precise there. The list becomes one ordered conditional expression. All counts are DataFrame
aggregates; the driver sees a row a feature and bin.

Nulls: a null text has no words, which fails the base rule; a null doc_id is returned as it is, and
teaches nothing. Without labelled rows of both kinds there are no learned rules. Repeated rows are
returned as often as they come, and teach once. Empty input gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
#: Labelled rows that may be learned from, thresholds a feature, rules, conditions of a rule.
SAMPLE, BINS, RULES, CONDITIONS = 20_000, 32, 8, 3
#: What a rule must reach on the rows it wasn't grown on: bad rows covered, and their share.
COVER, PRECISION = 5, 0.97

#: What is counted of a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_bars", "n_digits", "n_stops", "n_distinct")
#: Shares that rules test.
FEATURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def number(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def repeats(words: Column) -> Column:
    """Words in windows of three that come twice or more; windows are told apart by a 64-bit hash, text by text."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = once(order, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    found = once(once(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < 4, 0).otherwise(found).cast("bigint")


def once(value: Column, use) -> Column:
    """use(value), with value computed once: a plain reference in a lambda could be computed for every element."""
    return F.transform(F.array(value), use)[0]


def counts(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each text that rules and features use."""
    text = F.col("text")
    df = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    many = lambda c: F.size(c).cast("bigint")
    return df.select(
        "doc_id",
        many("words").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        number(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeats(F.col("words")).alias("n_repeat_words"),
        many("lines").alias("n_lines"),
        number(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        number(text, "!?").alias("n_marks"),
        number(text, "|").alias("n_bars"),
        number(text, "0123456789").alias("n_digits"),
        number(text, ".").alias("n_stops"),
        many(F.array_distinct("words")).alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sample(documents: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> DataFrame:
    """The features of at most size labelled documents, the first by a hash of their id; bad is 1 or 0, part 0 to 2."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(size).withColumnRenamed("doc_id", "_id")
    # At most size ids of 12 bytes.
    known = documents.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    texts = known.select(F.struct("doc_id", "_label").alias("doc_id"), "text")
    # Of rows that repeat an id one teaches, so that there are at most size rows.
    found = counts(texts).select("doc_id", F.struct(*COUNTS).alias("c")).groupBy("doc_id").agg(F.min("c").alias("c")).select("doc_id", "c.*")
    found = materialize(found, "rules-counts").where(~base_failed())
    return found.select(*(F.expr(x).cast("double").alias(f) for f, x in FEATURES.items()), (1 - F.col("doc_id._label")).cast("int").alias("bad"), F.pmod(F.xxhash64(F.lit(6), "doc_id.doc_id"), F.lit(3)).alias("part"))


def learn(known: DataFrame) -> list[tuple[Condition, ...]]:
    """The rules, in order, from features, bad and part."""
    edges = known.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    # Each feature as the number of thresholds below it.
    below = {f: sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)) for f in FEATURES}
    binned = materialize(known.select("bad", "part", *(n.alias(f) for f, n in below.items())), "rules-sample")
    at = {f: {e: i for i, e in enumerate(edges[f])} for f in FEATURES}

    def holds(c: Condition) -> Column:
        i = at[c.feature][c.threshold]
        return F.col(c.feature) > i if c.above else F.col(c.feature) <= i

    def all_of(rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & holds(c)
        return out

    def best(rows: DataFrame) -> tuple[Condition, float, float] | None:
        """The condition with most gain on rows, and the bad and good rows that it leaves."""
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES))).alias("x")
        table = rows.select("bad", each).groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
        bad, good = (sum(r[k] for r in table if r.f == "words") for k in ("bad", "good"))
        if not bad or not good:
            return None
        found, before = None, math.log2(bad / (bad + good))
        for f in FEATURES:
            mine = [(r.b, r.bad, r.good) for r in table if r.f == f]
            for i, e in enumerate(edges[f]):
                for above in (True, False):
                    p = sum(x[1] for x in mine if (x[0] > i) == above)
                    n = sum(x[2] for x in mine if (x[0] > i) == above)
                    gain = p * (math.log2((p + 0.01) / (p + n + 0.01)) - before) if p else 0.0
                    if found is None or gain > found[0]:
                        found = gain, Condition(f, above, e), p, n
        return found[1:] if found and found[0] > 0 else None

    rules: list[tuple[Condition, ...]] = []
    left = binned
    for _ in range(RULES):
        rule: list[Condition] = []
        while len(rule) < CONDITIONS and (found := best(left.where((F.col("part") > 0) & all_of(rule)))):
            rule.append(found[0])
            if not found[2]:
                break
        if not rule:
            break
        sums = [x for k in range(1, len(rule) + 1) for x in (F.sum(F.when(all_of(rule[:k]), F.col("bad"))), F.sum(F.when(all_of(rule[:k]), 1 - F.col("bad"))))]
        seen = [x or 0 for x in left.where("part = 0").agg(*sums).first()]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(seen[::2], seen[1::2])]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = seen[2 * k : 2 * k + 2]
        if p < COVER or p / (p + n) < PRECISION:
            break
        rules.append(tuple(rule[: k + 1]))
        left = left.where(~all_of(rules[-1]))
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """True where no rule rejects: one conditional expression, the rules in order."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per document: doc_id, the counts, base_failed, and kept, the verdict of base rule and learned list."""
    rules = learn(sample(documents, labels, label))
    df = counts(documents).withColumn("base_failed", base_failed())
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict(rules)).alias("kept"))
