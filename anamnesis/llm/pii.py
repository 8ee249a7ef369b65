"""Personal data: fixed patterns, and a bootstrapped search for what stands in the same contexts.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks.  They
seed the search: the words around every identifier-like string are its lexical patterns, and Spark
scores the graph of patterns and instances in rounds.  A pattern is trusted for a kind by the share
of its distinct instances believed to be of that kind, an instance by its patterns.  Trusted
patterns with enough distinct instances then mark strings of a fitting shape that the fixed
patterns don't match.  Found spans never replace base spans, nor overlap them.

All of it is DataFrame and SQL functions.  Offsets count code points, ends exclusive.

Nulls: a null text is empty and has no spans; a null doc_id is returned as it is.  Repeated rows
are returned as often as they come.  Ties between kinds for one string go to the kind listed first.
Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole

KINDS = ("email", "ip", "card", "phone")
#: The patterns as the contract has them, with possessive repeats and run starts where these can't
#: change a match, so that no text takes more than linear time or deep recursion.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that could be an identifier: with an at sign, or of six digits at least. Possessive, as above.
CANDIDATE = r"(?<![^\s])[^\s@]++@[^\s@]++(?![^\s])|(?<![0-9(+])[+(]?[0-9](?:[\x20().:/-]{0,2}+[0-9]){5,}+"
#: Shape that a found string must have to be of a kind.
SHAPE = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,3}(?:[\x20.:/-][0-9]{1,3}){3}$",
    "card": r"^(?:[^0-9]*[0-9]){13,19}[^0-9]*$",
    "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$",
}
#: Characters of a text beside a string that are looked at for its context. A word that this cuts is left out,
#: so that a pattern has whole words only, and of longer words none.
BESIDE = 256
#: Rounds; trust and distinct instances that a pattern needs.
ROUNDS, TRUST, SUPPORT = 3, 0.9, 8
#: Matches whose offsets are summed at a time.
RUN = 512
SPAN = "struct<s:int,e:int,t:string>"


def luhn(text: Column) -> Column:
    """Whether the digits of text sum to a multiple of ten, every second from the right doubled."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


VALID = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: F.forall(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")),
    "card": lambda t: digits(t).between(13, 19) & luhn(t),
    "phone": lambda t: digits(t).between(9, 15),
}
#: A cheap test that a text without a match fails.
HINT = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}


def located(text: Column, pattern: str) -> Column:
    """Array of (s, e, t) of a pattern's matches: what split leaves between them gives the offsets.

    Offsets are summed in runs, and runs then placed, so that a text with very many matches doesn't
    copy its array for each.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.transform(F.array(F.struct(between.alias("b"), found.alias("m"))), lambda x: _summed(x["b"], x["m"]))[0]


def _summed(between: Column, found: Column) -> Column:
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"))

    def run(n: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(
            F.slice(pairs, n * RUN + 1, F.lit(RUN)),
            zero,
            lambda a, x: F.struct(
                (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["b"])).alias("s"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("e"), x["m"].alias("t")))).alias("out"),
            ),
        )

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), run)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    moved = F.aggregate(
        runs,
        zero,
        lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(r["out"], lambda x: F.struct((x["s"] + a["at"]).alias("s"), (x["e"] + a["at"]).alias("e"), x["t"].alias("t"))))).alias("out")),
    )
    return F.flatten(moved["out"])


def passes(kind: str):
    return lambda x: VALID[kind](x["t"])


def of_kind(kind: Column):
    return lambda x: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"))


def with_number(n: int):
    return lambda x: F.struct(F.lit(n).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def base(documents: DataFrame) -> DataFrame:
    """doc_id and text with an array of (s, e, t) a kind."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.col("text")
    df = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return df.select("doc_id", "text", *(F.when(HINT[k](text), F.filter(located(text, PATTERN[k]), passes(k))).otherwise(none).alias(k) for k in KINDS))


def same_text() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64("text")


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: two words before it; one before and one after; two after."""
    word = F.lit(r"[^\s]+")
    before = F.regexp_extract_all(F.lower(left), word, 0)
    after = F.regexp_extract_all(F.lower(right), word, 0)
    b1, b2 = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    a1, a2 = F.try_element_at(after, F.lit(1)), F.try_element_at(after, F.lit(2))
    return F.filter(F.array(F.concat(b2, F.lit(" "), b1, F.lit(" _")), F.concat(b1, F.lit(" _ "), a1), F.concat(F.lit("_ "), a1, F.lit(" "), a2)), lambda p: p.isNotNull())


def occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, same, s, e, t, kind, pattern): base spans and identifier-like strings beside them, a row a pattern."""
    seeds = F.concat(*(F.transform(k, of_kind(F.lit(k))) for k in KINDS))
    df = found.where(F.col("text").rlike("[0-9@]")).withColumn("seeds", seeds)
    free = F.filter(located(F.col("text"), CANDIDATE), lambda x: ~F.exists("seeds", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    free = F.transform(free, of_kind(F.lit(None).cast("string")))
    df = df.withColumn("x", F.explode(F.concat("seeds", free)))
    left = F.substring("text", F.greatest(F.lit(1), F.col("x.s") + 1 - BESIDE), F.least(F.lit(BESIDE), F.col("x.s")))
    left = F.when(F.col("x.s") > BESIDE, F.regexp_replace(left, r"^\S++", "")).otherwise(left)
    right = F.substring("text", F.col("x.e") + 1, F.lit(BESIDE))
    right = F.when(F.length(right) == BESIDE, F.regexp_replace(right, r"(?<!\S)\S++$", "")).otherwise(right)
    return df.select("doc_id", same_text().alias("same"), "x.*", F.explode(patterns(left, right)).alias("pattern"))


def trusted(occ: DataFrame) -> DataFrame:
    """(pattern, kind, trust): the patterns that are sure enough of a kind, after some rounds of scoring."""
    edges = materialize(occ.groupBy("pattern", F.lower("t").alias("instance")).agg(F.min("kind").alias("seed")), "pii-edges")
    belief = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    instances = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    for n in range(ROUNDS):
        scored = edges.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"))
        trust = materialize(scored.join(instances, "pattern").select("pattern", "kind", "instances", (F.col("held") / F.col("instances")).alias("trust")).where(F.col("trust") >= 0.5), "pii-trust")
        if n + 1 < ROUNDS:
            # An instance is believed unless all its patterns err; patterns of few instances say little.
            err = F.log(F.lit(1.0) - F.least(F.lit(0.99), F.col("trust") * F.col("instances") / (F.col("instances") + SUPPORT)))
            new = edges.where("seed is null").join(trust, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(err))).alias("belief"))
            seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
            belief = materialize(seeds.unionByName(new), "pii-belief")
    return trust.where((F.col("trust") >= TRUST) & (F.col("instances") >= SUPPORT)).select("pattern", "kind", "trust")


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, same, more): the spans that trusted patterns add, an array of (k, s, e) a text."""
    occ = materialize(occurrences(found), "pii-occurrences")
    shape = F.lit(False)
    for k in KINDS:
        shape = shape | ((F.col("p.kind") == k) & F.col("o.t").rlike(SHAPE[k]))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("p.kind")).cast("int") - 1
    hits = occ.where("kind is null").alias("o").join(trusted(occ).alias("p"), (F.col("o.pattern") == F.col("p.pattern")) & shape)
    best = hits.groupBy("doc_id", "same", "s", "e").agg(F.max_by(number, F.struct("trust", -number)).alias("k"))
    return materialize(best.groupBy("doc_id", "same").agg(F.collect_set(F.struct("k", "s", "e")).alias("more")), "pii-more")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (k, s, e) in that order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def numbered() -> Column:
    """The base spans of all kinds, an array of (k, s, e)."""
    return F.concat(*(F.transform(k, with_number(n)) for n, k in enumerate(KINDS)))


def with_found(df: DataFrame, more: DataFrame) -> DataFrame:
    """df with the column more, null where nothing was found; df has doc_id and same."""
    m = more.withColumnsRenamed({"doc_id": "_doc", "same": "_same"})
    return df.join(m, df.doc_id.eqNullSafe(m._doc) & (df.same == m._same), "left").drop("_doc", "_same")


def find(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, base spans of each kind counted, the digest of the base spans, and all spans."""
    found = base(documents)
    more = discovered(found)
    mine = found.select("doc_id", same_text().alias("same"), *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), numbered().alias("base"))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return with_found(mine, more).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    A text without spans is left as it is, null too; all other columns stay, whatever their names.
    """
    found = base(documents)
    more = discovered(found)
    spans = found.select("doc_id", same_text().alias("same"), numbered().alias("base")).where(F.size("base") > 0)
    spans = spans.unionByName(more.select("doc_id", "same", F.col("more").alias("base")))
    spans = materialize(spans.select("doc_id", "same", F.explode("base").alias("x")).groupBy("doc_id", "same").agg(F.sort_array(F.collect_set(F.struct("x.s", "x.e", "x.k"))).alias("more")), "pii-spans")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("d.text")
    cut = F.aggregate(
        "more",
        zero,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.concat(a["out"], F.when(x["s"] >= a["at"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), names[x["k"]])).otherwise(F.array().cast("array<string>"))).alias("out"),
        ),
    )
    masked = F.transform(F.array(cut), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text))))[0]
    # The document is one column, so that no name of its own can clash.
    plain = documents.select(whole(documents).alias("d"))
    marked = with_found(plain.select("d", F.col("d.doc_id").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same")), spans.hint("merge"))
    return marked.select(F.col("d").withField("text", F.when(F.col("more").isNull(), text).otherwise(masked)).alias("d")).select("d.*")
