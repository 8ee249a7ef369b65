"""Text and date operators as Column -> Column functions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, in any case, with Unicode classes."""
    return text.rlike(f"(?iU){pattern}")


def tokens(text: Column) -> Column:
    return find_all(F.lower(text), fixed.TOKEN)


def blank_tokens(text: Column) -> Column:
    """Words between white space, in lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def known(ts: Column) -> Column:
    """Zero is as unknown as null."""
    return ts.isNotNull() & (ts != 0)


def date_text(ts: Column, form: str = "dd MMMM yyyy", none: str = "unknown date") -> Column:
    return F.when(known(ts), F.date_format(F.timestamp_millis(ts), form)).otherwise(none)


def gap_text(days: Column) -> Column:
    d = days.cast("string")
    return (
        F.when(days >= 60, F.concat(d, F.lit("d (~"), F.floor(days / 30).cast("string"), F.lit("mo)")))
        .when(days >= 14, F.concat(d, F.lit("d (~"), F.floor(days / 7).cast("string"), F.lit("w)")))
        .otherwise(F.concat(d, F.lit("d")))
    )


def index_text(role: Column, ts: Column, content: Column) -> Column:
    return F.concat(F.lit("Speaker: "), role, F.lit("\nEvent date: "), date_text(ts), F.lit("\n"), content)


def with_options(query: Column, options: Column) -> Column:
    listed = F.concat(query, F.lit("\nOptions:\n"), F.array_join(options, "\n"))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, listed).otherwise(query)


def stem(word: Column) -> Column:
    out = None
    for suffix, end in fixed.SUFFIXES:
        test = word.endswith(suffix) & (F.length(word) >= len(suffix) + 3)
        new = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(end))
        out = F.when(test, new) if out is None else out.when(test, new)
    return out.otherwise(word)


def topic_words(text: Column) -> Column:
    words = F.filter(F.transform(find_all(text, fixed.TOPIC_WORD), F.lower), lambda w: ~w.isin(fixed.TOPIC_STOP))
    return F.array_distinct(F.transform(words, stem))


def content_words(text: Column) -> Column:
    stop = F.array(*map(F.lit, fixed.CONTENT_STOP))
    words = F.filter(find_all(text, fixed.CONTENT_WORD), lambda w: F.length(w) > 3)
    return F.filter(F.transform(words, F.lower), lambda w: ~F.array_contains(stop, w))


def values(text: Column) -> Column:
    return F.transform(find_all(text, f"(?U){fixed.VALUE}"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))


def sentences(text: Column) -> Column:
    """The stripped lines of a text, each cut after its stops."""
    # A stop's white space becomes a line's end first: split by a pattern would compile it for each row.
    lines = F.split(F.regexp_replace(text, r"(?U)(?<=[.!?])\s+", "\n"), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def entities(text: Column) -> Column:
    """Capitalised phrases, as written; a lone function word or one of under three characters is none."""
    none = F.array(*map(F.lit, fixed.NO_ENTITY))
    return F.filter(find_all(text, f"(?U){fixed.ENTITY}"), lambda e: ~F.array_contains(none, e) & (F.length(e) >= 3))


def sanitized(text: Column) -> Column:
    return F.translate(text, fixed.LINE_BREAKERS, " " * len(fixed.LINE_BREAKERS))


def without_index_mark(text: Column) -> Column:
    return F.regexp_replace(sanitized(text), r"(?U)\s*->->\s*[\d,]+\s*$", "")


def captioned(text: Column, caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(text, F.lit(" [image: "), caption, F.lit("]"))).otherwise(text)


def let(x: Column, then) -> Column:
    """then(x), where x is computed once however often then reads it: in a lambda Spark would compute it at each place, once an item."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def relative_dates(text: Column, ts: Column) -> Column:
    """What relative dates of a text mean at its time; empty where none or no time is known.

    Rules in order, then counted phrases; a phrase counts once whatever its case. A count that leads
    out of the calendar is skipped. No phrase of one rule overlaps one of another, so that the text is
    searched once for all rules, and the phrases found are told apart.
    """
    at = F.to_date(F.timestamp_millis(ts))
    day, month, year = "dd MMMM yyyy", "MMMM yyyy", "yyyy"
    week = lambda d: F.concat(F.lit("week of "), F.date_format(F.date_trunc("week", d), day))
    shown = lambda d, form: F.date_format(d, form)
    rules = [
        ("last night", shown(F.date_add(at, -1), day)),
        ("yesterday", shown(F.date_add(at, -1), day)),
        ("tomorrow", shown(F.date_add(at, 1), day)),
        ("(?:today|tonight)", shown(at, day)),
        ("last week", week(F.date_add(at, -7))),
        ("this week", week(at)),
        ("next week", week(F.date_add(at, 7))),
        ("last month", shown(F.add_months(at, -1), month)),
        ("this month", shown(at, month)),
        ("next month", shown(F.add_months(at, 1), month)),
        ("last year", (F.year(at) - 1).cast("string")),
        ("this year", F.year(at).cast("string")),
        ("next year", (F.year(at) + 1).cast("string")),
    ]

    def plain(p: Column) -> Column:
        """The phrase with the number of its rule, and what it means."""
        out = None
        for n, (pattern, means) in enumerate(rules):
            test, told = p.rlike(f"(?iU)^{pattern}$"), F.struct(F.lit(n).alias("rule"), p.alias("phrase"), means.alias("means"))
            out = F.when(test, told) if out is None else out.when(test, told)
        return out

    def counted(p: Column) -> Column:
        word = F.lower(F.regexp_extract(p, f"(?iU){fixed.N_AGO}", 1))
        unit = F.lower(F.regexp_extract(p, f"(?iU){fixed.N_AGO}", 2))
        table = F.create_map(*(F.lit(x) for kv in fixed.QUANTITIES.items() for x in kv))

        def means(n: Column) -> Column:
            years = F.year(at) - n
            return (
                F.when(unit == "day", shown(F.date_add(at, -n), day))
                .when(unit == "week", shown(F.date_add(at, -7 * n), day))
                .when(unit == "month", shown(F.add_months(at, -n), day))
                .otherwise(F.when(years > 0, years.cast("string")))
            )

        n = F.coalesce(F.try_element_at(table, word), word.try_cast("int"))
        return F.struct(F.lit(len(rules)).alias("rule"), p.alias("phrase"), let(F.when(n < 20000, n), means).alias("means"))

    def joined(found: Column) -> Column:
        keys = F.transform(found, lambda x: F.lower(x["phrase"]))
        first = let(keys, lambda k: F.filter(found, lambda x, i: F.array_position(k, F.lower(x["phrase"])) == i + 1))
        text = F.array_join(F.transform(first, lambda x: F.concat(x["phrase"], F.lit(" = "), x["means"])), "; ")
        return F.when(F.size(found) > 0, F.concat(F.lit(" [Resolved relative dates: "), text, F.lit("]"))).otherwise("")

    told = F.transform(find_all(text, rf"(?iU)\b(?:{'|'.join(pattern for pattern, _ in rules)})\b"), plain)
    ago = F.filter(F.transform(find_all(text, f"(?iU){fixed.N_AGO}"), counted), lambda x: x["means"].isNotNull())
    of = lambda n: lambda x: x["rule"] == n
    by_rule = lambda x: F.concat(*(F.filter(x, of(n)) for n in range(len(rules))))
    # One phrase is in order; more are put in order of their rules, and as they stand within a rule.
    ordered = let(told, lambda x: F.when(F.size(x) < 2, x).otherwise(by_rule(x)))
    return F.when(known(ts), let(F.concat(ordered, ago), joined)).otherwise("")


def overlap(a: Column, b: Column) -> Column:
    """Shared words by the size of the smaller set; zero if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def counted(words: Column) -> Column:
    """The distinct words of an array, each with its number: the runs of the sorted array, without a step for each two words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        run = lambda at, k, all_: F.struct(F.element_at(s, at).alias("term"), (F.coalesce(F.get(all_, k + 1), F.size(s) + 1) - at).cast("bigint").alias("tf"))
        return let(starts, lambda a: F.transform(a, lambda at, k: run(at, k, a)))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs))
