"""Conversation repair against plain Python: a search over whole audits, and the damage of the query."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import repair

NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def faults(rows):
    """Rows in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit) by the best rest of an audit from each row and state; inserts in any number up to three."""
    memo = {}

    def arc(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))

    for i in range(len(rows), -1, -1):
        for left in range(4):
            for state in range(4):
                best = (0, "") if i == len(rows) and state in (0, 3) else None
                options = []
                if left:
                    options += [(arc(state, r), i, left - 1, 2, "I") for r in "ua"]
                if i < len(rows):
                    _, role, _, fault = rows[i]
                    options.append((state, i + 1, 3, 3, "D"))
                    if fault not in ("blank", "duplicate"):
                        extra = fault == "truncated"
                        options += [(arc(state, role[:1]), i + 1, 3, extra, "K")] + [(arc(state, r), i + 1, 3, 2 + extra, "R") for r in "ua"]
                for to, j, n, cost, label in options:
                    rest = memo.get((j, n, to)) if to is not None else None
                    if rest is not None:
                        weight = (rest[0] + cost, label + rest[1])
                        best = weight if best is None else min(best, weight)
                memo[i, left, state] = best
    return memo[0, 3, 0]


def replay(rows, audit):
    state, i, out = 0, 0, []
    for e in audit:
        fresh = "a" if state == 2 else "u"
        if e == "D":
            i += 1
            continue
        role, text = (NAMES[fresh], "") if e == "I" else (rows[i][1] if e == "K" else NAMES[fresh], rows[i][2])
        i += e != "I"
        state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}[state, role[:1]]
        out.append((role, text))
    assert i == len(rows) and state in (0, 3)
    return out


def brute(rows):
    rows = faults(rows)
    cost, audit = cheapest(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    roles = [r[1][:1] for r in rows]
    count = lambda f: sum(r[3] == f for r in rows)
    out = replay(rows, audit)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else some(role), some(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, (turn, role, text)


def wanted(rows):
    by = {r[0]: [] for r in rows}
    for conv, row in damage(rows):
        by[conv].append(row)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted(((conv, *(brute(told) if told else none)) for conv, told in by.items()), key=str)


def some_rows(seed, conversations, most):
    random.seed(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"], ["Yes.", "No", "ok?", "", " \t", None, "Well!\n ", "x.\u0085", "Yes.", "é 😀."]
    out = []
    for conv in range(conversations):
        for turn in range(random.randint(1, most)):
            out.append((conv, random.choice([turn, turn, turn, turn + 3, None, 0]), random.choice(roles), random.choice(texts) if random.random() < 0.5 else f"Said {random.randint(0, 9)}."))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_query(spark, partitions):
    rows = some_rows(1, 250, 9) + [(None, 1, "user", "Hm."), (None, 2, None, None)] + some_rows(1, 3, 9)
    # One conversation of a third of all rows, which many tasks read.
    rows += [(9_000, t, random.choice(["user", "assistant", "assistant"]), f"Said {random.randint(0, 400)}{random.choice('.. ')}") for t in range(700)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if partitions > 1 else before)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("digest", F.lit(1)).repartition(5)
        got = repair.damage_and_repair(docs)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_search_is_the_cheapest_of_all_audits():
    """The plain search itself, against every string of edits."""
    random.seed(2)
    for _ in range(60):
        rows = [(i, random.choice(["user", "assistant", "system", "tool"]), random.choice(["", "a", "b.", f"{i}."])) for i in range(random.randint(0, 3))]
        told, best = faults(rows), None
        for n in range(len(rows), len(rows) + 5):
            for letters in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in letters) == len(rows):
                    cost, live = 0, iter(told)
                    for e in letters:
                        fault = "" if e == "I" else next(live)[3]
                        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (fault == "truncated" and e in "KR") + 99 * (fault in ("blank", "duplicate") and e in "KR")
                    try:
                        replay(told, letters)
                    except (KeyError, AssertionError):
                        continue
                    if cost < 99:
                        weight = (cost, "".join(letters))
                        best = weight if best is None else min(best, weight)
        assert best == cheapest(told)


def test_rows_and_ranges(spark):
    """The repaired rows, where each range has a row or two."""
    rows = some_rows(5, 40, 12)
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = []
    for conv in {r[0] for r in rows}:
        told = faults([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
        want += [(conv, i, *r) for i, r in enumerate(replay(told, cheapest(told)[1]))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.damage_and_repair(none).count() == 0 and repair.repaired(none).count() == 0
