"""Conversation structure repair by composition of weighted finite-state machines.

A conversation is an input acceptor, whose symbols are its rows in order.  The edit transducer keeps,
re-roles or deletes a row, or inserts one, at a cost.  The grammar acceptor admits role initials
`(s?(ua)+)?`.  The three are composed lazily, state by state as rows arrive, and the shortest path in
topological order gives the edits; weights are pairs of a cost and the edits' initials, compared in
that order, so that ties go to the ASCII-least audit.

Before a row only as many inserts can pay as lead to other grammar states, and a row that must go only
is deleted: an insert before it could as well follow it, which sorts lower.  Inserts stand right before
the row that is consumed next, so that audits of as many rows never begin one another: their order is
held as a rank, and steps between vectors of (cost, rank) are computed once.

A conversation of any length is read by many tasks: rows are dealt in ranges of their order, each range
of a conversation becomes a table of paths from any grammar state to any other, and these short tables
are composed.  What is left to one task is the digest of a conversation's text, which SHA-256 reads in
one stream, held a row at a time, and its audit, which is one value.

Rows stand by turn (nulls first), then role, then digest of the text, so that equal rows are neighbours
and repeated rows count as duplicates. Null roles and texts are one space, a null conv_id is a
conversation. Empty texts are blank. Other columns aren't read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows

#: The grammar: arcs by state and role initial, the states that may end a conversation, roles that can be written.
GRAMMAR, ENDS, ROLES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (0, 3), {"u": "user", "a": "assistant"}
STATES, KNOWN = range(4), {role for _, role in GRAMMAR}
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
#: Adjacent role initials that are in order.
LEGAL = ("su", "ua", "au")
LABELS = [i * "I" + x for i in range(3) for x in "DKR"]


def inserted(state: int) -> list[tuple[int, int]]:
    """(state, inserts) that inserting leads to from a state, until states repeat."""
    out = [(state, 0)]
    while True:
        state = next(GRAMMAR[state, role] for role in ROLES if (state, role) in GRAMMAR)
        if any(state == s for s, _ in out):
            return out
        out.append((state, len(out)))


def edits(initial: str, truncated: bool) -> Iterator[tuple[str, str | None, int]]:
    """Arcs of the edit transducer that consume a row: (label, role initial put out, cost)."""
    yield "D", None, DELETE
    yield "K", initial, OPEN * truncated
    for role in ROLES:
        yield "R", role, REROLE + OPEN * truncated


@cache
def arcs(initial: str, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, label) of the composed machine over a row: the best from each state to each other."""
    best: dict = {}
    for state in STATES:
        for at, n in inserted(state):
            for label, put, cost in edits(initial, truncated):
                to = at if put is None else GRAMMAR.get((at, put))
                if to is not None:
                    weight = (cost + INSERT * n, n * "I" + label)
                    best[state, to] = min(best.get((state, to), weight), weight)
    return [(*ends, *weight) for ends, weight in best.items()]


@cache
def step(vector: tuple, symbol: tuple[str, bool]) -> tuple[int, tuple, bytes]:
    """Of a vector of (cost, rank) or None by state and a row: what is added to all costs, the new vector, and the arcs taken."""
    found: dict = {}
    for state, to, cost, label in arcs(*symbol):
        if vector[state] is not None:
            weight = (vector[state][0] + cost, vector[state][1], label, state)
            found[to] = min(found.get(to, weight), weight)
    base = min(w[0] for w in found.values())
    ranks = {w: n for n, w in enumerate(sorted(found.values(), key=lambda w: w[1:3]))}
    taken = bytes(found[s][3] * len(LABELS) + LABELS.index(found[s][2]) if s in found else 255 for s in STATES)
    return base, tuple((found[s][0] - base, ranks[found[s]]) if s in found else None for s in STATES), taken


class Paths:
    """The best paths over some rows from one grammar state."""

    def __init__(self, state: int):
        self.vector = tuple((0, 0) if s == state else None for s in STATES)
        self.cost, self.taken = 0, bytearray()

    def read(self, symbol: tuple[str, bool]) -> None:
        base, self.vector, taken = step(self.vector, symbol)
        self.cost += base
        self.taken += taken

    def audit(self, state: int, gone: array) -> str:
        out = []
        for at in range(len(gone) - 1, 0, -1):
            out.append("D" * gone[at])
            code = self.taken[4 * (at - 1) + state]
            out.append(LABELS[code % len(LABELS)])
            state = code // len(LABELS)
        out.append("D" * gone[0])
        return "".join(reversed(out))


class Segment:
    """What is to be known of a range of a conversation's rows."""

    def __init__(self, conv, whole: bool):
        self.conv, self.paths = conv, {s: Paths(s) for s in STATES if s == 0 or not whole}
        self.gone = array("q", [0])
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def read(self, turn, role: str, n: int, blank: bool, again: bool, truncated: bool) -> None:
        initial = role[:1]
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (n - 1) * (initial + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        lost = n if blank or again else n - 1
        self.blank += n * blank
        self.duplicate += lost * (not blank)
        if lost < n:
            self.truncated += truncated
            for p in self.paths.values():
                p.read((initial if initial in KNOWN else "", truncated))
            self.gone.append(0)
        self.gone[-1] += lost

    def row(self) -> tuple:
        found, lost = [], DELETE * sum(self.gone)
        for came, p in self.paths.items():
            for goes, w in enumerate(p.vector):
                if w is not None:
                    found.append((came, goes, p.cost + w[0] + lost, w[1], p.audit(goes, self.gone)))
        return self.conv, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first, self.last, self.low, self.high, found


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
SEGMENTS = f"conv_id bigint, {COUNTS}, turns bigint, first string, last string, low bigint, high bigint, paths array<struct<came: int, goes: int, cost: bigint, rank: int, audit: string>>"
TOTALS = f"conv_id bigint, gaps bigint, {COUNTS}, cost bigint, picks array<struct<part: int, came: int, goes: int>>, tail string"


def arrow(found: list[tuple], schema: str, spark_schema) -> Iterator:
    import pyarrow as pa

    if found:
        columns = list(zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, spark_schema)], [f.split()[0] for f in split_fields(schema)])


def split_fields(schema: str) -> list[str]:
    """The fields of a schema, without those inside its structs."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) without nulls in role and text."""
    some = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    df = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), some("role"), some("text"))
    return df.withColumn("digest", F.md5(F.col("text").cast("binary")))


def runs(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, again, truncated): equal rows of a turn are one; again, if an earlier turn has the same."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = df.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    found = light.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    found = materialize(found, "repair-runs")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = found.where("not blank").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    said = materialize(said.where("_n > 1").drop("_n"), "repair-said")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    again = ~F.col("blank") & F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    return found.join(said, same, "left").select("conv_id", "turn", "role", "digest", "n", "blank", again.alias("again"), "truncated")


def segments(found: DataFrame) -> DataFrame:
    """SEGMENTS with part: the paths over each range of a conversation's rows, in order of parts."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        path = pa.list_(pa.struct([("came", pa.int32()), ("goes", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())]))
        types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), path]
        now, out = None, []
        for batch in batches:
            for conv, *rest in rows(batch, "conv_id", "turn", "role", "n", "blank", "again", "truncated"):
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.row())
                    # Only a part's first conversation may have begun in an earlier one.
                    now = Segment(conv, whole=now is not None)
                now.read(*rest)
            yield from arrow(out, SEGMENTS, types)
            out = []
        if now:
            yield from arrow([now.row()], SEGMENTS, types)

    order = ["conv_id", "turn", "role", "digest"]
    dealt = materialize(found, "repair-order").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, SEGMENTS).withColumn("part", F.spark_partition_id()), "repair-segments")


def composed(parts: list[tuple]) -> tuple:
    """TOTALS of a conversation's segments (part, ..., paths without audits), in order."""
    vector, backs = {0: (0, 0)}, []
    counts, illegal_between, turns, low, high, last = [0] * 4, 0, 0, None, None, None
    for _, _, blank, duplicate, truncated, illegal, n, first, end, lo, hi, paths in parts:
        counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal))]
        illegal_between += last is not None and last + first not in LEGAL
        last = end
        if lo is not None:
            turns += n - (lo == high)
            low, high = lo if low is None else low, hi
        found: dict = {}
        for p in paths:
            if p["came"] in vector:
                cost, rank = vector[p["came"]]
                weight = (cost + p["cost"], rank, p["rank"], p["came"])
                found[p["goes"]] = min(found.get(p["goes"], weight), weight)
        order = {w: n for n, w in enumerate(sorted(found.values(), key=lambda w: w[1:3]))}
        vector = {s: (w[0], order[w]) for s, w in found.items()}
        backs.append({s: w[3] for s, w in found.items()})
    ends = [(cost + INSERT * n, rank, n * "I", state) for state, (cost, rank) in vector.items() for to, n in inserted(state) if to in ENDS]
    cost, _, tail, state = min(ends)
    picks = []
    for part, back in zip(reversed(parts), reversed(backs)):
        picks.append({"part": part[0], "came": back[state], "goes": state})
        state = back[state]
    counts[3] += illegal_between
    return parts[0][1], 0 if low is None else high - low + 1 - turns, *counts, cost, picks[::-1], tail


def audited(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        pick = pa.list_(pa.struct([("part", pa.int32()), ("came", pa.int32()), ("goes", pa.int32())]))
        types = [*[pa.int64()] * 7, pick, pa.string()]
        now: list = []
        for batch in batches:
            out = []
            for r in rows(batch, "part", "conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high", "paths"):
                if now and now[0][1] != r[1]:
                    out.append(composed(now))
                    now = []
                now.append(r)
            yield from arrow(out, TOTALS, types)
        if now:
            yield from arrow([composed(now)], TOTALS, types)

    found = segments(runs(ordered(conversations)))
    short = found.withColumn("paths", F.transform("paths", lambda p: F.struct(p["came"].alias("came"), p["goes"].alias("goes"), p["cost"].alias("cost"), p["rank"].alias("rank"))))
    totals = materialize(short.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, TOTALS), "repair-totals")
    picked = totals.select(F.col("conv_id").alias("_c"), F.explode("picks").alias("x")).select("_c", F.col("x.part").alias("_p"), "x.came", "x.goes")
    met = found.join(picked, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    audit = F.filter("paths", lambda p: (p["came"] == F.col("came")) & (p["goes"] == F.col("goes")))[0]["audit"]
    whole = met.select("_c", "part", audit.alias("audit")).groupBy("_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("_a"))
    out = totals.join(whole, F.col("conv_id").eqNullSafe(F.col("_c")))
    return materialize(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("_a", "tail").alias("audit")), "repair-audits")


def replayed(batches) -> Iterator[tuple]:
    """(conv, role, text) of each repaired row, and (conv, None, audit) after a conversation's last; from its audit and then its rows in order."""
    conv, audit, at, state = None, None, 0, 0

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next(r for r in ROLES if (state, r) in GRAMMAR)
            state, at = GRAMMAR[state, role], at + 1
            yield conv, ROLES[role], ""

    for batch in batches:
        for key, head, role, text in rows(batch, "conv_id", "audit", "role", "text"):
            if head is not None:
                if audit is not None:
                    yield from inserts()
                    yield conv, None, audit
                conv, audit, at, state = key, head, 0, 0
                continue
            yield from inserts()
            if audit[at] == "R":
                initial = next(r for r in ROLES if (state, r) in GRAMMAR)
                state, role = GRAMMAR[state, initial], ROLES[initial]
            elif audit[at] == "K":
                state = GRAMMAR[state, role[:1]]
            at += 1
            if audit[at - 1] != "D":
                yield conv, role, text
    if audit is not None:
        yield from inserts()
        yield conv, None, audit


def with_audits(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in order in one task, after its audit."""
    none = lambda t: F.lit(None).cast(t)
    heads = audits.select("conv_id", "audit", none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("digest"))
    told = ordered(conversations).select("conv_id", none("string").alias("audit"), "turn", "role", "text", "digest")
    both = heads.unionByName(told).withColumn("_row", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "digest").select("conv_id", "audit", "role", "text")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired rows, numbered from 0 in each conversation."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        place = 0
        for conv, role, text in replayed(batches):
            if role is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([place], pa.int64()), pa.array([role]), pa.array([text])], ["conv_id", "place", "role", "text"])
            place = 0 if role is None else place + 1

    return with_audits(conversations, audited(conversations)).mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def digests(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired rows as `role:text`, joined by line feeds, read in one stream."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        h, any_, out = hashlib.sha256(), False, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])

        for conv, role, text in replayed(batches):
            if role is None:
                out.append((conv, h.hexdigest()))
                h, any_ = hashlib.sha256(), False
            else:
                h.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
                any_ = True
            if len(out) == 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return with_audits(conversations, audits).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, without stops, repeated or re-roled by a hash of their place; nulls are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    out = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Per conversation: what is found after the damage, the cheapest edits' cost and initials, and the digest of the repaired rows."""
    told = damaged(conversations)
    audits = audited(told)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    found = every.join(audits.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    ends = digests(told, audits).withColumnRenamed("conv_id", "_d")
    found = found.join(ends, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), empty)
