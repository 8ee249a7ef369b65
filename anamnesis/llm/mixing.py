"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end on an axis of words, which is cut
into blocks of equal words.  Slot i of the schedule takes the point frac((i + 1) * golden ratio),
and the source in whose share of [0, 1) it falls; the r-th slot of a source takes its block r, and
starts again at its first block when all are used.  Any run of slots holds every source close to
its share, whatever its length.  A small source has smaller blocks and so more slots a word, that
its target isn't lost between two blocks.

Nulls: a null source is a source of its own, the last; a null text has no words; a null doc_id is
an id.  Rows that are equal in id, source and text stand side by side on the axis and are told
apart only by their place there; they may be any number.  Documents without words take nothing.  Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (5**0.5 - 1) / 2
#: Slots of a schedule, about, without those that small sources have besides: a source's target is
#: at least FINE blocks, or as many as it has words. A document is split among blocks.
SLOTS, FINE = 1 << 16, 1 << 10
#: Documents of one part of a source's axis, about, and slots of one part of the schedule.
PART = 1 << 11


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple], weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> list[tuple]:
    """(source, size, weight, target) of each source, from (source, size): pure arithmetic on a row a source.

    Sources are ordered by code point, null last, and weigh weights in turn. They share `share` of
    all words by weight; a source stops at `most` times its size and the rest goes to the others.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = [weights[i % len(weights)] for i in range(len(order))]
    full, left = {i for i, x in enumerate(order) if not x[1]}, share * sum(x[1] for x in order)
    goal = [0.0] * len(order)
    while len(full) < len(order):
        by = sum(w for i, w in enumerate(weigh) if i not in full)
        over = {i for i in range(len(order)) if i not in full and left * weigh[i] / by > most * order[i][1]}
        if not over:
            for i in set(range(len(order))) - full:
                goal[i] = left * weigh[i] / by
            break
        for i in over:
            goal[i] = most * order[i][1]
            left -= goal[i]
        full |= over
    return [(s, n, w, g) for (s, n), w, g in zip(order, weigh, goal)]


def running(df: DataFrame, by: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of value over what stands before a row of its group, part by part.

    The column part numbers the parts from 0 up in the group's order. A task sums within a part;
    only a row a part is summed over the group.
    """
    inner = Window.partitionBy(by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(by, "part").agg(F.sum(value).alias("_sum")).select(by, "part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(parts, [by, "part"]).withColumn(out, F.col("_inside") + F.col("_base")).drop("_inside", "_base", "part")


def schedule(spark, shares: list[float]) -> DataFrame:
    """(slot, src, rank): the slots, the number of the source of each, and its rank among that source's slots.

    shares: about how many slots each source has, by number. Points meet their source through the
    equal bins that its share of [0, 1) touches, so that any number of sources is a join.
    """
    total, edges, at = sum(shares), [], 0.0
    for i, n in enumerate(shares):
        edges.append((i, at, at := at + n / total if i + 1 < len(shares) else 2.0))
    bins = len(shares)
    last = F.least(F.floor(F.col("high") * bins), F.lit(bins - 1))
    shared = spark.createDataFrame(edges, "src int, low double, high double").withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * bins), F.greatest(last, F.floor(F.col("low") * bins)))))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    slots = spark.range(max(1, round(total))).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point")).withColumn("bin", F.floor(F.col("point") * bins))
    slots = slots.join(shared, "bin").where("point >= low and point < high")
    return running(slots.select("slot", "src", F.floor(F.col("slot") / PART).alias("part"), F.lit(1).alias("one")), "src", ["slot"], "one", "rank").drop("one")


def key(seed: int) -> Column:
    """What orders a source's documents."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix(documents: DataFrame, weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies (takes of its first word), source, key.

    A row a source, its sizes and target, passes through the driver.
    """
    spark = documents.sparkSession
    sized = materialize(documents.select("doc_id", "source", words(F.col("text")).alias("size"), key(seed).alias("key")), "mix-sizes")
    of = {r.source: r for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    goals = targets([(s, r.words) for s, r in of.items()], weights, share, most)
    total = sum(g[3] for g in goals)
    # The words of a block of each source.
    widths = [max(1, min(round(total / slots), round(g / FINE))) for *_, g in goals]
    plan = [(s, i, n, float(g), -(-of[s].n // PART), w, -(-n // w)) for i, ((s, n, _, g), w) in enumerate(zip(goals, widths))]
    plan = spark.createDataFrame(plan, "_source string, src int, source_size bigint, target double, parts bigint, width bigint, blocks bigint")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    none = F.lit(0).cast("bigint")
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies", "source", "key"]
    without = placed.where("size = 0").withColumns({"taken": none, "copies": none}).select(*columns)
    if not total:
        return without
    # A part is a range of keys, so that parts follow each other in the shuffled order.
    part = F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.col("parts") - 1)
    # Rows alike stand together as one, and are laid out when its place is known: any number of them is a row until then.
    axis = placed.where("size > 0").groupBy(*placed.columns).agg(F.count("*").alias("rows")).withColumns({"all": F.col("size") * F.col("rows"), "part": part})
    axis = running(axis, "src", ["key", "doc_id"], "all", "start").withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))).withColumn("start", F.col("start") + F.col("n") * F.col("size"))
    width = F.col("width")
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
    pieces = axis.withColumn("first", first).withColumn("block", F.explode(F.sequence("first", last)))
    takes = schedule(spark, [g[3] / w for g, w in zip(goals, widths)]).join(plan.select("src", "blocks"), "src").groupBy("src", F.pmod("rank", "blocks").alias("block")).agg(F.least(F.count("*"), F.lit(int(most))).alias("times"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width) - F.greatest(F.col("start"), F.col("block") * width)
    times = F.coalesce("times", none)
    # A place on the axis is one document's.
    took = pieces.join(takes, ["src", "block"], "left").groupBy("src", "start", "doc_id", "size", "source", "key", "source_size", "target").agg(F.sum(inside * times).alias("taken"), F.max(F.when(F.col("block") == F.col("first"), times)).alias("copies"))
    return took.select(*columns).unionByName(without)


def mixed(documents: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The documents as the mix takes them: each as often as its first word, so that none is cut.

    At most one document of a source differs by this from the word-exact mix. Rows alike in id,
    source and text share their takes, in the order of their other columns as JSON.
    """
    took = mix(documents, seed=seed, **how).where("copies > 0").groupBy("key", "doc_id", "source").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    took = materialize(took.withColumnsRenamed({"key": "_t_key", "doc_id": "_t_doc", "source": "_t_source"}), "mix-takes")
    keyed = documents.select(key(seed).alias("_key"), whole(documents).alias("d")).select("_key", F.col("d.doc_id").alias("_doc"), F.col("d.source").alias("_source"), "d")
    met = (F.col("_key") == F.col("_t_key")) & F.col("_doc").eqNullSafe(F.col("_t_doc")) & F.col("_source").eqNullSafe(F.col("_t_source"))
    # Texts are joined in one way at every size.
    taken = keyed.join(took.where("_rows = 1").hint("merge"), met).select("d", F.col("_copies").alias("_n"))
    if took.where("_rows > 1").head(1):
        taken = taken.unionByName(shared(keyed.join(took.where("_rows > 1"), met)))
    return taken.where("_n > 0").select("d", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).select("d.*")


def shared(found: DataFrame) -> DataFrame:
    """(d, _n): how often each of the rows alike in _key, _doc and _source is taken, of _copies for _rows of them."""
    same = ["_key", "_doc", "_source"]
    # Rows alike in all columns are one row with a number; those alike in some are ordered by the others, part by part.
    many = found.groupBy(*same, "_copies", "_rows", F.md5(F.to_json("d")).alias("_json")).agg(F.first("d").alias("d"), F.count("*").alias("_m"))
    many = many.withColumns({"_of": F.md5(F.to_json(F.struct(*same))), "part": F.conv(F.substring("_json", 1, 4), 16, 10).cast("int")})
    many = running(many, "_of", ["_json"], "_m", "_start")
    extra = F.greatest(F.lit(0), F.least(F.col("_copies") % F.col("_rows") - F.col("_start"), F.col("_m")))
    return many.select("d", (F.floor(F.col("_copies") / F.col("_rows")) * F.col("_m") + extra).alias("_n"))
