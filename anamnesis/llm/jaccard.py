"""N-gram Jaccard join by parity sketches.

A set's sketch flips one bit for each shingle's hash, so that the sketches of two sets differ in no more
bits than the sets differ in shingles.  Sets of sizes a and b that are alike by p / q differ in at most
(a + b) (q - p) / (q + p) shingles.  Within a band of sizes that is at most some D, so of D + 1 segments
of their sketches one at least is equal.  A set is indexed by its segments in the band of its size, and as
a guest in the next bands that a larger partner may be in.  Segments are WIDTH bits, of which about ten
are odd, so wide that strangers hardly share them by chance, and are joined by the XOR of the hashes of their odd bits.

Equal sets are one node.  Members of a key that has few are paired with each other, unless their
sizes or a short sketch of the whole sets rule a link out.  Of a key's many members only the pairs with
one of them, the pivot, are compared: the member that shares most segments.  Its differences to the others are kept, as they are
all that is needed of the rest: the sets x and z, given by what they differ in from any one set, differ
in what these differences differ in.  So the members of a pivot are described by what they differ in
from what most of them have, and the one nearest to that is compared with all: what differs little is
linked to it.  The others are linked only through differences that they share (see meet).  No pairs
of a group are made but these, and no link between two that aren't joined otherwise is lost.

texts_alike is for similarities under that, which take a segment for every few shingles. Its keys
are a prefix: of all shingles in one order the first n - ceil(n p / q) + 1 of each set, of which two
sets that are alike by p / q share one at least. Any order does, so that one is taken in which few strangers
meet: what a sample has often comes last, and of the rest what is made of common words, as texts share that by
chance, the more of them the more texts there are. All that follows the keys is the same.

Nulls and texts without words have an empty set, linked with nothing; a text of fewer words than a
shingle has one shingle, all its words. A null doc_id takes part but is never a component's id; a
component of null ids only has a null id. Repeated rows are returned as often as they come. Other columns
aren't read. No rows give no rows. Shingles are compared by 64-bit hashes, sets of one node by 128 bits.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, batches_of, materialize, rows
from .components import components
from .simhash import SIMILAR, digest, renamed, rolled, sent, shingles, text_words
from .tokens import MIX, STEP, mixed

#: Words of a shingle; p and q of the similarity; bits of a segment.
SHINGLE, LIKE, WIDTH = 3, (90, 100), 1 << 32
#: Members of a prefix's key that are paired with each other (of a segment's, two); bits of a mark at least.
FEW, MARK = 32, 64
#: Members of a pivot that are compared in one task; shingles of its first ones that its centre is found by.
PART, CENTRE = 256, 1 << 21
#: Ids, at 8 bytes each, that are sent to all tasks.
IDS = 1_000_000
#: Of texts_alike: similarity; one text in how many is looked at for common shingles and words, at most how many
#: texts and characters of each, and how many of either are sent to all tasks. They only order the shingles.
NEAR, RATE, TEXTS, CHARS, COMMON = (8, 10), 16, 1 << 16, 1 << 15, 1 << 18
#: Steps between a word and one twice as common.
STEPS = 16


def band_starts(largest: int = 1 << 40) -> list[int]:
    """The least sizes of the bands, each half as large again as the one before, up to beyond a size."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


STARTS = band_starts()


def most_apart(sizes: int, p: int, q: int) -> int:
    """Shingles that two sets whose sizes add up to this may differ in."""
    return sizes * (q - p) // (q + p)


@cache
def spares(band: int, p: int, q: int) -> int:
    """Segments of a band beyond those that the bound needs: more than the least set of the band, or guest, has without a bit, but for some in a million."""
    most = most_apart(2 * (STARTS[band + 1] - 1), p, q)
    least = -(-STARTS[band] * p // q)
    spare = 1
    while spare <= most // 4:
        empty = (most_apart(least + least * q // p, p, q) + 1 + spare) * math.exp(-least / (most + 1 + spare))
        if spare >= empty + 5 * math.sqrt(empty) + 1:
            break
        spare += 1 + spare // 16
    return spare


def segment_keys(hashes: np.ndarray, band: int, p: int, q: int) -> np.ndarray:
    """The keys of a set's segments in a band; none where only equal sets are alike.

    There are enough segments for the band's largest sets, and some to spare. Of these the first are taken
    that the set needs for its own partners: of any D + 1 + spare segments, spare + 1 are equal if D
    shingles differ. So each set leaves out its first `spare` segments without a bit, which many
    strangers share: if all that two sets have in common are such, neither leaves out the last of them.
    """
    most = most_apart(2 * (STARTS[band + 1] - 1), p, q)
    if not most:
        return np.zeros(0, np.int64)
    spare = spares(band, p, q)
    count = most + 1 + spare
    turned = mixed(hashes ^ mixed(np.full(1, band, np.uint64) * STEP))
    segment = (turned >> np.uint64(32)) % np.uint64(count)
    bit = segment * np.uint64(WIDTH) + turned % np.uint64(WIDTH)
    bits = np.zeros(count, np.uint64)
    # A bit that is flipped twice cancels out.
    np.bitwise_xor.at(bits, segment.astype(np.int64), mixed(bit * MIX + STEP))
    n = len(hashes)
    bits = bits[: most_apart(n + n * q // p, p, q) + 1 + spare]
    keys = mixed(np.arange(len(bits), dtype=np.uint64) + np.uint64(band << 40)) ^ bits
    return np.delete(keys, np.flatnonzero(bits == 0)[:spare]).view(np.int64)


def keys_of(hashes: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys in the band of its size, and those as a guest of the next ones that larger partners may be in."""
    band = bisect_right(STARTS, len(hashes)) - 1
    home = segment_keys(hashes, band, p, q)
    guest = [np.zeros(0, np.int64)]
    while len(hashes) * q >= p * STARTS[band + 1]:
        band += 1
        guest.append(segment_keys(hashes, band, p, q))
    return home, np.concatenate(guest)


def common(documents: DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """Shingles that a bounded sample has more than once, and how often; words that it has more than once, and how common they are in STEPS."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [text_words(text) for (text,) in rows(batch, "text")]
            for word, each in (False, [np.unique(rolled(w, size)) for w in found]), (True, found):
                h, c = np.unique(np.concatenate(each or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([word] * len(h), pa.bool_()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["word", "h", "c"])

    rate = max(RATE, -(-documents.count() // TEXTS))
    some = documents.where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0).select(F.substring("text", 1, CHARS).alias("text")).distinct()
    found = materialize(some.mapInArrow(run, "word boolean, h bigint, c bigint").groupBy("word", "h").agg(F.sum("c").alias("c")).where("c > 1"), "jaccard-common")
    out = []
    for word in (False, True):
        most = found.where(F.col("word") == word).orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toPandas()
        h, c = most["h"].to_numpy(np.int64).view(np.uint64), most["c"].to_numpy(np.int64)
        order = np.argsort(h)
        out += [h[order], np.rint(np.log2(c[order]) * STEPS).astype(np.int64) if word else c[order]]
    return tuple(out)


def looked_up(h: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each hash, 0 where it isn't known."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, values[at], 0)


def mark(hashes: np.ndarray) -> np.ndarray:
    """A short sketch of a whole set: as many bits as shingles, rounded up to a power of two, of which each shingle flips one."""
    bits = MARK << (max(0, len(hashes) - 1) // MARK).bit_length()
    return np.packbits(np.bincount((mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def folded(marks: Column) -> Column:
    """A mark of half as many bits."""
    half = (F.size(marks) / 2).cast("int")
    return F.zip_with(F.slice(marks, F.lit(1), half), F.slice(marks, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def prefix(words: np.ndarray, size: int, p: int, q: int, often: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first shingles of a set, as many as two sets alike by p / q can't differ in: those last that are often seen, and those late whose words are common.

    A shingle's place in the order follows from its hash, or from its words, which are the same wherever it is.
    """
    hashes, at = np.unique(rolled(words, size), return_index=True)
    size = min(size, len(words))
    each = looked_up(words, *often[2:])
    together = sum(each[k : len(words) - size + 1 + k] for k in range(size))
    order = np.lexsort((mixed(hashes), together[at], looked_up(hashes, *often[:2])))
    return hashes[order[: len(hashes) - -(-len(hashes) * p // q) + 1]].view(np.int64)


def prints(documents: DataFrame, size: int, p: int, q: int, often=None) -> DataFrame:
    """(doc_id, digest, n, h1, h2, mark, home, guest) of every document: its set's size, hashes, mark and keys; these are prefixes, if common shingles are given in a broadcast."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        lists = pa.list_(pa.int64())
        for whole in batches:
            # What is made of a slice is sent before the next.
            for start in range(0, whole.num_rows, SLICE):
                batch, out = whole.slice(start, SLICE), []
                at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest")}
                for (text,) in rows(batch, "text"):
                    words = text_words(text)
                    h = np.unique(rolled(words, size))
                    home = guest = np.zeros(0, np.int64)
                    if len(h):
                        home, guest = keys_of(h, p, q) if often is None else (prefix(words, size, p, q, often.value), guest)
                    sums = [mixed(h * MIX).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(h + STEP), initial=np.uint64(0))]
                    out.append((len(h), *(int(s.astype(np.int64)) for s in sums), mark(h), home, guest))
                n, h1, h2, marks, home, guest = zip(*out)
                yield pa.RecordBatch.from_arrays([at["doc_id"].cast(pa.int64()), at["digest"], *(pa.array(x, pa.int64()) for x in (n, h1, h2)), *(pa.array(x, lists) for x in (marks, home, guest))], ["doc_id", "digest", "n", "h1", "h2", "mark", "home", "guest"])

    schema = "doc_id bigint, digest string, n bigint, h1 bigint, h2 bigint, mark array<bigint>, home array<bigint>, guest array<bigint>"
    return documents.select("doc_id", digest(F.col("text")).alias("digest"), "text").mapInArrow(run, schema)


def pairs_of(members: DataFrame, told: DataFrame, n: DataFrame, p: int, q: int, few: int) -> DataFrame:
    """(pivot, node) of all pairs of a key's members that may be linked: by their sizes, and as marks differ in no more bits than sets in shingles."""
    lists = members.groupBy("key").agg(F.collect_list("node").alias("nodes")).select(F.sort_array("nodes").alias("nodes"))
    lists = lists.select("nodes", F.posexplode("nodes").alias("at", "pivot"))
    both = materialize(lists.select("pivot", F.explode(F.slice("nodes", F.col("at") + 2, few)).alias("node")).distinct(), "jaccard-few")
    sized = both.join(n, "node").join(n.select(F.col("node").alias("pivot"), F.col("n").alias("pn")), "pivot")
    sized = materialize(sized.where(F.least("n", "pn") * q >= F.greatest("n", "pn") * p), "jaccard-sized")
    marks = told.select(F.col("row").alias("node"), "mark")
    met = sized.join(marks, "node").join(marks.select(F.col("node").alias("pivot"), F.col("mark").alias("pmark")), "pivot")
    for _ in range((-(-q // p) - 1).bit_length()):
        met = met.withColumn("mark", F.when(F.size("mark") > F.size("pmark"), folded(F.col("mark"))).otherwise(F.col("mark")))
        met = met.withColumn("pmark", F.when(F.size("pmark") > F.size("mark"), folded(F.col("pmark"))).otherwise(F.col("pmark")))
    far = F.aggregate(F.zip_with("mark", "pmark", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return met.where(far * (q + p) <= (F.col("n") + F.col("pn")) * (q - p)).select("pivot", "node")


def by_size(members: DataFrame, n: DataFrame, p: int, q: int) -> DataFrame:
    """(key, node, c) of members of keys, each key cut into bands of sizes: what is linked is in one, or in two that follow each other.

    A set is also a guest of the band above its own. Bands are a little wider than a link reaches, for the rounding of logarithms.
    """
    band = F.floor(F.log("n") / math.log(1.001 * q / p))
    own = F.explode(F.array(*(F.struct((band + k).alias("band"), F.lit(not k).alias("home")) for k in (0, 1)))).alias("x")
    dealt = members.select("key", "node").join(n, "node").select("node", "key", own).select("node", F.xxhash64("key", "x.band").alias("key"), "x.home")
    dealt = materialize(dealt, "jaccard-bands")
    known = dealt.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("home")).where("c > 1 and home").select("key", "c")
    return materialize(dealt.select("key", "node").join(known.hint("merge"), "key"), "jaccard-banded")


def stars(told: DataFrame, kinds: DataFrame, p: int, q: int, few: int = 2) -> DataFrame:
    """(pivot, node, many) of nodes that share a key with its pivot; many, if the key has more than a few members. The others are paired with each other.

    Where more than two are few, keys are of all sizes, and those of many members are cut by size first.
    """
    flagged = lambda c, home: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(home).alias("home")))
    one = told.select("row", "home", "guest").join(sent(kinds.select(F.col("node").alias("row")), IDS), "row", "left_semi")
    keyed = one.select(F.col("row").alias("node"), F.explode(F.concat(flagged("home", True), flagged("guest", False))).alias("x")).select("node", "x.*")
    known = keyed.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("home")).where("c > 1 and home").select("key", "c")
    # Merge joins: a hot key's members can be split among tasks.
    members = materialize(keyed.select("key", "node").join(materialize(known, "jaccard-keys").hint("merge"), "key"), "jaccard-members")
    n = kinds.select("node", "n")
    some, members = members.where(F.col("c") <= few), members.where(F.col("c") > few)
    if few > 2:
        members = by_size(members, n, p, q)
        some, members = some.unionByName(members.where(F.col("c") <= few).select(*some.columns)), members.where(F.col("c") > few)
    paired = pairs_of(some, told, n, p, q, few).select("pivot", "node", F.lit(False).alias("many"))
    shares = members.groupBy("node").agg(F.count("*").alias("shares"))
    members = materialize(members.join(shares.hint("merge"), "node"), "jaccard-shares")
    pivots = members.groupBy("key").agg(F.max(F.struct("shares", F.col("node").alias("pivot"))).alias("top")).select("key", "top.pivot")
    met = members.join(materialize(pivots, "jaccard-pivots").hint("merge"), "key").where("node <> pivot").select("pivot", "node", F.lit(True).alias("many"))
    return materialize(met.unionByName(paired).groupBy("pivot", "node").agg(F.max("many").alias("many")), "jaccard-stars")


def usual(found: list[np.ndarray]) -> np.ndarray:
    """The hashes that over half of some sets have."""
    words, counts = np.unique(np.concatenate(found), return_counts=True)
    return words[2 * counts > len(found)]


def differences(star: DataFrame, kinds: DataFrame, documents: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """(pivot, pn, node, n, linked, centre, more, less): what each member has that its pivot hasn't, and what it lacks; null unless many.

    Of a node's texts one is read. Members come after their pivot, and a pivot with many is in many tasks.
    A row more, with centre, tells what most of some members have: a set of no text, only to tell the others by.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        pivot, held, out, some, room = None, None, [], [], 0
        names = ["pivot", "pn", "node", "n", "linked", "centre", "more", "less"]

        def batch_of(found):
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

        def centre() -> list[tuple]:
            if not some:
                return []
            more, less = (usual([m[k] for m in some]) for k in (0, 1))
            return [(pivot, len(held), pivot, len(held), None, True, more, less)]

        for batch in batches:
            for at, part, node, many, text in rows(batch, "pivot", "part", "node", "many", "text"):
                mine = shingles(text, size).view(np.int64)
                if many is None:
                    out += centre()
                    pivot, held = at, mine
                    # The first part of a pivot looks for its centre, among as many as it has room for.
                    some, room = [(held[:0], held[:0])] if part == 0 else [], CENTRE
                    continue
                more, less = np.setdiff1d(mine, held, assume_unique=True), np.setdiff1d(held, mine, assume_unique=True)
                apart = len(more) + len(less)
                linked = q * (len(held) + len(mine) - apart) >= p * (len(held) + len(mine) + apart)
                if many and some and apart <= room:
                    some.append((more, less))
                    room -= apart
                out.append((pivot, len(held), node, len(mine), linked, False, *((more, less) if many else (None, None))))
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        out += centre()
        if out:
            yield batch_of(out)

    parts = F.ceil(F.col("c") / PART).cast("int")
    loads = materialize(star.groupBy("pivot").agg(F.count("*").alias("c")).select("pivot", parts.alias("parts")), "jaccard-loads")
    heads = loads.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("boolean").alias("many"))
    dealt = star.join(loads, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "many")
    places = materialize(heads.unionByName(dealt), "jaccard-places")
    wanted = materialize(places.select("node").distinct().join(kinds.select("node", "digest"), "node"), "jaccard-wanted")
    texts = documents.select(digest(F.col("text")).alias("digest"), "text").join(sent(wanted), "digest").groupBy("node").agg(F.first("text").alias("text"))
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As many tasks as there are partitions, so that none gets many long texts at once.
    held = texts.join(places.hint("merge"), "node").repartition(tasks, "pivot", "part").sortWithinPartitions("pivot", "part", F.col("many").isNotNull(), "node")
    schema = "pivot bigint, pn bigint, node bigint, n bigint, linked boolean, centre boolean, more array<bigint>, less array<bigint>"
    return materialize(held.select("pivot", "part", "node", "many", "text").mapInArrow(run, schema), "jaccard-differences")


def from_the_centre(found: DataFrame) -> DataFrame:
    """(pivot, node, n, more, less): the members of pivots that have unlinked ones, and the pivots themselves, told from what most have."""
    none = F.array().cast("array<bigint>")
    some = found.where("not centre and more is not null")
    open_ = materialize(some.where("not linked").select("pivot").distinct(), "jaccard-open")
    told = some.join(open_, "pivot", "left_semi").select("pivot", "node", "n", "more", "less")
    own = some.join(open_, "pivot", "left_semi").groupBy("pivot").agg(F.first("pn").alias("n")).select("pivot", F.col("pivot").alias("node"), "n", none.alias("more"), none.alias("less"))
    centres = found.where("centre").join(open_, "pivot", "left_semi").select("pivot", F.col("more").alias("cm"), F.col("less").alias("cl"))
    met = told.unionByName(own).join(materialize(centres, "jaccard-centres"), "pivot")
    more = F.concat(F.array_except("more", "cm"), F.array_except("cl", "less")).alias("more")
    less = F.concat(F.array_except("cm", "more"), F.array_except("less", "cl")).alias("less")
    return met.select("pivot", "node", "n", more, less)


def alike(a: Column, b: Column, d: Column, p: int, q: int) -> Column:
    return q * (a + b - d) >= p * (a + b + d)


def verified(met: DataFrame, items: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (pivot, a, b) those that are linked."""
    side = lambda c: items.select("pivot", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("d").alias(f"d_{c}"), F.col("apart").alias(f"apart_{c}"))
    both = met.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
    far = F.col("d_a") + F.col("d_b") - 2 * F.size(F.array_intersect("apart_a", "apart_b"))
    return both.where(alike(F.col("n_a"), F.col("n_b"), far, p, q)).select("pivot", "a", "b")


def meet(told: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) among the members of a pivot, told from a centre; enough of them to join all that are linked.

    Let x and z, of n shingles each, differ from the centre by dx and dz, of which they share s. They differ by
    dx + dz - 2s, and D = (nx + nz) (q - p) / (q + p) is the most that links them. With v = n (q - p) - d (q + p),
    they are linked whatever they share if vx + vz >= 0; and then both are linked to the top, the member
    whose v is greatest. So all are compared with the top, and what isn't linked to it, with one for each of its
    differences: of those linked to the top that have it, the one with the greatest v.

    What is left over is linked only to what it shares t = (dx + dz - D) / 2 >= 1 differences with. With one
    order of all shingles, first what the centre lacks, as edits put in what is rare, x and z meet in the first
    d - t + 1 of each: for the smaller d, t is at least d - D / 2, for the larger d - D. The first that they
    share leaves no more to share than what follows it in both; where that is under t, they don't meet.
    """
    d = F.size("apart")
    items = told.select("pivot", "node", "n", F.concat(F.array_sort("more"), F.array_sort("less")).alias("apart"))
    items = items.withColumns({"d": d, "v": F.col("n") * (q - p) - d * (q + p)})
    widest = F.floor((F.col("n") + F.floor(F.col("n") * q / p)) * (q - p) / (q + p))
    length = lambda least: (F.col("d") - F.greatest(F.lit(1), F.col("d") - least) + 1).cast("int")
    items = materialize(items.withColumns({"short": length(F.floor(widest / 2)), "long": length(widest)}), "jaccard-items")
    tops = materialize(items.groupBy("pivot").agg(F.max_by(F.struct("node", "n", "d", "apart"), F.struct("v", "node")).alias("top")), "jaccard-tops")
    far = F.col("d") + F.col("top.d") - 2 * F.size(F.array_intersect("apart", "top.apart"))
    known = items.join(tops, "pivot").select("pivot", "node", F.col("top.node").alias("top"), alike(F.col("n"), F.col("top.n"), far, p, q).alias("near"))
    known = materialize(known, "jaccard-known")
    links = known.where("near and node <> top").select("pivot", F.col("top").alias("a"), F.col("node").alias("b"))

    marked = items.join(known.select("pivot", "node", "near"), ["pivot", "node"])
    words = marked.where("d > 0").select("pivot", "node", "near", "v", F.explode(F.slice("apart", F.lit(1), F.col("long"))).alias("w"))
    ones = marked.where("near and d > 0").select("pivot", "node", "v", F.explode("apart").alias("w")).groupBy("pivot", "w").agg(F.max_by("node", F.struct("v", "node")).alias("a"))
    first = words.where("not near").select("pivot", F.col("node").alias("b"), "w").join(ones, ["pivot", "w"]).select("pivot", "a", "b").distinct()
    first = materialize(verified(materialize(first, "jaccard-first"), items, p, q), "jaccard-firsts")
    left = known.where("not near").join(first.select("pivot", F.col("b").alias("node")).distinct(), ["pivot", "node"], "left_anti").select("pivot", "node", F.lit(True).alias("left"))
    left = materialize(left, "jaccard-left")

    marked = items.where("d > 0").join(left.select("pivot").distinct(), "pivot", "left_semi").join(left, ["pivot", "node"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
    side = lambda c, most, at: marked.select("pivot", F.col("node").alias(c), F.col("d").alias(f"d{c}"), F.col("n").alias(f"n{c}"), F.col("left").alias(f"l{c}"), F.posexplode(F.slice("apart", F.lit(1), F.col(most))).alias(at, "w")).alias(f"_{c}")
    room = f"(da + db - 2 * least(da - i, db - j)) * {q + p} <= (na + nb) * {q - p}"
    rest = side("a", "short", "i").join(side("b", "long", "j").hint("merge"), F.expr(f"_a.pivot = _b.pivot and _a.w = _b.w and a <> b and da <= db and (la or lb) and {room}"))
    rest = materialize(rest.select("_a.pivot", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-rest")
    return links.unionByName(first).unionByName(verified(rest, items, p, q)).select("a", "b")


def joined(documents: DataFrame, size: int = SHINGLE, like: tuple[int, int] = LIKE, often=None, few: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prints; the distinct sets (node, n, first, h1, h2) that aren't empty; and links (a, b) of nodes, enough of them to join what is linked."""
    p, q = like
    if not 0 < p <= q:
        raise ValueError("a similarity is over 0 and at most 1")
    with batches_of(documents.sparkSession):
        told = materialize(prints(documents, size, p, q, often).withColumn("row", F.monotonically_increasing_id()), "jaccard-prints")
    kinds = told.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest"), F.min("row").alias("node"))
    kinds = materialize(kinds, "jaccard-kinds")
    star = stars(told, kinds, p, q, few)
    with batches_of(documents.sparkSession):
        found = differences(star, kinds, documents, size, p, q)
    links = found.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return told, kinds, materialize(links.unionByName(meet(from_the_centre(found), p, q)), "jaccard-links")


def similar(documents: DataFrame, size: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """Per document: doc_id, n_shingles, and the least doc_id that links lead to, itself included."""
    told, kinds, links = joined(documents, size, like)
    named = renamed(kinds.select("h1", "h2", "n", "first", "node"), components(links), "node")
    ids = materialize(named.select("h1", "h2", "n", "root", "first"), "jaccard-roots")
    least = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(ids.join(least, "root").select("h1", "h2", "n", "component_id"), "jaccard-components")
    alone = told.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return told.where("n > 0").join(sent(ids), ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def texts_alike(documents: DataFrame, size: int = SIMILAR, like: tuple[int, int] = NEAR) -> DataFrame:
    """(digest, root): the distinct texts by digest, and which of them links lead to; texts without words lead to themselves only."""
    often = documents.sparkSession.sparkContext.broadcast(common(documents, size))
    told, kinds, links = joined(documents, size, like, often, FEW)
    named = renamed(kinds.select("h1", "h2", "n", "node"), components(links), "node").select("h1", "h2", "n", "root")
    named = materialize(named, "jaccard-named")
    texts = told.groupBy("digest").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("n").alias("n"), F.min("row").alias("row"))
    return texts.join(named, ["h1", "h2", "n"], "left").select("digest", F.coalesce("root", "row").alias("root"))
