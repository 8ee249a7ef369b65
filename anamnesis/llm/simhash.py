"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into blocks A, B and C of 13 bits and D of 25.  Of four differing
bits, D has at most one, or A, B and C have at most two and then some pair of these three at most
one.  So one of the segments AB, BC, AC and D is equal or differs by one bit.  A segment as it is,
and its variants with a wildcard bit, are keys of an equality join, and what meets is verified on
all 64 bits.  Four segments of 25 or 26 bits let far fewer strangers meet than three of 21, which
would be the fewest.

Only what a component needs is compared. Equal fingerprints count once. What has equal segments is
compared with the least and the greatest of its key, and the components so found are labels from
then on: a key matters only if it has several components, and a variant only if both values of its
wildcard bit occur, as equal segments have met already. Of these keys' members each is compared
with the key's ends; then the members outside the key's largest component with the others of the
key. Where a key has more than FEW of them, its members are cut again, by the bits that their key
hasn't used, so that strangers don't all meet. No pair inside a known component is made, and no
link between components is lost.

first_of_each is a stage for texts, not fingerprints: it links texts whose five-word shingles are
alike by 0.8 or more. Such texts differ in up to a sixth of the bits, too many for segments, so
that they are joined by their shingles (jaccard.texts_alike), exactly.

Nulls: a null text has no words, and its fingerprint is zero, linked like any other. A null doc_id
takes part but is never a component's id; a component of null ids only has a null id. Repeated rows
are returned as often as they come. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, whole
from .components import components
from .tokens import MIX, cut, lowered, mixed, word_hashes

BITS, SEED, SHINGLE = 4, 42, 4
#: The bits of A, B, C and D, and the segments.
A, B, C, D = range(13), range(13, 26), range(26, 39), range(39, 64)
SEGMENTS = ((*A, *B), (*B, *C), (*A, *C), (*D,))
#: Members outside a key's largest component that are compared as they are; more are cut again.
FEW = 32
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 15
#: Of the stage: words of a shingle.
SIMILAR = 5
#: Rows, at about 60 bytes each, that are sent to all tasks; more meet the texts by a shuffle.
BROADCAST = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set if over half the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = lowered(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [e - len(w) for e, w in zip(ends, words)]
    hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :])]
    return int(majority(np.array(hashes, "<u8")))


def majority(hashes: np.ndarray) -> np.int64:
    """The bits that over half the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(text) for (text,) in rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def masked(fp: Column, bits) -> Column:
    """The value of these bits of fp, moved down where they are high."""
    low = min(bits) if min(bits) > 32 else 0
    return F.shiftrightunsigned(fp, low).bitwiseAND(sum(1 << (b - low) for b in bits))


def plain(fp: Column) -> Column:
    """The segments of a fingerprint, each with its number."""
    return F.array(*(masked(fp, s).bitwiseOR(n << 40) for n, s in enumerate(SEGMENTS)))


def variants(fp: Column) -> Column:
    """The keys of a fingerprint, an array of (key, side): segments, with side 4; and for each bit of each, the segment without it, with side 1 or 2 as the bit is."""
    keys = [F.struct(masked(fp, s).bitwiseOR(n << 40).alias("key"), F.lit(4).alias("side")) for n, s in enumerate(SEGMENTS)]
    for n, segment in enumerate(SEGMENTS):
        for bit in segment:
            keys.append(F.struct(masked(fp, [b for b in segment if b != bit]).bitwiseOR((64 * (n + 1) + bit) << 40).alias("key"), (F.shiftrightunsigned(fp, bit).bitwiseAND(1).cast("int") + 1).alias("side")))
    return F.array(*keys)


def again(fp: Column, key: Column) -> Column:
    """Keys of the bits that a key's segment doesn't have, cut into blocks and segments as all 64 are; they differ in at most BITS too."""
    segment = F.shiftrightunsigned(key, 40)
    out = None
    for n, used in enumerate(SEGMENTS):
        rest = [b for b in range(64) if b not in used]
        at = [len(rest) * k // 5 for k in (0, 1, 2, 3, 5)]
        a, b, c, d = (rest[i:j] for i, j in zip(at, at[1:]))
        keys = [F.xxhash64(F.lit(64 * k + bit), key, fp.bitwiseAND(signed(sum(1 << x for x in s if x != bit)))) for k, s in enumerate((a + b, b + c, a + c, d)) for bit in s]
        mine = (segment == n) | (F.floor(segment / 64) == n + 1)
        out = F.when(mine, F.array(*keys)) if out is None else out.when(mine, F.array(*keys))
    return out


def signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dealt(df: DataFrame) -> DataFrame:
    """Each row becomes many: dealt out first, as few tasks would read so small a table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ends(keyed: DataFrame) -> DataFrame:
    """keyed with the least and the greatest fp of each key that has several."""
    found = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    return keyed.join(materialize(found, "simhash-ends"), "key")


def stars(members: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of members to the low and the high fingerprint of their keys."""
    fp = F.col("fp")
    near = F.filter(F.array("low", "high"), lambda e: (e != fp) & (apart(e, fp) <= bits))
    return members.select(fp.alias("a"), F.explode(near).alias("b"))


def bridges(members: DataFrame, bits: int, few: int = FEW) -> DataFrame:
    """Links (a, b) between the roots of the members (key, side, fp, root) of a key."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("others")).where("others > 0")
    out = sizes.join(main, "key").where("root <> main").select("key", "root", "others")
    outside = materialize(members.join(materialize(out, "simhash-outside"), ["key", "root"]), "simhash-outsiders")
    met = linked(outside.where(F.col("others") <= few), members, "key", bits)
    many = outside.where(F.col("others") > few)
    if many.head(1):
        # The key's members again, each by the bits that its key hasn't used.
        sub = F.explode(again(F.col("fp"), F.col("key"))).alias("sub")
        some = members.join(materialize(many.select("key").distinct(), "simhash-many"), "key", "left_semi")
        met = met.unionByName(linked(dealt(many).select("*", sub), dealt(some).select("*", sub), "sub", bits))
    return met


def linked(some: DataFrame, members: DataFrame, key: str, bits: int) -> DataFrame:
    """Links (a, b) of roots: some of a key's members with its members of other roots, and in a variant of the other side."""
    a, b = some.alias("a"), members.alias("b")
    other = (F.col("a.root") != F.col("b.root")) & ((F.col("a.side") == 4) | (F.col("a.side") != F.col("b.side")))
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.key") == F.col("b.key")) & other & (apart(F.col("a.fp"), F.col("b.fp")) <= bits))
    return met.select(F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct()


def renamed(df: DataFrame, roots: DataFrame, of: str = "root") -> DataFrame:
    """df with the root of a column of it, which is its own root where roots (node, root) don't have it."""
    tops = roots.select(F.col("node").alias("_node"), F.col("root").alias("_top"))
    return df.join(tops, F.col(of) == F.col("_node"), "left").withColumn("root", F.coalesce("_top", of)).drop("_node", "_top")


def groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    if bits > BITS:
        raise ValueError(f"these segments find at most {BITS} differing bits")
    kinds = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-kinds")
    roots = components(stars(ends(kinds.select("fp", F.explode(plain(F.col("fp"))).alias("key"))), bits))
    kinds = materialize(renamed(kinds, roots, "fp"), "simhash-rooted")
    keyed = dealt(kinds.select("fp", "root")).select("fp", "root", F.explode(variants(F.col("fp"))).alias("x")).select("fp", "root", "x.*")
    # Both sides of a variant, or a segment's.
    known = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bit_or("side").alias("sides"))
    known = known.where("low <> high and sides >= 3").select("key", "low", "high")
    # A merge join at every size: a hot key's members can then be split among tasks.
    members = materialize(keyed.join(materialize(known, "simhash-keys").hint("merge"), "key"), "simhash-members")
    # Labels so far are links as well, of each member to its root.
    tops = components(stars(members, bits).unionByName(members.select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct()))
    members = materialize(renamed(members, tops).select("key", "side", "fp", "root"), "simhash-open")
    last = components(bridges(members, bits))
    kinds = materialize(renamed(renamed(kinds, tops), last), "simhash-named")
    ids = materialize(kinds.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    named = materialize(kinds.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, its fingerprint as 16 hex digits, and the least doc_id it is linked to, itself included."""
    found = groups(materialize(fingerprints(documents), "simhash-prints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_words(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order."""
    return np.concatenate([word_hashes(piece) for piece in cut(lowered(text))] or [np.zeros(0, np.uint64)])


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each shingle, repeats included; of fewer words, that of all of them."""
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        h = mixed(h * MIX + words[k : len(words) - size + 1 + k])
    return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of a text with fewer words, that of all its words."""
    return np.unique(rolled(text_words(text), size))


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sent(found: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of short rows, broadcast if it has no more than `most` (BROADCAST); else joined by a merge, whose hot keys can be split."""
    most = BROADCAST if most is None else most
    return F.broadcast(found) if found.limit(most + 1).count() <= most else found.hint("merge")


def first_of_each(documents: DataFrame, **how) -> DataFrame:
    """One document of each group of similar texts (see jaccard.texts_alike): that with the least doc_id, nulls last, then the least digest.

    Rows are told apart by id and text, so that a row goes only for what its own text is like. Of
    rows alike in both that one stays which is least as JSON. Null texts count as empty; texts
    without words are alike only if they are equal.
    """
    from .jaccard import texts_alike

    found = materialize(texts_alike(documents, **how), "simhash-similar")
    rows_ = documents.select(whole(documents).alias("d")).select("d", F.col("d.doc_id").alias("id"), digest(F.col("d.text")).alias("digest"))
    each = rows_.groupBy("id", "digest").agg(F.count("*").alias("n")).join(found, "digest")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    each = materialize(each.select("id", "digest", "n", "root", rank.alias("rank")), "simhash-rows")
    firsts = each.groupBy("root").agg(F.min("rank").alias("least"))
    goes = each.join(firsts, "root").select("id", "digest", (F.col("rank") == F.col("least")).alias("stays"), "n").where("not stays or n > 1")
    goes = materialize(goes.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "stays"), "simhash-goes")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    kept = rows_.join(sent(goes), same, "left_anti").select("d")
    twins = goes.where("stays")
    if twins.head(1):
        kept = kept.unionByName(rows_.join(twins, same).groupBy("id", "digest").agg(F.min_by("d", F.to_json("d")).alias("d")).select("d"))
    return kept.select("d.*")
