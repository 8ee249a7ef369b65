"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words are quantised by their logarithm; an n-gram of
level q is put into the filter once for each of the levels 1 to q.  Probing level by level until one
is missing gives the level back: never too low, and too high with the filter's error rate.  The
probability of a word after another is its pair's count, smoothed with the word's own.

There is one way for all sizes. Texts are dealt out into parts by hash. Each part sends its distinct
n-grams with its counts of them, once, to the shards of the ranges of their hashes. A shard adds the
counts up, fills the filter's block of each of its ranges, probes it for what it was sent, and answers
each part. Parts meet their answers and score their texts. No process holds more of the filter than a
shard, and what is sent grows with the texts. Ranges follow the texts' size alone, so that scores
don't depend on how a cluster is set; a shard is some ranges in a row. N-grams are known to the
filter by 32 bits of hash within their range, and sent as the gaps between them.

The base score has exact counts of the words, which are told by 64 bits of hash; a shard answers them
with the levels.

Nulls: a null text is its end token only; a null doc_id is learned from and isn't held out. Repeated
rows are returned, and learned from, as often as they come. Without documents to learn from all
counts are zero. Empty input gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import remainder
from .tokens import END, END_WORD, MIX, STEP, cut, lowered, mixed, pairs, word_hashes

#: Bits of the filter an entry, and bits set for each entry.
BITS, PROBES = 12, 3
#: Bits of the largest filter that one process may hold whole (64 MB), and of a shard, about.
MOST_BITS, SHARD_BITS = 1 << 29, 1 << 26
#: Bytes of the texts whose n-grams are a range, about, and bytes for each entry of the filter, about.
RANGE, ENTRY = 1 << 22, 4
#: Bytes of the texts of a part, about.
TOGETHER = 8_000_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
#: Levels tried, and weight of the smoothing.
LEVELS, PRIOR = 40, 8.0
#: What a count of each level is taken to be: the middle of the counts that it stands for.
COUNT = np.array([0.0, 1.0, *(0.75 * 2.0**q - 0.5 for q in range(2, LEVELS + 1))])


def ngrams(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the words and of the pairs of texts, and which words end a text, piece by piece. An end token also comes before each text."""
    before = END
    for piece in cut(b"".join(lowered(t) + b" " + END_WORD + b" " for t in texts), PIECE):
        words = word_hashes(piece)
        if len(words):
            yield mixed(words), pairs(np.concatenate([[before], words[:-1]]), words), words == END
            before = words[-1]


def gathered(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts together; there is one text at least."""
    words, two, last = map(np.concatenate, zip(*ngrams(texts)))
    return words, two, last


def teaches():
    return F.coalesce(remainder(F.col("doc_id"), 10) != 0, F.lit(True))


def ranged(h: np.ndarray, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash, and the 32 bits that tell it apart there."""
    return (h >> np.uint64(64 - range_bits)).astype(np.int64), ((h >> np.uint64(32 - range_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint64)


def packed(numbers: np.ndarray, full: int = 0) -> bytes:
    """Whole numbers by their bytes' places: the lowest bytes, so many as full says, as they are, and those above compressed."""
    wide = max(full, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide])
    return bytes([full, wide]) + len(numbers).to_bytes(4, "little") + planes[:full].tobytes() + (zlib.compress(planes[full:].tobytes(), 1) if wide > full else b"")


def unpacked(data: bytes) -> np.ndarray:
    full, wide, n = data[0], data[1], int.from_bytes(data[2:6], "little")
    at = 6 + full * n
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :wide] = np.frombuffer(data[6:at] + (zlib.decompress(data[at:]) if wide > full else b""), np.uint8).reshape(wide, n).T
    return planes.reshape(-1).view("<u8")


def slim(keys: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, of which the bytes that an even spread fills are not worth compressing."""
    return packed(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), (int(keys[-1]) // len(keys)).bit_length() // 8 if len(keys) else 0)


def unslim(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sum of the counts of each, and the place of each given key among them."""
    kinds, place = np.unique(keys, return_inverse=True)
    # Sums of whole numbers are exact in floats up to 2 ** 53.
    return kinds, np.bincount(place, counts, len(kinds)).astype(np.int64), place


class Sizes:
    """How the n-grams of some texts are cut: ranges of the filter, and ranges of a shard as a power of two (wide)."""

    def __init__(self, documents: DataFrame):
        self.tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held, many = documents.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        size = (held or 0) + many
        self.parts = max(self.tasks, size // TOGETHER)
        self.range_bits = max(6, min(16, math.ceil(math.log2(size / RANGE + 1))))
        bits = BITS * size / ENTRY / (1 << self.range_bits)
        self.wide = max(0, min(math.floor(math.log2(SHARD_BITS / max(bits, 1))), self.range_bits - math.ceil(math.log2(self.tasks))))
        self.shards = 1 << (self.range_bits - self.wide)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """What the filter knows of hashes: range and 32 bits."""
        return h >> np.uint64(32 - self.range_bits)

    def split(self, ascending: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The bounds of the shards among numbers of so many bits, and the numbers of each shard, counted from its first."""
        width = np.uint64(bits - self.range_bits + self.wide)
        bounds = np.searchsorted(ascending, np.arange(1, self.shards, dtype=np.uint64) << width)
        return bounds, [x & ((np.uint64(1) << width) - np.uint64(1)) if self.shards > 1 else x for x in np.split(ascending, bounds)]


def dealt(documents: DataFrame, sizes: Sizes) -> DataFrame:
    """(part, doc_id, text, learned): texts in parts of about TOGETHER bytes, by hash, each in one task."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sizes.parts)).alias("part")
    return documents.select(part, F.col("doc_id").cast("bigint").alias("doc_id"), "text", teaches().alias("learned")).repartition(sizes.tasks, "part")


ASKED = "shard int, part bigint, words binary, times binary, pairs binary, both binary"


def asked(texts: DataFrame, sizes: Sizes) -> DataFrame:
    """Of each part of dealt texts and each shard: the distinct words, whole hashes, and pairs, as the filter knows them, with the part's counts of them in learned texts.

    A part asks every shard, of nothing if need be, to hear its share of the tokens.
    """

    def ask(table):
        import pyarrow as pa

        words, two, last = gathered(table.column("text").to_pylist())
        ends = np.flatnonzero(last)
        learned = np.repeat(table.column("learned").to_numpy(), np.diff(ends, prepend=-1))
        sent = []
        for h, bits in ((words, 64), (sizes.keys(two), 32 + sizes.range_bits)):
            kinds, counts, _ = summed(h, learned)
            bounds, of = sizes.split(kinds, bits)
            sent += [[slim(k) for k in of], [packed(c) for c in np.split(counts, bounds)]]
        part = table.column("part")[0].as_py()
        columns = [pa.array(range(sizes.shards), pa.int32()), pa.array([part] * sizes.shards, pa.int64()), *(pa.array(x, pa.binary()) for x in sent)]
        return pa.Table.from_arrays(columns, ["shard", "part", "words", "times", "pairs", "both"])

    return texts.groupBy("part").applyInArrow(ask, ASKED)


def places(keys: np.ndarray, level, block: int) -> list[np.ndarray]:
    """The bits of keys at a level, within their range's block."""
    h = mixed((keys + np.uint64(1)) * STEP + np.asarray(level, np.uint64) * MIX)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(block)).astype(np.int64) for i in range(PROBES)]


class Block:
    """The filter of one range."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def filled(cls, keys: np.ndarray, counts: np.ndarray) -> Block:
        """The block of keys that have these counts; its size follows from its entries."""
        keys, counts = keys[counts > 0], counts[counts > 0]
        levels = np.minimum(LEVELS, 1 + np.floor(np.log2(counts)).astype(np.int64))
        bits = np.zeros(max(1024, BITS * int(levels.sum())), bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= q], levels[levels >= q]
            for p in places(keys, q, len(bits)):
                bits[p] = True
        return cls(bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The levels of n-grams by repeated probes: level after level, while all bits are set."""
        level, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            for i in range(PROBES) if len(left) else ():
                left = left[self.bits[places(keys[left], q, len(self.bits))[i]]]
            if not len(left):
                break
            level[left] = q
        return level


class Shard:
    """What parts sent to a shard, added up: the words' counts, and the blocks of the filter for its ranges."""

    def __init__(self, table, sizes: Sizes):
        def joined(column: str, read) -> tuple[np.ndarray, np.ndarray]:
            got = [read(x.as_py()) for x in table.column(column)]
            return np.concatenate(got), np.cumsum([len(x) for x in got])[:-1]

        words, self.of_words = joined("words", unslim)
        two, self.of_pairs = joined("pairs", unslim)
        times, both = joined("times", unpacked)[0], joined("both", unpacked)[0]
        _, self.counts, self.word = summed(words, times)
        self.kinds, counts, place = summed(np.concatenate([sizes.keys(words), two]), np.concatenate([times, both]))
        self.word_kind, self.pair_kind = np.split(place, [len(words)])
        cuts = np.searchsorted(self.kinds, np.arange(1, 1 << sizes.wide, dtype=np.uint64) << np.uint64(32))
        self.keys = [k & np.uint64(0xFFFFFFFF) for k in np.split(self.kinds, cuts)]
        self.blocks = [Block.filled(k, c) for k, c in zip(self.keys, np.split(counts, cuts))]


def answered(cells: DataFrame, sizes: Sizes) -> DataFrame:
    """Of each part and each shard: the levels of the words and pairs that the part sent, the words' counts, and the shard's tokens and distinct words."""

    def answer(table):
        import pyarrow as pa

        shard = Shard(table, sizes)
        levels = np.concatenate([b.levels(k) for b, k in zip(shard.blocks, shard.keys)])
        given = (levels[shard.word_kind], shard.of_words), (levels[shard.pair_kind], shard.of_pairs), (shard.counts[shard.word], shard.of_words)
        own, both, counts = ([packed(x) for x in np.split(values, bounds)] for values, bounds in given)
        tokens, kinds = ([int(x)] * table.num_rows for x in (shard.counts.sum(), (shard.counts > 0).sum()))
        columns = [table.column("part"), table.column("shard"), *(pa.array(x, pa.binary()) for x in (own, both, counts)), *(pa.array(x, pa.int64()) for x in (tokens, kinds))]
        return pa.Table.from_arrays(columns, ["part", "shard", "own", "both", "counts", "tokens", "kinds"])

    met = cells.repartition(sizes.tasks, "shard").groupBy("shard")
    return met.applyInArrow(answer, "part bigint, shard int, own binary, both binary, counts binary, tokens bigint, kinds bigint")


class Model:
    """The whole filter in one process, and the sizes that smoothing needs."""

    def __init__(self, blocks: dict[int, Block], range_bits: int, tokens: int, kinds: int):
        self.blocks, self.range_bits, self.tokens, self.kinds = blocks, range_bits, tokens, kinds

    def levels(self, h: np.ndarray) -> np.ndarray:
        where, keys = ranged(h, self.range_bits)
        level = np.zeros(len(h), np.uint8)
        for r in np.unique(where):
            level[where == r] = self.blocks[int(r)].levels(keys[where == r])
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return COUNT[self.levels(h)]


def train(documents: DataFrame, tokens: int, kinds: int) -> Model:
    """The model of the documents' n-grams, if it isn't above MOST_BITS; tokens and kinds are the counts of all and of distinct tokens.

    Scores of a whole table don't need it: score probes the filter where it is.
    """
    sizes = Sizes(documents)

    def blocks(table):
        import pyarrow as pa

        first = table.column("shard")[0].as_py() << sizes.wide
        found = Shard(table, sizes).blocks
        columns = [range(first, first + len(found)), [len(b.bits) for b in found], [np.packbits(b.bits).tobytes() for b in found]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], ["range", "size", "bits"])

    texts = dealt(documents.select("doc_id", "text"), sizes).withColumn("learned", F.lit(True))
    found = materialize(asked(texts, sizes).groupBy("shard").applyInArrow(blocks, "range int, size bigint, bits binary"), "lm-blocks")
    if (found.agg(F.sum("size")).first()[0] or 0) > MOST_BITS:
        raise ValueError(f"the filter has more than {MOST_BITS} bits, too many for one process")
    got = {r.range: Block(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.size).astype(bool)) for r in found.toLocalIterator()}
    empty = Block.filled(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Model({i: got.get(i, empty) for i in range(1 << sizes.range_bits)}, sizes.range_bits, tokens, kinds)


def likelihoods(own: np.ndarray, both: np.ndarray, end: float, starts: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """log10 of each text's probability, end token included, from the counts of its words, of the pairs that they end, and of the end token."""
    context = np.concatenate([[0.0], own[:-1]])
    context[starts] = end
    both = np.minimum(both, np.maximum(own, 1))
    alone = (own + 0.1) / (tokens + 0.1 * (kinds + 1))
    return np.add.reduceat(np.log10((both + PRIOR * alone) / (np.maximum(context, both) + PRIOR)), starts)


def score(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    sizes = Sizes(documents)
    texts = dealt(documents, sizes)
    held = remainder(F.col("doc_id"), 10) == 0

    def run(table, answers):
        import pyarrow as pa

        answers = answers.sort_by("shard")

        def told(column: str) -> np.ndarray:
            return np.concatenate([unpacked(x.as_py()) for x in answers.column(column)])

        n, kinds = (sum(answers.column(c).to_pylist()) for c in ("tokens", "kinds"))
        words, two, last = gathered(table.column("text").to_pylist())
        ends = np.flatnonzero(last)
        starts = np.concatenate([[0], ends[:-1] + 1])
        known, word = np.unique(words, return_inverse=True)
        own, c = COUNT[told("own")], told("counts").astype(np.int64)
        both = COUNT[told("both")][np.unique(sizes.keys(two), return_inverse=True)[1]]
        values = likelihoods(own[word], both, own[np.searchsorted(known, mixed(np.array([END]))[0])], starts, n, kinds)
        base = np.log10((c + 0.1) / (n + 0.1 * (kinds + 1)))
        found = [np.diff(ends, prepend=-1), np.add.reduceat((c > 0)[word].astype(np.int64), starts), np.full(len(ends), n), np.add.reduceat(base[word], starts), values]
        return pa.Table.from_arrays([table.column("doc_id"), *map(pa.array, found)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    answers = answered(asked(texts, sizes), sizes)
    found = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
