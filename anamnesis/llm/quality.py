"""Text quality by supervised subword embeddings.

A document is the mean of the vectors of its hashed features: words, pairs of neighbouring words,
and character n-grams with the white space around words. Softmax over that mean gives its class.
Vectors and weights are learned by stochastic gradient descent in numpy, on the driver, from a
bounded sample of labelled documents. As the output is linear in the mean, a feature's vector times
the output weights is one number; scoring looks these up and averages them, which is the same.

Nulls: a null text is empty. A text without features scores as the sample's share of the class. A null doc_id
is in no fold and is scored. Rows without a label, or labelled null, teach nothing. Of rows that repeat
an id one teaches, and all are scored.
Without any labelled rows every text scores one half. Empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, rows, whole
from .tokens import mixed, pairs, word_hashes

#: Bits of the feature hash; vector length; labelled documents of a class that may be learned from, and their
#: characters in all, besides those of the last of them.
BUCKET_BITS, DIMENSIONS, SAMPLE, CHARS = 18, 8, 1500, 64_000_000
#: Character n-grams.
GRAMS = (3, 4)
EPOCHS, RATE, BATCH = 12, 0.5, 16
#: Code points taken at a time; cut at white space, so that no word is split.
PIECE = 1 << 20
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of all features of a text."""
    return np.concatenate([_features(part, bits) for part in parts(text)] or [np.zeros(0, np.int64)])


def parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def _features(text: str, bits: int) -> np.ndarray:
    shift = np.uint64(64 - bits)
    words = word_hashes(text.encode("utf-8", "replace"))
    found = [mixed(words), pairs(words[:-1], words[1:])]
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for n in GRAMS:
        if len(c) >= n:
            h = sum(((c[k : len(c) - n + 1 + k] + np.uint64(n)) * ODD[k] for k in range(n)), np.zeros(len(c) - n + 1, np.uint64))
            found.append((h ^ (h >> np.uint64(31))) * ODD[n % 4])
    return (np.concatenate(found) >> shift).astype(np.int64)


def packed(buckets: np.ndarray) -> tuple[bytes, bytes, str]:
    """The distinct buckets, as steps, and how often each occurs, in the narrowest type that holds it; both compressed."""
    found, counts = np.unique(buckets, return_counts=True)
    counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return zlib.compress(np.diff(found, prepend=0).astype("<i4").tobytes(), 1), zlib.compress(counts.tobytes(), 1), counts.dtype.str


def unpacked(buckets: bytes, counts: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of what packed gives."""
    return np.cumsum(np.frombuffer(zlib.decompress(buckets), "<i4"), dtype=np.int32), np.frombuffer(zlib.decompress(counts), kind)


def learn(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dimensions: int, epochs: int, rate: float, seed: int = 1) -> tuple[np.ndarray, float]:
    """A number a bucket and a constant: what class 1 gains on class 0. texts: the buckets of each, and how often each occurs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    out, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            now = rate * (1 - done / steps)
            done += 1
            shares = [(texts[i][1] / texts[i][1].sum()).astype(np.float32) for i in pick]
            hidden = np.stack([share @ vectors[texts[i][0]] for i, share in zip(pick, shares)])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            back = p @ out.T
            out -= now * hidden.T @ p
            bias -= now * p.mean(axis=0)
            for i, share, g in zip(pick, shares, back):
                # A text's buckets are distinct, so plain indexing adds each once.
                vectors[texts[i][0]] -= (now * share * len(share) ** 0.5)[:, None] * g
    gain = out[:, 1] - out[:, 0]
    return vectors @ gain, float(bias[1] - bias[0])


def usable(labels: DataFrame, label: str, teach) -> DataFrame:
    """(doc_id, label) of the labelled rows that may be learned from; an id labelled twice counts with its least label."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & teach(F.col("doc_id")))
    return ids.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias(label))


def sample(documents: DataFrame, labels: DataFrame, label: str, teach, each: int, chars: int = CHARS) -> DataFrame:
    """(text, label): at most each documents of either label, the first by a hash of their id, until they have so many characters.

    Of rows that repeat an id that one teaches whose text has the least hash.
    """
    known = usable(labels, label, teach)
    order = F.xxhash64(F.lit(11), "doc_id")
    first = [known.where(F.col(label) == c).orderBy(order, "doc_id").limit(each) for c in (0, 1)]
    ids = first[0].unionByName(first[1])
    # At most 2 * each ids of 12 bytes.
    mine = documents.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    mine = materialize(mine.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text")), "quality-sample")
    before = F.coalesce(F.sum("n").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row of two numbers a document of the sample.
    kept = mine.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("before", before).where(F.col("before") < chars)
    return mine.join(F.broadcast(kept.select("doc_id")), "doc_id").select("text", label)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", teach=lambda doc_id: F.lit(True), each: int = SAMPLE, bits: int = BUCKET_BITS) -> tuple[np.ndarray, float]:
    """The model: a number a bucket and a constant. Executors hash the sample; the driver gets its bucket counts."""

    def hashed(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [packed(features(text or "", bits)) for (text,) in rows(batch, "text")]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *columns], ["label", "buckets", "counts", "kind"])

    # About 3 bytes a distinct bucket of a text.
    chosen = sample(documents, labels, label, teach, each).mapInArrow(hashed, "label int, buckets binary, counts binary, kind string").collect()
    chosen.sort(key=lambda r: (r.label, len(r.buckets), r.buckets, r.counts))
    texts = [(r.label, *unpacked(r.buckets, r.counts, r.kind)) for r in chosen]
    known = np.array([c for c, b, _ in texts if len(b)], np.int64)
    texts = [(b, n) for _, b, n in texts if len(b)]
    if not texts:
        return np.zeros(1 << bits, np.float32), 0.0
    gains, constant = learn(texts, known, 1 << bits, DIMENSIONS, EPOCHS, RATE)
    # The sample has the classes in other shares than the labels have.
    share = dict(usable(labels, label, teach).groupBy(label).count().collect())
    if len(share) == 2 and 0 < known.sum() < len(known):
        constant += float(np.log(share[1] / share[0]) - np.log(known.sum() / (len(known) - known.sum())))
    return gains, constant


def scored(documents: DataFrame, model: tuple[np.ndarray, float], keep: bool = False, name: str = "score") -> DataFrame:
    """doc_id and score, the probability of label 1; all columns and the score if keep. name: the score's column."""
    spark = documents.sparkSession
    gains, constant = model
    bits = int(np.log2(len(gains)))
    # 4 bytes a bucket.
    shared = spark.sparkContext.broadcast(gains.astype(np.float32))

    def run(batches) -> Iterator:
        import pyarrow as pa

        gain = shared.value
        for batch in batches:
            out = []
            for (text,) in rows(batch, "text"):
                total, n = 0.0, 0
                for part in parts(text or ""):
                    f = _features(part, bits)
                    total, n = total + float(gain[f].sum(dtype=np.float64)), n + len(f)
                out.append(1 / (1 + np.exp(-np.clip(constant + (total / n if n else 0.0), -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(own)), pa.array(out, pa.float64())], [own, name])

    # All columns are one, whose names may be any.
    own = "d" if keep else "doc_id"
    kept = documents.select(*(["text"] if keep else ["doc_id", "text"]), *([whole(documents).alias("d")] if keep else []))
    found = kept.mapInArrow(run, StructType([kept.schema[own], StructField(name, DoubleType())]))
    return found.select("d.*", name) if keep else found


def remainder(doc_id, modulus: int):
    """crc32 of an id's decimal text, modulo modulus."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; learned from rows whose remainder by 4 isn't 2."""
    model = train(documents, labels, teach=lambda d: remainder(d, 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
