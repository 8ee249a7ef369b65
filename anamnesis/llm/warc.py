"""WARC archives written by Spark and read back in byte ranges, by boundary-chain verification.

Every place in a file that looks like a record's start is a candidate; its header says where the
next record would start.  Only what can be reached from the file's start is a record: a payload may
hold the magic, whole records even, but nothing points into it.  A task follows the chain inside
its byte range and emits where it leaves; pointer jumping over these exits finds, in rounds that
double their reach, where the true chain enters each range; a second pass reads from there.

Of pages with equal payloads of at least LEAST bytes the one with the greatest page_id is kept as
a response, the others as revisits of it.  Repeated rows with that page_id are all responses.

Nulls: a null html is an empty payload, a null url an empty address; a null page_id is kept as
none, and is a response only where no other page has its payload. Empty input gives no rows. A
record that a file's end cuts off is not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir
from .files import opened

MAGIC, BREAK = b"WARC/1.0\r\n", b"\r\n\r\n"
LEAST = 1000
#: Bytes of a task's range, and those first read for a header; a longer header is read on to its end.
RANGE, HEADER = 8 << 20, 64 << 10
#: Most tasks over which ranges are spread; with more ranges a task reads several, one after the other.
TASKS = 50_000
#: Revisits, at 60 bytes each, that are joined by broadcast; more are joined by a shuffle.
BROADCAST = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, at bigint, record_type string, record_id string, refers_to string, uri string, digest string, full_bytes bigint, payload binary"


def duplicates(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits."""
    kinds = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least).select("page_id", "digest")
    kinds = materialize(kinds, "warc-digests")
    shared = materialize(kinds.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "warc-shared")
    return kinds.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a record a page below path; the files are Spark's own, committed once each."""
    html = F.coalesce("html", F.lit(""))
    repeats = materialize(duplicates(pages, least).withColumnsRenamed({"page_id": "_page", "digest": "_digest"}), "warc-revisits")
    small = repeats.limit(BROADCAST + 1).count() <= BROADCAST
    df = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s+", " ").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    df = df.join(F.broadcast(repeats) if small else repeats, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"))
    df.withColumn("block", block).select(record.alias("record")).write.option("lineSep", "\r\n\r\n").text(path)


def reach(f, data: bytes, at: int) -> tuple[bytes, int]:
    """data, read on from f in growing steps until a header's end follows a place of it, and that end; -1 if the file has none."""
    step = HEADER
    while (end := data.find(BREAK, at)) < 0 and (more := f.read(step)):
        at = max(at, len(data) - len(BREAK) + 1)
        data += more
        step *= 2
    return data, end


def header(data: bytes, at: int, end: int) -> tuple[dict[str, str], int] | None:
    """The fields of the header between two places of data, in lower case, and where its block starts there; None if it's none."""
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    fields, at = {}, at + len(MAGIC)
    while at <= end:
        stop = data.find(b"\r\n", at, end)
        stop = end if stop < 0 else stop
        key, colon, value = data[at:stop].partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = stop + len(b"\r\n")
    return (fields, end + len(BREAK)) if fields.get("content-length", "").isdecimal() else None


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, start, end, length): the byte ranges of the files below path, from their listing."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    return files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start")).withColumn("end", F.least(F.col("start") + size, "length"))


def spread(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(max(1, min(n, TASKS)))


def candidates(batches) -> Iterator:
    """(path, at, leaves): what looks like a record's start, and where the chain from there leaves the range."""
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            with opened(r["path"]) as f:
                f.seek(r["start"])
                data = f.read(r["end"] - r["start"] + HEADER)
                follow, at = {}, data.find(MAGIC)
                data, end = reach(f, data, at) if at >= 0 else (data, -1)
                while 0 <= at < r["end"] - r["start"]:
                    # All places before a header's end have the same.
                    if 0 <= end < at:
                        data, end = reach(f, data, at)
                    if found := header(data, at, end):
                        follow[at] = found[1] + int(found[0]["content-length"]) + len(BREAK)
                    at = data.find(MAGIC, at + 1)
            leaves: dict[int, int] = {}
            for at in sorted(follow, reverse=True):
                leaves[at] = leaves.get(follow[at], follow[at])
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(leaves), pa.string()), pa.array([r["start"] + x for x in leaves], pa.int64()), pa.array([r["start"] + x for x in leaves.values()], pa.int64())], ["path", "at", "leaves"])


def entries(found: DataFrame) -> DataFrame:
    """(path, at): where the chain from each file's start enters a range, by pointer jumping over (path, at, leaves)."""
    jump = found.select("path", "at", F.col("leaves").alias("to"))
    reached = found.where("at = 0").select("path", "at")
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        # A place that no candidate starts at ends the chain.
        ahead = ahead.join(found.select("path", "at"), ["path", "at"], "left_semi")
        reached = materialize(reached.unionByName(ahead).distinct(), "warc-reached")
        if (now := reached.count()) == n:
            return reached
        n = now
        twice = jump.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = materialize(jump.join(twice, ["path", "to"]).select("path", "at", F.col("beyond").alias("to")), "warc-jumps")


def records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Every record below path: its file and offset, header fields, and payload (without the HTTP header of its block)."""
    split = ranges(spark, path, size)
    n = split.count()
    found = materialize(spread(split, n).mapInArrow(candidates, "path string, at bigint, leaves bigint"), "warc-candidates")
    starts = split.join(entries(found), "path").where("at >= start and at < end").select("path", "at", "end", "length")

    def read(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    at, out, held = r["at"], [], 0
                    while at < r["end"]:
                        f.seek(at)
                        data, end = reach(f, f.read(HEADER), 0)
                        head = header(data, 0, end)
                        n = int(head[0]["content-length"])
                        if at + head[1] + n > r["length"]:
                            break
                        f.seek(at + head[1])
                        http, _, payload = f.read(n).partition(BREAK)
                        full = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        h = head[0]
                        out.append((r["path"], at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), full, payload))
                        held += n
                        at += head[1] + n + len(BREAK)
                        if held > 4 << 20 or at >= r["end"]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], RECORD.replace(",", "").split()[::2])
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], RECORD.replace(",", "").split()[::2])

    return spread(starts, n).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages to the shared folder, reads the archives back, and returns a row a record, by page.

    Fails unless as many records are read as pages were written.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path, least)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    r = records(spark, path)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    digest = F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(F.sha1("payload"))
    size = F.when(F.col("record_type") == "revisit", F.col("full_bytes")).otherwise(F.octet_length("payload")).cast("bigint")
    out = r.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    out = materialize(out, "warc-records")
    if (read := out.count()) != (wrote := pages.count()):
        raise ValueError(f"{read} records were read of {wrote} pages")
    return out
