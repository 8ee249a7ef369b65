"""Media columns: lossless 8-bit images of byte payloads in tar archives, written and read by a Spark data source.

Writing, each task fills shards of its own, under names that no other attempt uses, with an index
of member offsets beside each; the commit lists the shards of the attempts that count.  Reading,
the plan cuts the listed shards into byte ranges; a task reads the members that start in its range,
each by its offset, and tries a member that fails again by itself.  A member that keeps failing is
a row with its error and no content; the others aren't lost.

Nulls: a null text is an empty payload, padded to 64 zero bytes; a null doc_id is kept as none.
Repeated rows are repeated members. Empty input gives an archive without shards, and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import SLICE, rows, shared_dir
from .files import store

#: Samples of a row; payloads are padded to a multiple of it.
WIDTH = 64
BLOCK = 512
#: Bytes of a shard, of a range, and of a batch, about; tries of a member.
SHARD, RANGE, BATCH, TRIES = 256 << 20, 16 << 20, 2 << 20, 3
#: Ranges of an archive, about, beyond which they grow instead: members are read one by one, whatever the range.
RANGES = 50_000
MANIFEST, SIGNATURE = "_shards.jsonl", b"\x89PNG\r\n\x1a\n"
MEMBER = "shard string, offset bigint, name string, content binary, error string"
RESULT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def image(payload: bytes, size: int) -> bytes:
    """A PNG of 8-bit grey samples, a row of WIDTH each, that keeps size (the bytes before padding) as text."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.pad(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH), ((0, 0), (1, 0)))
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"Size\0%d" % size) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def samples(png: bytes) -> tuple[bytes, int]:
    """The payload and the size kept with it; ValueError if the image is damaged."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, size, shape = len(SIGNATURE), b"", 0, (0, 0)
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != png[at + 8 + n : at + 12 + n]:
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"Size\0"):
            size = int(body[5:])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """Mean, standard deviation, entropy in bits and mean step of the samples, and their shares in 16 equal bins."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return ",".join(f"{v:.4f}" for v in (x.mean(), x.std(), entropy, step, *share.reshape(16, 16).sum(axis=1)))


@dataclass
class Wrote(WriterCommitMessage):
    shards: list


@dataclass
class Range(InputPartition):
    shard: str
    start: int
    end: int


class MediaTar(DataSource):
    """Tar archives below the path of option path, as rows (shard, offset, name, content, error); writes (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "media_tar"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        shards, out, at, offsets = [], None, 0, []

        def close():
            out.write(b"\0" * 2 * BLOCK)
            out.close()
            with system.open_output_stream(f"{path}/{shards[-1]['name']}.index") as index:
                index.write(np.array(offsets, "<i8").tobytes())
            shards[-1] |= {"bytes": at, "members": len(offsets)}

        for batch in iterator:
            for name, content in rows(batch, "name", "content"):
                if out is None or at >= SHARD:
                    if out is not None:
                        close()
                    shards.append({"name": f"shard-{uuid.uuid4().hex}.tar"})
                    out, at, offsets = system.open_output_stream(f"{path}/{shards[-1]['name']}"), 0, []
                info = tarfile.TarInfo(name)
                info.size = len(content)
                offsets.append(at)
                out.write(info.tobuf(tarfile.GNU_FORMAT))
                out.write(content + b"\0" * (-len(content) % BLOCK))
                at += BLOCK + len(content) + -len(content) % BLOCK
        if out is not None:
            close()
        return Wrote(shards)

    def commit(self, messages) -> None:
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write("".join(json.dumps(s) + "\n" for m in messages if m for s in m.shards).encode())

    def abort(self, messages) -> None:
        system, path = store(self.path)
        for s in (s for m in messages if m for s in m.shards):
            for name in (s["name"], s["name"] + ".index"):
                if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                    system.delete_file(f"{path}/{name}")


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range, self.tries = options["path"], int(options.get("range", RANGE)), int(options.get("tries", TRIES))

    def partitions(self) -> list[Range]:
        """Byte ranges of the committed shards; where there's no list, of all tar files."""
        system, path = store(self.path)
        if system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{MANIFEST}") as f:
                shards = [(s["name"], s["bytes"]) for s in map(json.loads, f.read().decode().splitlines())]
        else:
            found = system.get_file_info(fs.FileSelector(path))
            shards = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".tar"))
        step = max(self.range, -(-sum(size for _, size in shards) // RANGES))
        return [Range(name, at, at + step) for name, size in shards for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.shard:
            return
        system, path = store(self.path)
        shard, out, held = f"{path}/{partition.shard}", [], 0
        for offset in offsets(system, shard, partition.start, partition.end):
            out.append((partition.shard, offset, *self.member(system, shard, offset)))
            held += len(out[-1][3] or b"")
            if held >= BATCH:
                yield self.batch(out)
                out, held = [], 0
        if out:
            yield self.batch(out)

    def member(self, system, shard: str, offset: int) -> tuple:
        """(name, content, error) of the member at an offset; opens the shard anew for every try."""
        said = ""
        for _ in range(self.tries):
            try:
                with system.open_input_file(shard) as f:
                    f.seek(offset)
                    info = tarfile.TarInfo.frombuf(f.read(BLOCK), "utf-8", "surrogateescape")
                    content = f.read(info.size)
                if len(content) == info.size:
                    return info.name, content, None
                said = f"{len(content)} of {info.size} bytes"
            except (OSError, tarfile.TarError) as e:
                said = f"{type(e).__name__}: {e}"
        return None, None, said

    def batch(self, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()))], ["shard", "offset", "name", "content", "error"])


def offsets(system, shard: str, start: int, end: int) -> list[int]:
    """Where members start in a range of a shard: from its index, or from header to header where it has none."""
    if system.get_file_info(f"{shard}.index").type == fs.FileType.File:
        with system.open_input_stream(f"{shard}.index") as f:
            found = np.frombuffer(f.read(), "<i8")
        return found[(found >= start) & (found < end)].tolist()
    found, at = [], 0
    with system.open_input_file(shard) as f:
        while at < end:
            f.seek(at)
            head = f.read(BLOCK)
            if len(head) < BLOCK or not head.strip(b"\0"):
                break
            if at >= start:
                found.append(at)
            size = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape").size
            at += BLOCK + size + -size % BLOCK
    return found


def archive(documents: DataFrame, path: str) -> None:
    """Writes an image a document below path, named by doc_id."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for doc, text in rows(batch.slice(at, SLICE), "doc_id", "text"):
                    data = (text or "").encode()
                    out.append((f"{'none' if doc is None else doc}.png", image(padded(data), len(data))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary()))], ["name", "content"])

    spark = documents.sparkSession
    spark.dataSource.register(MediaTar)
    documents.select("doc_id", "text").mapInArrow(run, "name string, content binary").write.format("media_tar").mode("append").save(path)


def members(spark, path: str, size: int = RANGE, tries: int = TRIES) -> DataFrame:
    """The members of the archives below path: (shard, offset, name, content, error)."""
    spark.dataSource.register(MediaTar)
    return spark.read.format("media_tar").option("range", str(size)).option("tries", str(tries)).load(path)


def described(found: DataFrame) -> DataFrame:
    """Per member: doc_id, sizes and digests of the payload and of the stored image, and its feature; a failed member fails the job."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content, error in rows(batch, "name", "content", "error"):
                if error:
                    raise OSError(error)
                payload, size = samples(content)
                doc = name.removesuffix(".png")
                out.append((None if doc == "none" else int(doc), size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(content), hashlib.sha256(content).hexdigest(), feature(payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], [c.split()[0] for c in RESULT.split(", ")])

    return found.mapInArrow(run, RESULT)


def round_trip(documents: DataFrame) -> DataFrame:
    """Stores the documents in the shared folder as images, and describes what is read back."""
    path = shared_dir(documents.sparkSession, "media")
    archive(documents, path)
    return described(members(documents.sparkSession, path))
