import hashlib
import os
import tarfile
import zlib

from anamnesis.llm import media
from anamnesis.llm.common import shared_dir
from anamnesis.llm.files import store

SCHEMA = "doc_id bigint, text string, content string"
ROWS = [(1, "abc", "x"), (1, "abc", "y"), (2, None, None), (None, "é" * 64, ""), (3, "", ""), (4, "z" * 300_000, ""), (5, "ab\0", ""), (6, "x" * 64, "")]


def expected():
    out = []
    for doc, text, _ in ROWS:
        b = (text or "").encode()
        p = b + b"\0" * (64 * max(1, -(-len(b) // 64)) - len(b))
        out.append((doc, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = media.round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected()
    assert len({tuple(r)[1:] for r in got if r.doc_id == 1}) == 1


def test_ranges_foreign_archives_and_failing_members(spark):
    path = shared_dir(spark, "media-test")
    media.archive(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    _, inner = store(path)
    shard = next(f for f in os.listdir(inner) if f.endswith(".tar"))
    with tarfile.open(f"{inner}/{shard}") as t:
        assert len(t.getmembers()) == len(ROWS)
    for size in (600, 4096):
        assert media.members(spark, path, size).count() == len(ROWS)
    os.remove(f"{inner}/{shard}.index")
    os.remove(f"{inner}/{media.MANIFEST}")
    found = media.members(spark, path, 1500).collect()
    assert len(found) == len(ROWS) and not any(r.error for r in found)
    with open(f"{inner}/{shard}", "r+b") as f:
        f.truncate(max(r.offset for r in found) + 520)
    found = media.members(spark, path, 1500).collect()
    assert len(found) == len(ROWS) and sum(bool(r.error) for r in found) == 1


def test_empty(spark):
    assert media.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
