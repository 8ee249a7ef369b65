"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

For a text and a BPE model every prefix has one encoding, and hence one last token.  The table is
filled from the left: an automaton reports the pieces that end at a position, and a piece is the
last token of that prefix if it stands next to the last token of the prefix before it, that is if
merging the two in isolation leaves both whole.  Ids are then recovered from the right end.

No piece holds a word-start mark after another character, nor a line feed, so a text falls into
chunks at these places, and chunks that recur are looked up.

Nulls count as empty texts; empty texts encode to the begin and end ids alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import SLICE, rows

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Chunks remembered by a worker in each of two generations. Longer ones aren't kept.
REMEMBER, LONGEST = 300_000, 48
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """The pieces of a BPE model with byte fallback, and the tests of which may stand side by side."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(len(sp))]
        self.size = len(self.piece)
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special and not sp.is_byte(i)}
        self.cost = [-sp.get_score(i) for i in range(self.size)]
        self.length = [len(p) for p in self.piece]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.id) or not {c for p in self.id for c in p} <= self.id.keys():
            raise ValueError("this model's pieces cross word starts or lines, or hold characters that it lacks")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: What an id stands for in bytes; begin, end and unknown stand for nothing.
        byte_of = {i: b for b, i in self.byte.items()}
        self.bytes = [b"" if i in special else bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.is_byte = byte_of.keys()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[int, bool] = {}
        self.led, self.bare = Memory(self, MARK), Memory(self, "")
        self.line = self.chunk("\n")

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i; None for one character; (-1, -1) if no merges lead to it."""
        if i not in self.halves:
            parts, last = list(self.piece[i]), None
            while len(parts) > 1:
                found = [(self.cost[k], at) for at in range(len(parts) - 1) if (k := self.id.get(parts[at] + parts[at + 1])) is not None]
                if not found:
                    last = (-1, -1)
                    break
                at = min(found)[1]
                last = (self.id[parts[at]], self.id[parts[at + 1]])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[i] = last
        return self.halves[i]

    def stand(self, a: int, b: int) -> bool:
        """Whether piece a followed by piece b stays so: walks both back along the seam, latest merge first.

        At each point of time two pieces touch at the seam. They'd merge if that came before either is
        used up by its own side. Of equal costs the left merge comes first.
        """
        if self.split(b) == (-1, -1):
            return False
        until_a = until_b = float("inf")
        piece, find, cost = self.piece, self.id.get, self.cost
        while True:
            both = find(piece[a] + piece[b])
            if both is not None and cost[both] < until_a and cost[both] <= until_b:
                return False
            born_a = cost[a] if self.split(a) else -1.0
            born_b = cost[b] if self.split(b) else -1.0
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                until_a, a = born_a, self.split(a)[1]
            else:
                until_b, b = born_b, self.split(b)[0]

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers."""
        last: list[int | None] = [None] * (len(text) + 1)
        length, beside, size = self.length, self.beside, self.size
        for at, i in self.automaton.iter(text):
            if last[at + 1] is None:
                start = at + 1 - length[i]
                before = last[start]
                if before is None:  # the text's start, or a character that the model lacks
                    ok = self.split(i) != (-1, -1)
                else:
                    ok = beside.get(key := before * size + i)
                    if ok is None:
                        if len(beside) > 2_000_000:
                            beside.clear()
                        ok = beside[key] = self.stand(before, i)
                if ok:
                    last[at + 1] = i
        ids: list[int] = []
        at = len(text)
        while at:
            i = last[at]
            if i is None:
                ids += [self.byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                ids.append(i)
                at -= length[i]
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, without begin and end."""
        if not text:
            return b""
        led, bare, out = self.led, self.bare, []
        if MARK in text:
            return b"".join(map(bare.__getitem__, CHUNK.findall(MARK + text.replace(" ", MARK))))
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.line)
            words = line.split(" ")
            if "  " in line or words[-1] == "" and len(words) > 1 or not n and words[0] == "":
                out += map(bare.__getitem__, CHUNK.findall((MARK if not n else "") + line.replace(" ", MARK)))
                continue
            out.append(bare[words[0]] if n else led[words[0]])
            out += map(led.__getitem__, words[1:])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that aren't UTF-8 each give U+FFFD; the mark before the first word goes."""
        joined = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if self.bytes[i]), None)
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = joined.decode(errors="surrogateescape")
            text = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)
        return text[1:] if first is not None and first not in self.is_byte and text[:1] == " " else text


class Memory(dict):
    """Ids of chunks seen lately: those met since the last full generation, and that generation."""

    def __init__(self, pieces: Pieces, lead: str):
        super().__init__()
        self.pieces, self.lead, self.old = pieces, lead, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text) or self.pieces.chunk(self.lead + text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBER:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One table for each worker process."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encoded(documents: DataFrame, model: str, ids_too: bool = True) -> DataFrame:
    """Per document: all ids counted, the digests of the ids and of the text decoded from them, and the ids."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        p = pieces(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (p.begin, p.end))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + ids_too]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids_too]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for doc, text in rows(batch.slice(at, SLICE), "doc_id", "text"):
                    ids = begin + p.encode(text or "") + end
                    numbers = np.frombuffer(ids, "<u4")
                    decoded = p.decode(numbers.tolist())
                    out.append((doc, len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), numbers.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return documents.select("doc_id", "text").mapInArrow(run, RESULT + ", ids array<int>" * ids_too)
