"""Packing of token streams into sequences of a fixed length.

Bounded-space online packing.  Every partition keeps at most ``open_windows``
windows.  A document longer than a window first fills windows of its own; what
is left of it goes to the open window in which it leaves the least room.  When
it fits in none and no further window may be opened, the fullest is emitted;
it first takes the head of the piece, if its room is worth a cut.  At its end
a partition hands over its open windows; those of ``merge`` partitions meet in
one task, which joins them end to end into full sequences and divides what is
left over into sequences of a power of two, which need no padding.  A merging
task thus gets ``merge * open_windows`` windows at most, however large the
input is.

The pieces are written to the shared folder between the two steps, so that no
text is tokenised twice, and no partition depends on another's state.

A null text counts as empty; a document without text has its end id only and
still gets a piece.  Equal documents, and equal ids, each get pieces of their
own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary()), ("part", pa.int64()), ("open", pa.bool_())]
)


class Tokenizer:
    """Ids of a byte-level BPE given as a tokenizers file.

    The vocabulary's ids are the ranks of its merges, so the faster encoder of
    tiktoken gives the same ids; texts with a special token's string, and other
    kinds of vocabulary, are left to the tokenizers library.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.space_first = np.zeros(self.size, bool)
        self.space_first[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level vocabularies write a space
        pre = spec.get("pre_tokenizer") or {}
        self.fast = None
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            # printable bytes stand for themselves, the others for the code points from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
            self.fast = tiktoken.Encoding("byte_level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def library(self):
        """The tokenizers library's own, which few texts need."""
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.ids(text), np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Window:
    """Pieces (doc_id, start, doc_tokens, ids) that will be one sequence."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[tuple[int, int, int, np.ndarray]] = []
        self.used = 0

    def add(self, doc: int, start: int, total: int, ids: np.ndarray) -> None:
        self.pieces.append((doc, start, total, ids))
        self.used += len(ids)


class Packer:
    """Online best fit over a bounded number of open windows; finished ones are given out."""

    def __init__(self, size: int, open_windows: int, least_cut: int):
        self.size, self.most, self.least_cut = size, open_windows, least_cut
        self.open: list[Window] = []

    def add(self, doc: int, ids: np.ndarray) -> Iterator[Window]:
        total, start = len(ids), 0
        while total - start >= self.size:
            w = Window()
            w.add(doc, start, total, ids[start : start + self.size])
            start += self.size
            yield w
        while start < total:
            left = total - start
            best = min((w for w in self.open if w.used + left <= self.size), key=lambda w: self.size - w.used, default=None)
            if best is None and len(self.open) < self.most:
                self.open.append(best := Window())
            if best is not None:
                best.add(doc, start, total, ids[start:])
                start = total
                if best.used == self.size:
                    self.open.remove(best)
                    yield best
                return
            fullest = max(self.open, key=lambda w: w.used)
            room = self.size - fullest.used
            if room >= self.least_cut and left - room >= self.least_cut:
                fullest.add(doc, start, total, ids[start : start + room])
                start += room
            self.open.remove(fullest)
            yield fullest


def joined(windows: list[Window], size: int) -> Iterator[Window]:
    """The windows' pieces end to end: sequences of the full size, then of powers of two."""
    left = sum(w.used for w in windows)
    lengths = [size] * (left // size) + [1 << b for b in reversed(range(size.bit_length())) if (left % size) >> b & 1]
    pieces = [p for w in windows for p in w.pieces][::-1]
    for n in lengths:
        w = Window()
        while w.used < n:
            doc, start, total, ids = pieces.pop()
            take = min(len(ids), n - w.used)
            w.add(doc, start, total, ids[:take])
            if take < len(ids):
                pieces.append((doc, start + take, total, ids[take:]))
        yield w


class _Rows:
    """Collects pieces for Arrow batches of bounded size."""

    def __init__(self, base: int, part: int):
        self.next, self.part = base, part
        self.columns: list[list] = [[] for _ in range(7)]
        self.flags: list[bool] = []
        self.ids = 0

    def add(self, w: Window, is_open: bool) -> None:
        offset = 0
        for doc, start, total, ids in w.pieces:
            for c, v in zip(self.columns, (doc, start, len(ids), total, self.next, offset, ids.tobytes()), strict=True):
                c.append(v)
            offset += len(ids)
        self.flags.extend([is_open] * len(w.pieces))
        self.ids += offset
        self.next += 1

    def take(self) -> pa.RecordBatch:
        n = len(self.flags)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, _ARROW, strict=False)] + [pa.array([self.part] * n, pa.int64()), pa.array(self.flags, pa.bool_())],
            schema=_ARROW,
        )
        self.columns, self.flags, self.ids = [[] for _ in range(7)], [], 0
        return batch


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    size: int = 2048,
    end_id: int = 1,
    open_windows: int = 32,
    least_cut: int = 32,
    merge: int = 16,
) -> DataFrame:
    """The pieces of all documents (columns of ``PIECE``; ids: little-endian unsigned 32-bit).

    Each id of a document, and one ``end_id`` after them, lies in exactly one
    piece; the pieces of a sequence follow each other from offset 0 on.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = tokenizer(tokenizer_path)
        packer, rows = Packer(size, open_windows, least_cut), _Rows(part << 32, part)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode.array(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for w in packer.add(doc, ids):
                    rows.add(w, False)
                if rows.ids > 1 << 19:
                    yield rows.take()
        for w in packer.open:
            rows.add(w, True)
        yield rows.take()

    pieces = common.staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(part_of, PIECE + ", part long, open boolean"), "pieces")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows((1 << 62) + (TaskContext.get().partitionId() << 32), 0)
        batches = list(batches)  # bounded: merge * open_windows windows for each group
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        for group in pc.unique(pc.divide(got["part"], merge)).to_pylist():
            own = got.filter(pc.equal(pc.divide(got["part"], merge), group)).sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            w = Window()
            for r in own.to_pylist():
                w.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
            for done in joined([w], size):
                rows.add(done, False)
        yield rows.take()

    left = pieces.where("open").repartition(F.floor(F.col("part") / merge)).mapInArrow(merged, PIECE + ", part long, open boolean")
    return pieces.where("not open").unionByName(left).drop("part", "open")
