"""Helpers shared by the operators: tables, checkpoints, vectorised words.

A *word* is always a maximal run of characters other than space, tab, line
feed, vertical tab, form feed and carriage return.  The vectorised helpers
work on UTF-8 bytes, where these six separators can't be part of a longer
character, so word boundaries found on bytes are those of the text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of long texts takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Row groups are small, so that a writer holds little of them in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(16 << 20)).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_of_id(column: str = "doc_id"):
    """CRC-32 of the id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc32_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


# ---------------------------------------------------------------- vectorised words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit state so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHash:
    """64-bit hashes of words: sums of their bytes times odd numbers that are drawn for each place in a word.

    Of two different words, whatever their lengths, at most one in 2**56 pairs of
    such tables gives the same sum; two tables that are drawn apart give 112 bits.
    """

    def __init__(self, seed: int):
        self.start = np.uint64(seed << 40)
        self._grow(64)

    def _grow(self, n: int) -> None:
        self.factors = mix64(mix64(np.arange(n, dtype=np.uint64) + self.start)) | np.uint64(1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of data[start:end] for each word; no word is empty."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        n = ends - starts
        at = np.cumsum(n) - n
        if n.max() > len(self.factors):
            self._grow(2 * int(n.max()))
        place = np.arange(at[-1] + n[-1]) - np.repeat(at, n)
        terms = self.factors[place] * (data[place + np.repeat(starts, n)] + np.uint64(1))
        return mix64(np.add.reduceat(terms, at) + n.astype(np.uint64))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them), a few megabytes each; null counts as empty.

    A text longer than the limit comes alone and whole.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and offsets of each row's words among them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:n]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def row_of(counts_at: np.ndarray) -> np.ndarray:
    """The row of each item, from the offsets of the rows."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows_of(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of ``k`` words within a row.

    words: the words' hashes; offsets: of each row's words among them.
    """
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : n + j] * _PLACES[j]
    row = row_of(offsets)[:n]
    inside = np.arange(n) + k <= offsets[1:][row]
    return mix64(total[inside] + np.uint64(k)), row[inside]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows_of``; a row with fewer words, but any, has one shingle of them all."""
    found, counts = [windows_of(words, offsets, k)], np.diff(offsets)
    for m in range(1, k):
        if (counts == m).any():
            hashes, row = windows_of(words, offsets, m)
            short = counts[row] == m
            found.append((hashes[short], row[short]))
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])
