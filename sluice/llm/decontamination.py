"""Benchmark decontamination by size-partitioned MinHash containment search.

The items of a benchmark are the queries, the documents the domains.  Items
are partitioned by their number of distinct five-word shingles, in classes up
to a power of two.  For containment t and a class bound u, an item keeps its
floor((1 - t) * u) + 1 shingles of least hash: a document that has a share t
of an item's shingles lacks fewer than the sketch has, so it holds at least
one sketched shingle.  The search therefore misses nothing, however long the
document is, where a MinHash of the document itself would be hopeless: its
resemblance to a short item is close to zero.  A candidate is verified by
exact containment of the item's shingles, compared as text.

Words are lower-cased (A-Z) and freed of ASCII punctuation.  An item of fewer
than five words has one shingle, of all of them, and is looked for among the
shingles of that many words of every document.  A text without words, or null,
has none and never matches.  Repeated documents or items each give rows of
their own, rows without an id as well.  A very long text is read whole; it alone
fills a chunk.  Empty tables give no rows.  Other columns are ignored.

Items are broadcast in blocks of at most ``block_bytes`` of text (or one item),
one after the other, so a benchmark of any size is searched, with one pass over
the documents for each block; the driver holds one block at a time.  Documents
are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

K = 5
FOUND = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_DROPPED = np.zeros(256, bool)
_DROPPED[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_HASH = common.WordHash(6)


def words_of(text: str | None) -> list[str]:
    return _SPLIT.findall(_PUNCTUATION.sub("", (text or "").translate(_LOWER)))


def shingles(text: str | None, k: int = K) -> set[str]:
    """An item's shingles: of ``k`` words, or one of all words if they are fewer."""
    words = words_of(text)
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingles_within(words: list[str], k: int) -> set[str]:
    """All shingles of ``k`` words of a document."""
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised words' hashes, and the offsets of the rows among them."""
    data = common.lower_ascii(data)
    keep = ~_DROPPED[data]
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    data, offsets = data[keep], moved[offsets]
    starts, ends, at = common.words_in(data, offsets)
    return _HASH.words(data, starts, ends), at


class Sketches:
    """A block of items, by the shingles that a document must have at least one of."""

    def __init__(self, items: list[tuple[int, str | None]], containment: float, k: int):
        self.items = [(i, s, min(k, len(words_of(t)))) for i, t in items if (s := shingles(t, k))]
        by: dict[int, set[int]] = defaultdict(set)
        for n, (_, own, size) in enumerate(self.items):
            bound = 1 << (len(own) - 1).bit_length()
            for h in sorted(set(self.hash_of(own, size).tolist()))[: int((1 - containment) * bound + 1e-9) + 1]:
                by[h].add(n)
        self.sizes = sorted({size for _, _, size in self.items})
        self.keys = np.array(sorted(by), np.uint64)
        self.holders = [sorted(by[h]) for h in self.keys.tolist()]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def hash_of(self, own: set[str], size: int) -> np.ndarray:
        data = [s.encode() for s in sorted(own)]
        return common.windows_of(*hashed_words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])), size)[0]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """By row: the items of which it holds a sketched shingle."""
        found: dict[int, set[int]] = defaultdict(set)
        words, at = hashed_words(data, offsets)
        for size in self.sizes:
            h, row = common.windows_of(words, at, size)
            maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
            h, row = h[maybe], row[maybe]
            place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[place] == h
            for r, a in {*zip(row[hit].tolist(), place[hit].tolist(), strict=True)}:
                found[r].update(self.holders[a])
        return found

    def verified(self, text: str | None, numbers: set[int], containment: float) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, those that the text has) of the items that the text holds enough of."""
        words = words_of(text)
        own = {size: shingles_within(words, size) for size in {self.items[n][2] for n in numbers}}
        for n in sorted(numbers):
            item, wanted, size = self.items[n]
            shared = len(wanted & own[size])
            if shared >= containment * len(wanted) - 1e-9:
                yield item, len(wanted), shared


def contaminated(docs: DataFrame, items: DataFrame, *, containment: float = 0.8, k: int = K, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``FOUND``: each document with each item of which it holds a share of at least ``containment``.

    items: item_id, text.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = -(-total // block_bytes)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())

    def search(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])  # about block_bytes
        made: list[Sketches] = []

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Sketches(shared.value, containment, k))
            sketches = made[0]
            for batch in batches:
                rows = []
                ids, column = batch.column(0), batch.column(1)
                for first, data, offsets in common.text_chunks(column):
                    for row, numbers in sorted(sketches.candidates(data, offsets).items()):
                        for item, n, n_shared in sketches.verified(column[first + row].as_py(), numbers, containment):
                            rows.append((ids[first + row].as_py(), item, n, n_shared, n_shared / n))
                if rows:
                    kinds = (pa.int64(),) * 4 + (pa.float64(),)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        return texts.mapInArrow(found, FOUND)

    if not n_blocks:
        return spark.createDataFrame([], FOUND)
    if n_blocks == 1:
        return search(items)
    return reduce(DataFrame.unionByName, (common.staged(search(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)), "found") for b in range(n_blocks)))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold none of the items; those without an id are kept."""
    bad = contaminated(docs, items, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), bs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / n_shingles AS containment
FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
