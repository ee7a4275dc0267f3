"""Exact removal of long passages that repeat across documents, by recompression.

Rounds of recompression turn the words of a document into ever longer symbols:
a round joins either runs of one symbol or pairs of a left and a right symbol,
where a symbol's side in a round is a bit of its name.  A joint symbol's name is
computed from its parts' names, so equal stretches get equal names everywhere
without a dictionary to agree on; only what lies beside a stretch can change
how its first and last symbols are joined.  Every symbol therefore carries its
*reach*: the words that its being formed depends on.  Wherever those words
recur, so does the symbol.

1. Spark gathers the symbols by name; those of a single document are not shared.
2. A window of ``length`` words is a candidate if each symbol whose reach lies
   within it is shared.  A window that repeats anywhere always is one, as its
   symbols repeat with it; a window without such symbols is one, too (text so
   regular that nothing is decided within it).
3. Candidates are verified: they are grouped by two hashes of 64 bits of their
   words, to find the smallest document id of each.  Either is a sum of the
   words' hashes times odd numbers drawn for each place in a window, and a
   word's hash one of its bytes likewise, from other numbers for either.  So no
   regularity in a text makes different windows collide: a given pair does for
   one in 2**100 draws.
4. Words covered by a window that also starts in a smaller document are removed.

The documents' texts cross the network once, compressed (both joins use one
exchange).  Groups of copies of any size pass through sums with a partial stage
and joins only.  Null texts and texts of fewer than ``length`` words lose
nothing.  Repeated rows of one id are no smaller document to each other, and
each of them loses what its own text repeats.  A row without an id is no
document to others and loses nothing.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common

ROUNDS = ("run", "pair", "pair", "run", "pair", "pair", "pair", "pair", "pair")
LONGEST = 16
_WORDS = (common.WordHash(81), common.WordHash(82))
_PLACES = np.arange(1, 3, dtype=np.uint64)[:, None] << np.uint64(32)
_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95))
_SIDES = common.mix64(np.arange(1, len(ROUNDS) + 1, dtype=np.uint64))


def recompress(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, last) of the final symbols; their reach is words[first:last].

    words: the words' hashes; at: offsets of each row's words.  A reach past
    the row's ends means that the symbol depends on the row ending there; such
    symbols are left out.
    """
    n = len(words)
    name, start, end = words, np.arange(n), np.arange(1, n + 1)
    first, last = start, end  # reach
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[at] = closes[at] = True
    outside = n + 1
    for round_no, kind in enumerate(ROUNDS):
        m = len(name)
        if m < 2:
            break
        no_left, no_right = opens[start], closes[end]
        left_first = np.where(no_left, -outside, np.r_[-outside, first[:-1]])
        right_last = np.where(no_right, 2 * outside, np.r_[last[1:], 2 * outside])
        if kind == "run":
            same = np.zeros(m, bool)
            same[1:] = (name[1:] == name[:-1]) & ~no_left[1:]
            index = np.arange(m)
            run_at = np.maximum.accumulate(np.where(same, 0, index))
            size = end - start
            most = np.maximum(LONGEST // size, 1)
            head = (index - run_at) % most == 0
            heads = np.flatnonzero(head)
            tails = np.r_[heads[1:], m] - 1
            count = tails - heads + 1
            # a run depends on what stands before it, the last part of it also on what follows
            new_first = np.minimum(left_first[run_at[heads]], first[heads])
            goes_on = np.r_[same[1:], False][tails]
            new_last = np.where(goes_on, last[tails], np.maximum(right_last[tails], last[tails]))
            name = np.where(count > 1, common.mix64(name[heads] * _C + count.astype(np.uint64)), name[heads])
            start, end, first, last = start[heads], end[tails], new_first, new_last
        else:
            is_left = (common.mix64(name + _SIDES[round_no]) >> np.uint64(63)).astype(bool)
            joins = np.zeros(m, bool)  # with the next
            joins[:-1] = is_left[:-1] & ~is_left[1:] & ~no_right[:-1] & (end[1:] - start[:-1] <= LONGEST)
            joined = np.zeros(m, bool)
            joined[1:] = joins[:-1]
            # a left symbol left alone depends on the next, a right one on the one before
            alone = ~joins & ~joined
            new_first = np.where(alone & ~is_left, np.minimum(left_first, first), first)
            new_last = np.where(alone & is_left, np.maximum(right_last, last), last)
            k = np.flatnonzero(joins)
            name, end = name.copy(), end.copy()
            name[k] = common.mix64(name[k] * _A + name[k + 1] * _B)
            end[k] = end[k + 1]
            new_first[k] = np.minimum(first[k], first[k + 1])
            new_last[k] = np.maximum(last[k], last[k + 1])
            keep = ~joined
            name, start, end, first, last = name[keep], start[keep], end[keep], new_first[keep], new_last[keep]
    inside = (first >= 0) & (last <= n)
    return name[inside].view(np.int64), first[inside], last[inside]


def _long_rows(data: np.ndarray, offsets: np.ndarray, length: int):
    """(starts and ends of the words, their offsets, row numbers) of the rows with a window."""
    starts, ends, at = common.words_in(data, offsets)
    rows = np.flatnonzero(np.diff(at) >= length)
    keep = np.repeat(np.diff(at) >= length, np.diff(at))
    return starts[keep], ends[keep], np.r_[0, np.cumsum(np.diff(at)[rows])], rows


def window_hashes(words: np.ndarray, places: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hashes of the windows words[p:p + length]; which: of the two sets of numbers."""
    total = np.zeros(len(places), np.uint64)
    factors = common.mix64(np.arange(length, dtype=np.uint64) + _PLACES[which]) | np.uint64(1)
    for j in range(length):
        total += words[places + j] * factors[j]
    return common.mix64(total)


def candidates(words: np.ndarray, at: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For every word, whether a window of which all names are known for its row starts there; once for each of ``known``.

    known: names and the rows they are known for.
    """
    name, first, last = recompress(words, at)
    row = np.searchsorted(at, first, "right") - 1
    inside = (last <= at[row + 1]) & (last - first <= length)
    first, last, row = first[inside], last[inside], row[inside]
    key = common.mix64(name[inside].view(np.uint64) + row.astype(np.uint64) * _A)
    fits = np.arange(len(words)) + length <= np.repeat(at[1:], np.diff(at))
    out = []
    for names, rows in known:
        unshared = ~np.isin(key, common.mix64(names.view(np.uint64) + rows.astype(np.uint64) * _A))
        refused = np.zeros(len(words) + 1, np.int64)
        refused += np.bincount(np.maximum(last - length, at[row])[unshared], minlength=len(refused))
        refused -= np.bincount(first[unshared] + 1, minlength=len(refused))
        out.append((np.cumsum(refused[:-1]) == 0) & fits)
    return out


def symbols_of(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, name) of the final symbols that a window can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for begin, data, offsets in common.text_chunks(batch.column(2)):
                starts, ends, at, rows = _long_rows(data, offsets, length)
                name, first, last = recompress(_WORDS[0].words(data, starts, ends), at)
                row = np.searchsorted(at, first, "right") - 1
                ok = (last <= at[row + 1]) & (last - first <= length)
                of = begin + rows[row[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[of], twins[of], name[ok])], names=["doc_id", "twin", "name"])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "doc_id long, twin long, name long")


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, twin, text -> the same with compressed texts, for the way across the network."""
    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    for batch in batches:
        texts = pa.array([None if not x.is_valid else squeeze(x.as_py()) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "twin", "text"])


def _whole(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts as they were, some of them at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    held, size = [], 0
    for x in texts:
        held.append(expand(x.as_py()) if x.is_valid else b"")
        size += len(held[-1])
        if size > common.CHUNK_BYTES:
            yield pa.array(held, pa.large_binary())
            held, size = [], 0
    if held:
        yield pa.array(held, pa.large_binary())


def _lists(column: pa.Array, rows: np.ndarray) -> list[np.ndarray]:
    """The 64-bit lists of some rows; null counts as empty."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    full = np.asarray(column.is_valid())
    return [values[offsets[r] : offsets[r + 1]] if full[r] else values[:0] for r in rows.tolist()]


def _windows(length: int):
    """doc_id, text, later, earlier -> one, two, doc_id, twin, pos, later of the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids, twins = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            done = 0
            for texts in _whole(batch.column(2)):
                for begin, data, offsets in common.text_chunks(texts):
                    starts, ends, at, rows = _long_rows(data, offsets, length)
                    if not len(rows):
                        continue
                    own = done + begin + rows
                    known = [_lists(batch.column(i), own) for i in (3, 4)]
                    words = _WORDS[0].words(data, starts, ends)
                    later, earlier = candidates(words, at, [(np.concatenate(k), np.repeat(np.arange(len(k)), [*map(len, k)])) for k in known], length)
                    p = np.flatnonzero(later | earlier)
                    if not len(p):
                        continue
                    row = np.searchsorted(at, p, "right") - 1
                    one, two = window_hashes(words, p, length, 0), window_hashes(_WORDS[1].words(data, starts, ends), p, length, 1)
                    columns = (one.view(np.int64), two.view(np.int64), ids[own[row]], twins[own[row]], p - at[row], later[p])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["one", "two", "doc_id", "twin", "pos", "later"])
                done += len(texts)

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = _lists(batch.column(2), np.arange(batch.num_rows))
            copies = batch.column(3).to_pylist()
            done = 0
            for texts in _whole(batch.column(1)):
                n, removed, kept = [], [], []
                for text, begins, copy in zip(texts, starts[done:], copies[done:], strict=False):
                    words = text.as_py().split()
                    gone = 0
                    if copy and len(words) >= length:
                        words, gone = [], len(words)
                    elif len(begins):
                        covered = np.zeros(len(words) + 1, np.int64)
                        np.add.at(covered, begins, 1)
                        np.add.at(covered, begins + length, -1)
                        left = np.cumsum(covered[:-1]) == 0
                        gone = len(words) - int(left.sum())
                        words = [*itertools.compress(words, left.tolist())]
                    n.append(len(words) + gone)
                    removed.append(gone)
                    kept.append(b" ".join(words))
                out = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), out], names=["doc_id", "n_words", "n_removed", "kept"])
                done += len(n)

    return run


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept: the words left, joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    both = ["one", "two"]
    hashed = docs.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), "text")})
    texts = common.staged(hashed.where("doc_id is not null and text is not null").select("doc_id", *both), "texts")
    # Rows of one id with different texts are told apart by the hash of their text; no other row needs that.
    whole = F.struct(*both)
    several = texts.groupBy("doc_id").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a < b").select("doc_id", F.lit(True).alias("several"))
    if several.isEmpty():
        docs, texts = docs.withColumn("twin", F.lit(0).cast("long")), texts.withColumn("twin", F.lit(0).cast("long"))
    else:
        twin = F.when(F.col("several") & F.col("one").isNotNull(), F.col("one")).otherwise(0).alias("twin")
        docs = hashed.join(several, "doc_id", "left").select("doc_id", "text", twin)
        texts = texts.join(several, "doc_id", "left").select("doc_id", *both, twin)
    row = ["doc_id", "twin"]
    # Whole texts first: the top symbol of any copy is shared, and a copy of a smaller document keeps nothing.
    copies = texts.join(texts.groupBy(*both).agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1"), both).where("doc_id > lo").select(*row)
    symbols = symbols_of(docs.where("doc_id is not null"), length)
    shared = symbols.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # The complement is a key that the sums aren't partitioned by, so that they cross the network on their own and the
    # join can split a name that very many documents share; so it is with the windows below.
    mirrored = shared.select(F.bitwise_not("name").alias("mirror"), "lo", "hi")
    name = F.bitwise_not("mirror")
    marks = (
        symbols.select(*row, F.bitwise_not("name").alias("mirror"))
        .join(mirrored, "mirror")
        .select(*row, F.when(F.col("lo") < F.col("doc_id"), name).alias("later"), F.when(F.col("hi") > F.col("doc_id"), name).alias("earlier"), F.lit(False).alias("copy"))
    )
    none = F.lit(None).cast("long")
    marks = (
        marks.unionByName(copies.select(*row, none.alias("later"), none.alias("earlier"), F.lit(True).alias("copy")))
        .groupBy(*row)
        .agg(F.collect_set("later").alias("later"), F.collect_set("earlier").alias("earlier"), F.max("copy").alias("copy"))
    )
    squeezed = docs.select(*row, "text").mapInArrow(_squeezed, "doc_id long, twin long, text binary")
    windows = (
        squeezed.join(marks, row, "left")
        .where("not coalesce(copy, false)")  # nothing that would be pushed below the join: the texts' exchange is used again
        .select(*row, "text", "later", "earlier")
        .mapInArrow(_windows(length), "one long, two long, doc_id long, twin long, pos int, later boolean")
    )
    firsts = windows.groupBy(*both).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    mirror = [F.bitwise_not("one").alias("one"), "two"]
    hits = windows.where("later").select(*row, "pos", *mirror).join(firsts.select("lo", *mirror), both).where("doc_id > lo").select(*row, F.col("pos").cast("long"), F.lit(False).alias("copy"))
    hits = (
        hits.unionByName(copies.select(*row, none.alias("pos"), F.lit(True).alias("copy")))
        .groupBy(*row)
        .agg(F.collect_set("pos").alias("starts"), F.max("copy").alias("copy"))
    )
    return squeezed.join(hits, row, "left").select("doc_id", "text", "starts", "copy").mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept string")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), m AS (
  SELECT s, min(doc_id) AS lo FROM g GROUP BY s HAVING count(*) > 1
), c AS (
  SELECT DISTINCT g.doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN m USING (s) WHERE lo < g.doc_id
), x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), k AS (
  SELECT x.doc_id, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS kept
  FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
