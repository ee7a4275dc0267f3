"""SimHash fingerprints and the exact components of those within a Hamming radius.

A fingerprint has a bit set where over half the hashes (XXH64, seed 42) of a
text's lower-cased word shingles, repeats included, have it set.  Equal
fingerprints meet first, so copies cost nothing below.

Distinct fingerprints are dealt to shards before any tree is grown, since
64-bit fingerprints of unrelated texts lie 32 +- 4 bits apart: around any
vantage point, a radius of 4 is a whole standard deviation, and a tree over
all of them can't prune.  The bits are cut into ``radius + 2`` blocks (more
for large tables).  Two fingerprints within the radius agree on two or more
blocks at least, so in one of the subspaces spanned by a choice of blocks they
are at distance zero from one another, and from the shard's vantage point
there.  Every fingerprint goes to its shard of each subspace.

Within a shard a vantage-point tree finds the pairs exactly: an inner node
holds a point and the median distance to it, and a query enters a side only if
the triangle inequality lets that side hold points within the radius.  A
shard of more than ``shard_rows`` is divided by the distance to a vantage
point into rings; a ring is looked at together with its neighbours only, in
pairs of bounded parts.  A shard gives a spanning forest of its links rather
than all pairs.

Texts without words, null ones too, have fingerprint zero, which links like
any other.  Repeated ids with equal texts stay as rows.  An empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAF = 64


def fingerprint(text: bytes, k: int = 4) -> int:
    words = text.translate(_LOWER).split()  # bytes split at the six separators
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False)] if len(words) >= k else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, k: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number in ``out``."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or b"", k) for t in texts.cast(pa.large_binary())], pa.int64())

    return docs.withColumn(out, fingerprints(F.col(text)))


# ---------------------------------------------------------------- within a shard


class VantageTree:
    """Points that can be found by distance and taken out."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.alive = np.ones(len(points), bool)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        vantage = members[len(members) // 2]
        distance = np.bitwise_count(self.points[members] ^ self.points[vantage])
        middle = int(np.median(distance))
        near = distance <= middle
        if near.all():  # ties: as many points as there are at one distance can't be halved
            near = distance < middle
            middle -= 1
            if not near.any():
                return members
        return self.points[vantage], middle, self._grow(members[near]), self._grow(members[~near])

    def take(self, point: np.uint64, radius: int) -> np.ndarray:
        """The points left within ``radius`` of ``point``; they are taken out."""
        found, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, np.ndarray):
                node = node[self.alive[node]]
                found.append(node[np.bitwise_count(self.points[node] ^ point) <= radius])
            else:
                vantage, middle, near, far = node
                distance = int(np.bitwise_count(point ^ vantage))
                if distance - radius <= middle:
                    todo.append(near)
                if distance + radius > middle:
                    todo.append(far)
        out = np.concatenate(found)
        self.alive[out] = False
        return out


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs within ``radius`` that connect whatever is connected among the points."""
    if len(points) == 2:
        return [(0, 1)] if np.bitwise_count(points[0] ^ points[1]) <= radius else []
    tree, links = VantageTree(points), []
    for i in range(len(points)):
        if tree.alive[i]:
            tree.alive[i] = False
            todo = [i]
            while todo:
                j = todo.pop()
                got = tree.take(points[j], radius).tolist()
                links += [(j, m) for m in got]
                todo += got
    return links


# ---------------------------------------------------------------- shards


def subspaces(rows: int, radius: int) -> list[int]:
    """Bit masks: any two fingerprints within ``radius`` are equal under one of them.

    With radius + e blocks any such pair agrees on e of them or more; e grows
    with the table until a shard holds a few unrelated fingerprints.
    """
    for extra in (2, 3, 4, 5):
        blocks = radius + extra
        if rows < 64 << (64 * extra // blocks) or extra == 5:
            break
    at = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(at)]
    return [sum(c) for c in itertools.combinations(masks, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """(u, v): links between the ids of distinct fingerprints, enough to connect all within ``radius``.

    points: id, fingerprint; one row for each fingerprint.
    """
    masks = subspaces(points.count(), radius)
    # The masks are a constant list rather than an expression each, which keeps the generated code small.
    spaces = F.array(*(F.struct(F.lit(i).alias("space"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)))
    keyed = points.select("id", "fingerprint", F.explode(spaces).alias("s")).select(
        "id", "fingerprint", F.struct("s.space", F.col("fingerprint").bitwiseAND(F.col("s.mask")).alias("value")).alias("shard")
    )
    large = common.staged(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("vantage")).where(F.col("n") > shard_rows), "large")
    held = _beside(keyed, large, "shard")
    # Ring by ring around the vantage point: a pair within the radius lies in one ring or in neighbours, each of which
    # is cut into parts again, and every two parts of such rings meet in a shard of bounded size.
    parts = F.ceil(F.col("n") * 2 / (3 * shard_rows)).cast("int")
    ring = F.floor(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("vantage"))) / (radius + 1)).cast("int")
    own = ring * parts + F.pmod(F.xxhash64("fingerprint"), parts)
    first = (ring - 1) * parts
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(first, first + 3 * parts - 1), lambda p: F.least(p, own).cast("long") * (1 << 24) + F.greatest(p, own))
    )
    dealt = held.select("id", "fingerprint", F.explode(pairs).alias("pair"), "shard").select(F.xxhash64("shard", "pair").alias("key"), "id", "fingerprint")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (ids, points) in _whole_shards(batches):
            us, vs, bits = [], [], points.view(np.uint64)
            for k in np.flatnonzero(np.diff(edges) > 1):
                a, b = edges[k], edges[k + 1]
                for i, j in forest(bits[a:b], radius):
                    us.append(ids[a + i])
                    vs.append(ids[a + j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(linked, "u long, v long")


def _beside(keyed: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """``keyed`` with what ``large`` says of its key; broadcast up to a million keys, as a join by exchange beyond."""
    return keyed.join(F.broadcast(large) if large.count() <= 1_000_000 else large, key, "left")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows (key, others) in the order of keys -> (bounds of the shards, the other columns), each shard whole."""
    held: list[np.ndarray] | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = [np.asarray(c) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held is None or not len(held[0]):
            continue
        key = held[0]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        if batch is not None:
            edges = edges[:-1]  # the last shard may go on
        if len(edges) > 1:
            yield edges, [c[: edges[-1]] for c in held[1:]]
            held = [c[edges[-1] :] for c in held]


# ---------------------------------------------------------------- similar texts

WIDE = 3
_WIDE_WORDS = tuple(f"w{i}" for i in range(WIDE))
_SALTS = common.mix64(np.arange(1, WIDE + 1, dtype=np.uint64))
_AT_ONCE = 1 << 14  # hashes whose bits are counted at once


def wide_fingerprints(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, three times 64 bits of SimHash over its distinct shingles, and a hash of their set; and whether it has any."""
    n = len(texts)
    out, full = np.zeros((n, WIDE + 1), np.uint64), np.zeros(n, bool)
    for first, hashes, row, sizes in _shingle_sets(texts, k):
        present = np.flatnonzero(sizes)
        if not len(present):
            continue
        at = (np.cumsum(sizes) - sizes)[present]
        rows = first + present
        full[rows] = True
        out[rows, WIDE] = common.mix64(np.add.reduceat(common.mix64(hashes), at) + sizes[present].astype(np.uint64))
        cut = np.r_[at, len(hashes)]
        for i, salt in enumerate(_SALTS):
            ones = np.zeros((len(present), 64), np.int64)
            bits = common.mix64(hashes + salt).view(np.uint8).reshape(-1, 8)
            j = 0
            while j < len(present):  # a bounded number of bits at a time, but whole texts
                upto = max(j + 1, int(np.searchsorted(cut, cut[j] + _AT_ONCE, "right")) - 1)
                if upto == j + 1:  # perhaps a very long one
                    for b in range(cut[j], cut[upto], _AT_ONCE):
                        ones[j] += np.unpackbits(bits[b : min(b + _AT_ONCE, cut[upto])], axis=1, bitorder="little").sum(0, dtype=np.int64)
                else:
                    ones[j:upto] = np.add.reduceat(np.unpackbits(bits[cut[j] : cut[upto]], axis=1, bitorder="little"), cut[j:upto] - cut[j], axis=0, dtype=np.int32)
                j = upto
            out[rows, i] = np.packbits(2 * ones > sizes[present][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out, full


def spanning(points: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A least spanning forest of the pairs that differ in ``most`` bits at most: near ones connect first.

    A link that fails the check of the sets has no substitute here; ``missed`` finds what it leaves apart.
    """
    n = len(points)
    best, by, left, links = np.full(n, 1 << 20), np.zeros(n, np.int64), np.ones(n, bool), []
    at = 0
    left[0] = False
    for _ in range(n - 1):
        out = np.flatnonzero(left)
        distance = np.bitwise_count(points[out] ^ points[at]).sum(1, dtype=np.int64)
        nearer = distance < best[out]
        best[out[nearer]], by[out[nearer]] = distance[nearer], at
        at = int(out[np.argmin(best[out])])
        left[at] = False
        if best[at] <= most:
            links.append((int(by[at]), at))
    return links


def prints_of(docs: DataFrame, k: int, similar_k: int) -> DataFrame:
    """doc_id, fingerprint (of ``k`` words), w0, w1, w2, whole (of ``similar_k`` words; null without words), staged: all that the links need, by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            wide, full = wide_fingerprints(texts, similar_k)
            narrow = pa.array([fingerprint(t.as_py() or b"", k) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), narrow, *(pa.array(wide[:, i].view(np.int64), mask=~full) for i in range(WIDE + 1))], names=["doc_id", "fingerprint", *_WIDE_WORDS, "whole"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("doc_id is not null")
    return common.staged(texts.mapInArrow(run, "doc_id long, fingerprint long, " + ", ".join(f"{c} long" for c in _WIDE_WORDS) + ", whole long"), "prints")


def similar_links(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, recall: float = 0.95, shard_rows: int = 2048, radius: int | None = None, narrow_k: int = 4) -> tuple[DataFrame, DataFrame]:
    """What connects the texts whose sets of ``k``-word shingles have a Jaccard similarity of ``similarity``: components, and links between them.

    (node, component) and (u, v), doc_ids; a document without a link, or with one of the second kind only, has no row in the first.

    Wide fingerprints are dealt to shards by samples of their bits, as many
    samples as find a bit pattern at the very limit with probability ``recall``.
    Pairs in reach of the limit are then verified by the shingle sets themselves,
    of the documents concerned only.  Whatever that leaves apart, since no sample
    has both texts or a crowded shard's forest went by other ones, is found
    exactly: see ``missed``.  With a ``radius``, the links of ``links`` are
    among those of the components.
    """
    prints = prints_of(docs, narrow_k, k)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("doc_id is not null and text is not null")
    narrow = None
    if radius is not None:  # before the wide ones, as texts without words have a narrow fingerprint only
        points = common.staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "points")
        narrow = links(points, radius).unionByName(prints.join(points, "fingerprint").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    prints = prints.where("whole is not null").drop("fingerprint")

    @F.arrow_udf("array<int>")
    def sets(texts: pa.Array) -> pa.Array:
        parts = []
        for _, hashes, _, sizes in _shingle_sets(texts, k):
            cut = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(cut), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    words = [*_WIDE_WORDS]
    points = common.staged(prints.groupBy(*words).agg(F.min("doc_id").alias("id")), "wide-points")
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi  # how often a bit differs at the limit
    # So few steps that the number of samples, and with it what crosses the network, doesn't creep up with the table.
    n = points.count()
    bits = 16 if n < 1 << 24 else 20 if n < 1 << 28 else 24
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits))
    most = int(64 * WIDE * apart + 3 * math.sqrt(64 * WIDE * apart * (1 - apart)))
    rng = np.random.default_rng(7)
    samples = []
    for t in range(tables):
        chosen = [0] * WIDE
        for b in rng.choice(64 * WIDE, bits, replace=False).tolist():
            chosen[b // 64] |= 1 << b % 64
        samples.append(F.struct(F.lit(t).alias("t"), *(F.lit(_signed(m)).alias(c) for c, m in zip(words, chosen, strict=True))))
    key = F.xxhash64("s.t", *(F.col(c).bitwiseAND(F.col(f"s.{c}")) for c in words))
    keyed = points.select("id", *words, F.explode(F.array(*samples)).alias("s")).select("id", *words, key.alias("key"))
    large = common.staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows), "wide-large")
    parts = F.ceil(F.col("n") * 2 / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("id"), parts)
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.least(p, own).cast("long") * (1 << 24) + F.greatest(p, own))
    )
    dealt = _beside(keyed, large, "key").select("key", "id", *words, F.explode(pairs).alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "id", *words)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (ids, *columns) in _whole_shards(batches):
            sizes, points = np.diff(edges), np.stack(columns, 1).view(np.uint64)
            shard = np.repeat(np.arange(len(sizes)), sizes)
            small = (sizes <= 16)[shard]
            us, vs = [], []
            for d in range(1, int(min(sizes.max(), 16))):  # all pairs of small shards, by how far apart they stand
                i = np.flatnonzero(small[:-d] & (shard[:-d] == shard[d:]))
                i = i[np.bitwise_count(points[i] ^ points[i + d]).sum(1, dtype=np.int64) <= most]
                us.append(ids[i])
                vs.append(ids[i + d])
            for s in np.flatnonzero(sizes > 16):
                a, b = edges[s], edges[s + 1]
                links = np.array(spanning(points[a:b], most), np.int64).reshape(-1, 2)
                us.append(ids[a + links[:, 0]])
                vs.append(ids[a + links[:, 1]])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    maybe = common.staged(dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(near, "u long, v long").where("u <> v").distinct(), "maybe")

    def verified(pairs: DataFrame, few: bool) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
        of = docs.join(F.broadcast(ends) if few else ends, "doc_id", "left_semi").select("doc_id", sets("text").alias("s"))
        both = pairs.join(of.select(F.col("doc_id").alias("u"), F.col("s").alias("a")), "u").join(of.select(F.col("doc_id").alias("v"), F.col("s").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")

    same = prints.join(points, words).where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    first = common.staged(reduce(DataFrame.unionByName, [verified(maybe, False), same, *([narrow] if narrow is not None else [])]), "similar")
    known = common.staged(components(first), "known")
    left = common.staged(missed(docs, prints.groupBy("whole").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), known, k=k, similarity=similarity, shard_rows=shard_rows), "missed")
    return known, verified(left, left.count() <= 500_000)


# ---------------------------------------------------------------- what the samples miss

_WORDS = common.WordHash(11)
SAMPLED, HOT, MOST_HOT = 16, 6, 1 << 19


def _shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes of the distinct shingles, their rows, sizes of the rows' sets), by row and hash."""
    for first, data, offsets in common.text_chunks(texts):
        data = common.lower_ascii(data)
        starts, ends, at = common.words_in(data, offsets)
        hashes, row = common.shingle_hashes(_WORDS.words(data, starts, ends), at, k)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        yield first, hashes[new], row[new], np.bincount(row[new], minlength=len(offsets) - 1)


def prefixes(hashes: np.ndarray, row: np.ndarray, sizes: np.ndarray, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place, count if hot) of the shingles of which two similar sets share one at least: the first of each set.

    A set's order is by how hot a shingle is, then by hash, which is the same order in all sets.
    """
    keys, counts = hot
    heat = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        heat = np.where(keys[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, heat, row))
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    first = place < (sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)[row]
    order = order[first]
    return hashes[order], row[first], place[first], heat[order]


def missed(docs: DataFrame, wanted: DataFrame, known: DataFrame, *, k: int, similarity: float, shard_rows: int) -> DataFrame:
    """(u, v): pairs that may be similar though they are of different components; every such pair is among them.

    wanted: one doc_id of each set of shingles; known: the components (node, component) of the links so far.

    Two sets of that similarity share one of their first shingles, in any order
    that is the same for all.  Hot shingles come last in it, so they are among the
    first of those sets only that hold little else; which are hot is told from a
    part of the documents, and makes no difference to what is found.
    """
    spark = docs.sparkSession

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, _, _ in _shingle_sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["key"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(every, "key long")
    top = part.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(MOST_HOT).toPandas()
    keys, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], counts[order]))  # bounded by MOST_HOT

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, row, sizes in _shingle_sets(batch.column(1), k):
                hashes, row, place, heat = prefixes(hashes, row, sizes, similarity, shared.value)
                at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))].astype(np.int32)
                parts = -(-heat * SAMPLED * 2 // shard_rows)  # an estimate of the list's length, in halves of a shard
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hashes.view(np.int64), place.astype(np.int32), np.maximum(parts, 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array(sizes.astype(np.int32)), *lists], names=["doc_id", "n", "keys", "places", "parts"])

    of = wanted.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    rows = docs.mapInArrow(firsts, "doc_id long, n int, keys array<long>, places array<int>, parts array<int>").where("n > 0").join(of, "doc_id")
    lists = common.staged(rows, "prefixes").select("doc_id", "component", "n", F.explode(F.arrays_zip("keys", "places", "parts")).alias("x")).select(
        F.col("x.keys").alias("key"), "doc_id", "component", "n", F.col("x.places").alias("place"), F.col("x.parts").alias("parts")
    )
    # A hot shingle's list is compared in pairs of bounded parts, unless one component holds all of it.
    mixed = lists.where("parts > 1").groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    hot = lists.where("parts > 1").join(F.broadcast(mixed), "key", "left_semi")  # MOST_HOT keys at most
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("key", F.least(p, own), F.greatest(p, own)))
    columns = ["doc_id", "component", "n", "place"]
    dealt = lists.where("parts = 1").select("key", *columns).union(hot.select(F.explode(pairs).alias("key"), *columns))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (ids, of, n, place) in _whole_shards(_gathered(batches)):
            end = np.repeat(edges[1:], np.diff(edges))
            i, us, vs, held = np.arange(len(ids)), [], [], 0
            for d in itertools.count(1):
                i = i[end[i] - i > d]
                last = not len(i)
                if not last:
                    j = i + d
                    ok = of[i] != of[j]
                    a, b = i[ok], j[ok]
                    needed = similarity / (1 + similarity) * (n[a].astype(np.int64) + n[b]) - 1e-6
                    ok = np.minimum(n[a] - place[a], n[b] - place[b]) >= needed
                    us.append(ids[a[ok]])
                    vs.append(ids[b[ok]])
                    held += int(ok.sum())
                if held and (last or held > 1 << 20):
                    u, v = np.concatenate(us), np.concatenate(vs)
                    u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                    us, vs, held = [], [], 0
                if last:
                    break

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(across, "u long, v long").where("u <> v").distinct()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= rows):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def groups(docs: DataFrame, *, k: int = 4, radius: int = 4, similar_k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that have near copies.

    Copies are documents whose fingerprints link, as in ``near_duplicates``, and
    those whose shingle sets are similar, as in ``similar_links``.
    """
    known, extra = similar_links(docs, k=similar_k, similarity=similarity, radius=radius, narrow_k=k)
    extra = common.staged(extra, "extra")
    if extra.isEmpty():
        return known.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))

    def component(column: str) -> DataFrame:
        return known.select(F.col("node").alias(column), F.col("component").alias(f"of_{column}"))

    between = extra.join(component("u"), "u", "left").join(component("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    joined = common.staged(components(between), "joined").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    members = known.select("node", "component").unionByName(joined.select(F.col("component").alias("node"), "component")).distinct()
    return members.join(joined, "component", "left").select(F.col("node").alias("doc_id"), F.coalesce("whole", "component").alias("component_id")).distinct()


def near_duplicates(docs: DataFrame, *, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    component_id: the smallest doc_id that links within ``radius`` bits reach,
    over any number of documents.
    """
    prints = common.staged(with_fingerprint(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), k).select("doc_id", "fingerprint"), "fingerprints")
    points = common.staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "points")
    of = components(links(points.where("id is not null"), radius))
    named = points.join(of, points["id"] == of["node"], "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(column: str = "fingerprint"):
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def unrelated_share(radius: int = 4, bits: int = 64) -> float:
    """The share of unrelated fingerprints within ``radius`` of a median split: what a tree over all would repeat."""
    return sum(math.comb(bits, d) for d in range(bits // 2 - radius, bits // 2 + radius + 1)) / 2**bits
