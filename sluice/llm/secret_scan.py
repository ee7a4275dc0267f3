"""Secret scan: patterns, and character Markov models of random and ordinary strings.

All of it are DataFrame functions.  The patterns give the base spans.  Beside
them, every run of 20 or more characters of ``ALPHABET`` is scored by two
first-order Markov models of its characters, smoothed by the frequencies of
single ones: one trained on random strings
(digests written in hexadecimal, base 64 and base 32, made here and so known
to be random), one on ordinary identifiers (the words of a sample of documents
outside of any base span, alone and joined as names in programs are).  A run whose log-likelihood ratio exceeds
``threshold`` adds a span of kind ``markov``, unless it overlaps a base span.

The fit is bounded: ``sample_docs`` documents, the least by a hash of their
id, of at most ``sample_chars`` characters each, and ``n_random`` digests.  What
the driver gets is a table of character pairs, of a fixed size.  Every text is
scanned whole, in one pass without a shuffle.

A null text counts as empty; texts without a match have zero counts, the
digest of the empty string and an empty span list.  Repeated rows stay.  An
empty table gives no rows; the models then know random strings only.  Columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.native import let, matches

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as long a run as there is, so the same as dropping short matches of AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WORD = r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z_-]{2,23}(?![A-Za-z0-9_-])"
BACK_OFF = 5  # how many pairs the single characters' frequencies count for
RUN = r"[A-Za-z0-9+/_=-]{20,}"


def _codes(text: Column) -> Column:
    """The characters' places in ``ALPHABET`` from 1 on; 0: not in it."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(samples: DataFrame) -> DataFrame:
    """label, text -> label, pair, n: how often one character follows another."""
    width = len(ALPHABET) + 1
    codes = samples.where(F.length("text") > 1).select("label", _codes(F.col("text")).alias("c"))
    return (
        codes.select("label", F.explode(F.expr(f"transform(sequence(0, size(c) - 2), i -> c[i] * {width} + c[i + 1])")).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def train(docs: DataFrame, *, sample_docs: int = 1000, sample_chars: int = 20_000, n_random: int = 4000) -> list[float]:
    """Log-likelihood ratios (random to ordinary) by pair of places in ``ALPHABET``."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    encoded = F.base64(F.unhex(digest))
    random = spark.range(n_random).select(
        F.lit(1).alias("label"),
        F.when(F.col("id") % 4 == 0, digest)
        .when(F.col("id") % 4 == 1, F.translate(F.upper(encoded), "+/=", ""))
        .when(F.col("id") % 4 == 2, F.translate(encoded, "+/", "-_"))
        .otherwise(encoded)
        .alias("text"),
    )
    ids = docs.where("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    chosen = docs.join(F.broadcast(ids), "doc_id").select(F.substring("text", 1, sample_chars).alias("text"))  # sample_docs ids at most
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))
    joined = let(words, lambda w: F.flatten(F.transform(w, lambda x, i: F.array_compact(F.array(x, F.concat(x, F.lit("_"), F.get(w, i + 1)), F.concat(x, F.initcap(F.get(w, i + 1))))))))
    ordinary = chosen.select(F.lit(0).alias("label"), F.explode(joined).alias("text"))
    width = len(ALPHABET) + 1
    counts = {(r["label"], r["pair"]): r["n"] for r in _pairs(random.union(ordinary)).collect()}  # 2 * width ** 2 rows at most
    models = []
    for label in (0, 1):
        single = [0.5 + sum(counts.get((label, a * width + b), 0) for a in range(width)) for b in range(width)]
        total = sum(single)
        rows = []
        for a in range(width):
            own = [counts.get((label, a * width + b), 0) for b in range(width)]
            rows += [math.log((n + BACK_OFF * single[b] / total) / (sum(own) + BACK_OFF)) for b, n in enumerate(own)]
        models.append(rows)
    return [r - o for o, r in zip(*models, strict=True)]


def ratio(text: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a text's characters, each given the one before."""
    width = len(ALPHABET) + 1
    return let(
        F.lit(table),
        lambda t: let(
            _codes(text),
            lambda c: F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))),
                F.lit(0.0),
                lambda acc, i: acc + F.coalesce(F.get(t, F.get(c, i - 1) * width + F.get(c, i)), F.lit(0.0)),
            ),
        ),
    )


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, table: list[float], *, threshold: float = 12.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base, spans) of every document.

    base, spans: array<struct<start,end,kind>>, kind as a place in ``KINDS``;
    code points, end exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        "doc_id",
        _of_kind(F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6), "assign").alias("assign"),
        _of_kind(matches(text, ACCESS), "access").alias("access"),
        _of_kind(matches(text, HEX), "hex").alias("hex"),
        _of_kind(F.filter(matches(text, RUN), lambda m: ratio(m["value"], table) > threshold), "markov").alias("markov"),
    )
    base = F.concat("assign", "access", "hex")
    extra = let(base, lambda b: F.filter("markov", lambda m: ~F.exists(b, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *sizes, base.alias("base"), extra.alias("extra")).select(
        "doc_id", *(f"n_{k}" for k in KINDS[:3]), F.size("extra").cast("long").alias("n_markov"), "base", F.concat("base", "extra").alias("spans")
    )
