"""Quality rules with thresholds that adapt to language and source.

For each document some rates are measured in one pass, as whole numbers for a
thousand words or lines.  Their distributions are kept as mergeable quantile
sketches: counts by buckets of a sixteenth of an octave, which add up, so that
the sketches of a language and source, of a language, and of the whole table
come from the same counts.  A group of fewer than ``min_group`` documents
borrows the sketch of its language, and that of the table if the language is
small as well.  A rate's limits are an upper and a lower quantile plus
``spread`` times the distance from the median, plus a slack; documents outside
fail the rule.  The lower quantile is the first quartile.  The upper one is the
third quartile where a bad share of a group, of up to a quarter of it, must not
move the limit (word length, symbols), and the 95th percentile for rates that
are zero in most documents (repeated lines and words), whose third quartile
tells nothing about the group.

The base rules (too few words; too many repeated words) are fixed and hold
beside the adaptive ones; documents that fail them stay out of the sketches.

The measurements are written to the shared folder once; texts are neither
shuffled nor read again.  Sketches are counts, summed before they meet, so a
source with a third of all rows is no burden.

A null text has no words and fails the base.  Null languages and sources are
groups of their own.  Repeated rows stay.  An empty table gives no rows.
Columns beside doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm.native import let

SYMBOLS = "[#*$%&|<>]"
#: rate -> (numerator, denominator, slack, percent of the upper quantile)
RATES = {
    "word_length": ("word_chars", "n_words", 1000, 75),
    "symbol_rate": ("n_symbols", "n_words", 100, 75),
    "dup_line_rate": ("n_dup_lines", "n_lines", 200, 95),
    "repeat_rate": ("n_repeat_words", "n_words", 100, 95),
}


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that the array holds twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def at(h: Column) -> Column:  # places of windows that occur again, in order
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(at(h), covered)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, common.WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("chars"), repeated_words(w).alias("repeated")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return docs.select("doc_id", "lang", "source", of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")).select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        "n_symbols",
        F.col("l.n").alias("n_lines"),
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
    )


def bucket(value: str) -> Column:
    """The least number of a value's bucket: itself below 32, above that with its five leading bits."""
    return F.expr(f"if({value} < 32, {value}, {value} - {value} % shiftleft(1L, length(bin({value})) - 5))")


def sketches(rates: DataFrame) -> DataFrame:
    """level, lang, source, rate, bucket, n: the sketches of three levels; rates: lang, source, rate, value."""
    counts = rates.groupBy("lang", "source", "rate", bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    merged = [
        counts.groupBy(*(F.lit(None).cast("string").alias(c) if c not in keys else F.col(c) for c in ("lang", "source")), "rate", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        for level, keys in enumerate((("lang", "source"), ("lang",), ()))
    ]
    return reduce(DataFrame.unionByName, merged)


def limits(sketch: DataFrame, *, min_group: int, spread: int) -> DataFrame:
    """level, lang, source, rate, low, high of the groups with ``min_group`` documents."""
    group = ["level", "lang", "source", "rate"]
    running = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    slack = F.create_map(*(F.lit(x) for name, (_, _, s, _) in RATES.items() for x in (name, s)))[F.col("rate")]
    upper = F.create_map(*(F.lit(x) for name, (_, _, _, u) in RATES.items() for x in (name, u)))[F.col("rate")]
    percent = {"lower": F.lit(25), "median": F.lit(50), "upper": upper}
    quantile = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket"))).alias(name) for name, p in percent.items()]
    return (
        running.groupBy(*group)
        .agg(F.max("total").alias("total"), *quantile)
        .where(F.col("total") >= F.when(F.col("level") == 2, 0).otherwise(min_group))
        .select(*group, (F.col("lower") - spread * (F.col("median") - F.col("lower")) - slack).alias("low"), (F.col("upper") + spread * (F.col("upper") - F.col("median")) + slack).alias("high"))
    )


def judged(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, min_group: int = 100, spread: int = 3) -> DataFrame:
    """The counts of every document, base_failed, failed (names of the adaptive rules) and kept."""
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = common.staged(measured(docs), "measured").withColumn("base_failed", base_failed)
    for name, (part, whole, _, _) in RATES.items():
        counts = counts.withColumn(name, F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long"))
    rates = counts.where("not base_failed").select(
        "lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), F.col(n).alias("value")) for n in RATES))).alias("r")
    ).select("lang", "source", "r.rate", "r.value")
    found = limits(sketches(rates), min_group=min_group, spread=spread)
    wide = found.groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", F.struct("low", "high")))).alias("limits"))
    by = [wide.where(F.col("level") == k).select("lang", "source", F.col("limits").alias(f"limits_{k}")) for k in range(3)]
    joined = counts.alias("d")
    for k, keys in enumerate((("lang", "source"), ("lang",), ())):
        side = by[k].alias(f"s{k}")
        if keys:
            condition = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"s{k}.{c}")) for c in keys])
            joined = joined.join(side, condition, "left")
        else:
            joined = joined.join(F.broadcast(side), F.lit(True), "left")  # one row
    own = F.coalesce(F.col("limits_0"), F.col("limits_1"), F.col("limits_2"))
    failed = F.filter(
        F.array(*(F.when((F.col(n) < own[n]["low"]) | (F.col(n) > own[n]["high"]), F.lit(n)) for n in RATES)),
        lambda x: x.isNotNull(),
    )
    return joined.select("d.*", failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, p, struct_pack(a := w[p], b := w[p + 1], c := w[p + 2]) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1
), v AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM d LEFT JOIN v USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), x AS (
  SELECT doc_id, lang, source, base_failed, u.rate, u.slack, u.pct, u.num * 1000 // greatest(u.den, 1) AS value
  FROM (SELECT *, unnest([
    {'rate': 'word_length', 'slack': 1000, 'pct': 75, 'num': word_chars, 'den': n_words}, {'rate': 'symbol_rate', 'slack': 100, 'pct': 75, 'num': n_symbols, 'den': n_words},
    {'rate': 'dup_line_rate', 'slack': 200, 'pct': 95, 'num': n_dup_lines, 'den': n_lines}, {'rate': 'repeat_rate', 'slack': 100, 'pct': 95, 'num': n_repeat_words, 'den': n_words}]) AS u FROM f)
), c AS (
  SELECT lang, source, rate, slack, pct, CASE WHEN value < 32 THEN value ELSE value - value % (1::BIGINT << (length(bin(value)) - 5)::BIGINT) END AS bucket, count(*) AS n
  FROM x WHERE NOT base_failed GROUP BY ALL
), s AS (
  SELECT 0 AS level, lang, source, rate, slack, pct, bucket, n FROM c
  UNION ALL SELECT 1, lang, NULL, rate, slack, pct, bucket, sum(n) FROM c GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, slack, pct, bucket, sum(n) FROM c GROUP BY ALL
), t AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM s
), q AS (
  SELECT level, lang, source, rate, slack, min(bucket) FILTER (upto * 100 >= total * 25) AS lower_q, min(bucket) FILTER (upto * 100 >= total * 50) AS median_q, min(bucket) FILTER (upto * 100 >= total * pct) AS upper_q
  FROM t GROUP BY ALL HAVING max(total) >= 100 OR level = 2
), b AS (
  SELECT level, lang, source, rate, lower_q - 3 * (median_q - lower_q) - slack AS low, upper_q + 3 * (upper_q - median_q) + slack AS high FROM q
), o AS (
  SELECT x.doc_id, bool_or(x.value < coalesce(b0.low, b1.low, b2.low) OR x.value > coalesce(b0.high, b1.high, b2.high)) AS failed
  FROM x
  LEFT JOIN b b0 ON b0.level = 0 AND b0.rate = x.rate AND b0.lang IS NOT DISTINCT FROM x.lang AND b0.source IS NOT DISTINCT FROM x.source
  LEFT JOIN b b1 ON b1.level = 1 AND b1.rate = x.rate AND b1.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN b b2 ON b2.level = 2 AND b2.rate = x.rate
  GROUP BY x.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM f JOIN o USING (doc_id)
"""
