"""Cross-site boilerplate: lines by the number of distinct sites they are on.

A line's site spread is estimated by HyperLogLog sketches, one for each hash
of a line, which merge by aggregation.  A line on ``min_sites`` sites or more
is boilerplate, if it is also in ``min_sites`` different texts or more.  Copies
of a document put its lines on many sites, too, but are one text, and must not
lose it here; how often a text is copied, and what stands beside a line, makes
no difference.  Lines whose estimates lie near the threshold get exact distinct
counts, so the result is that of exact counting as long as no sketch errs by
``margin``.

Lines are compared without leading and trailing spaces; those shorter than
``min_chars`` are left alone.  All occurrences of boilerplate go.  A line on
every page is one row for each task after the partial aggregation.  Up to
``listed`` hashes, counted first, are tested where the text is, so that texts
don't cross the network; beyond that joins take their place, which can split a
frequent line, so no task gets a line's occurrences either way.

Null texts stay null with no lines; empty ones have one empty line.  A null
site counts as no site.  Repeated rows, ids with several texts and rows without
an id are each treated by their own text.  An empty table gives no rows.  A
column of the input named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm.native import let

LOG_K = 12


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """doc_id, site, key, whole: of every line that can be boilerplate; whole: the hash of the text that it is in."""
    per_line = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) >= min_chars), _key)
    return docs.where("text is not null").select("doc_id", F.col(site).alias("site"), F.xxhash64("text").alias("whole"), F.explode(per_line).alias("key")).select("doc_id", "site", "key", "whole")


def _few(keys: DataFrame, most: int) -> list[int] | None:
    """The hashes, if there are so few that they can be written into a condition."""
    found = [r["key"] for r in keys.select("key").limit(most + 1).collect()]
    return found if len(found) <= most else None


def boilerplate(docs: DataFrame, *, site: str = "source", min_sites: int = 10, min_chars: int = 20, margin: float = 0.2, listed: int = 10_000) -> DataFrame:
    """(key): hashes of the boilerplate lines."""
    lines = _lines(docs, site, min_chars)
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites"), F.hll_sketch_agg("whole", F.lit(LOG_K)).alias("wholes"), F.count(F.lit(1)).alias("n"))
    spread = sketched.where(F.col("n") >= min_sites).select("key", F.least(F.hll_sketch_estimate("sites"), F.hll_sketch_estimate("wholes")).alias("spread"))
    maybe = common.staged(spread.where(F.col("spread") >= min_sites * (1 - margin)), "spread")
    sure = F.col("spread") >= min_sites * (1 + margin)
    unsure = maybe.where(~sure)
    few = _few(unsure, listed)
    if few is not None:
        near = lines.where(F.col("key").isin(few))
    else:
        # The complement is a key that the sketches aren't partitioned by: the lines near a threshold then cross the
        # network on their own, and the join can split a line that is on very many pages.
        mirror = F.bitwise_not("key").alias("key")
        near = lines.select("site", mirror, "whole").join(unsure.select(mirror), "key", "left_semi").select("site", F.bitwise_not("key").alias("key"), "whole")
    # exact counts in two steps, so that a frequent line's sites and texts are summed up before they meet
    n_sites = near.where("site is not null").groupBy("key", "site").agg(F.lit(1)).groupBy("key").agg(F.count(F.lit(1)).alias("sites"))
    n_wholes = near.groupBy("key", "whole").agg(F.lit(1)).groupBy("key").agg(F.count(F.lit(1)).alias("wholes"))
    exact = n_sites.join(n_wholes, "key").where((F.col("sites") >= min_sites) & (F.col("wholes") >= min_sites))
    return maybe.where(sure).select("key").union(exact.select("key"))


def without_boilerplate(docs: DataFrame, *, site: str = "source", min_sites: int = 10, min_chars: int = 20, margin: float = 0.2, listed: int = 10_000) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the columns n_lines and n_removed."""
    keys = common.staged(boilerplate(docs, site=site, min_sites=min_sites, min_chars=min_chars, margin=margin, listed=listed), "boilerplate")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.split("text", "\n", -1)
    few = _few(keys, listed)
    if few is not None:
        stays = lambda x: (F.length(F.trim(x)) < min_chars) | ~_key(x).isin(few)
        joined, kept = docs.select(*columns), F.filter(lines, stays) if few else lines
    else:
        marks = _lines(docs, site, min_chars).join(keys, "key").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_keys"))
        joined = docs.select(*columns).join(marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        some = let(F.col("_keys"), lambda ks: F.filter(lines, lambda x: (F.length(F.trim(x)) < min_chars) | ~F.array_contains(ks, _key(x))))
        kept = F.when(F.col("_keys").isNull(), lines).otherwise(some)
    out = joined.select(*columns, kept.alias("_kept"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"))
    text = F.when(F.size("_kept") == F.col("n_lines"), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long")
    return out.select(*((F.when(F.col("text").isNotNull(), text).alias("text")) if c == "text" else F.col(c) for c in columns), "n_lines", removed.alias("n_removed"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, trim(whole, ' ') AS line, whole, text
  FROM (SELECT doc_id, source, sha256(text) AS text, unnest(string_split(text, chr(10))) AS whole, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), b AS (
  SELECT line FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) >= 10
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM b)) AS n_removed,
    coalesce(string_agg(whole, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM b)), '') AS text
  FROM l GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
