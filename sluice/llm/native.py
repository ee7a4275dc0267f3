"""Column helpers for operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Running totals of an array of whole numbers; by blocks, as appending to one long array would take square time."""

    def running(part: Column, start: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, _BLOCK)

    def body(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, _BLOCK))
        return let(
            blocks,
            lambda bs: let(
                F.aggregate(bs, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x)))),
                lambda at: F.flatten(F.transform(bs, lambda b, i: running(b, F.get(at, i)))),
            ),
        )

    empty = F.array().cast("array<bigint>")
    return let(F.transform(values, lambda x: x.cast("long")), lambda a: F.when(F.size(a) == 0, empty).otherwise(body(a)))


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    value: the match, or one of its groups.  The pattern is scanned once where nothing matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = let(
        whole,
        lambda m: let(
            F.split(text, pattern, -1),
            lambda s: let(
                value,
                lambda v: let(
                    prefix_sums(F.transform(m, lambda x, i: F.length(F.get(s, i)) + F.length(x))),
                    lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), F.get(v, i).alias("value"))),
                ),
            ),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
