"""Match positions as native expressions: Spark's regular-expression functions return strings, not offsets.

The text between matches comes from split() and the matches from regexp_extract_all() with the same pattern; a running
sum of their lengths in code points gives each match's start. The sum runs over blocks of BLOCK matches, so that a text
with very many matches costs little more than one with few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, upto

BLOCK = 64
SPAN = "array<struct<start:int,ord:int,stop:int,kind:string,value:string>>"


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def running_max(numbers: Column) -> Column:
    """For each of the numbers (at least 0) the largest of those before it, or 0."""
    most = lambda part: F.coalesce(F.array_max(part), F.lit(0))
    blocks = lambda x: F.transform(upto(F.floor((F.size(x) + BLOCK - 1) / BLOCK).cast("int")), lambda b: most(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

    def each(s: Column) -> Column:
        earlier = lambda i: F.get(s["before"], F.floor(i / BLOCK).cast("int"))
        own = lambda i: most(F.slice(s["x"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, (i % BLOCK).cast("int")))
        return F.transform(s["x"], lambda _, i: F.greatest(earlier(i), own(i)))

    def summed(y: Column) -> Column:
        before = F.transform(y["blocks"], lambda _, b: most(F.slice(y["blocks"], F.lit(1), b)))
        return let(F.struct(y["x"].alias("x"), before.alias("before")), each)

    return let(numbers, lambda x: let(F.struct(x.alias("x"), blocks(x).alias("blocks")), summed))


#: Code points of a page.
PAGE = 256


def pages(text: Column) -> Column:
    """The text as pages of PAGE code points, so that a part is found without walking the text from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def part(pages: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop of the text that pages hold."""
    first = F.floor(start / PAGE).cast("int")
    held = F.slice(pages, first + 1, F.greatest(F.lit(0), F.floor((stop - 1) / PAGE).cast("int") - first + 1))
    return F.substr(F.array_join(held, ""), start - first * PAGE + 1, stop - start)


def find(text: Column, kind: str, ord_: int, pattern: str, keep: Callable[[Column], Column], guard: Column | None = None) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches for whose string keep() holds; [] for null text.

    pattern must not match the empty string. guard: a cheap condition without which there can't be a match."""

    def located(x: Column) -> Column:
        between, found = x["between"], x["found"]
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))

        def placed(y: Column) -> Column:
            blocks = F.transform(upto(F.floor((F.size(y["steps"]) + BLOCK - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(y["steps"], b * BLOCK + 1, F.lit(BLOCK))))
            return let(
                F.struct(y["steps"].alias("steps"), blocks.alias("blocks")),
                lambda z: let(
                    F.struct(z["steps"].alias("steps"), F.transform(z["blocks"], lambda _, b: _total(F.slice(z["blocks"], F.lit(1), b))).alias("before")),
                    lambda s: F.transform(found, lambda m, i: start_of(s, m, i)),
                ),
            )

        def start_of(s: Column, m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(s["before"], block) + _total(F.slice(s["steps"], block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(between, i))
            return let(start.cast("int"), lambda at: F.struct(at.alias("start"), F.lit(ord_).alias("ord"), (at + F.length(m)).cast("int").alias("stop"), F.lit(kind).alias("kind"), m.alias("value")))

        return F.filter(let(F.struct(steps.alias("steps")), placed), lambda s: keep(s["value"]))

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    may = text.isNotNull() & (guard if guard is not None else text.rlike(pattern))
    return F.when(may, let(parts, located)).otherwise(F.array()).cast(SPAN)


def merged(*spans: Column) -> Column:
    """All spans by start, then order of kinds."""
    return F.array_sort(F.concat(*spans))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
