"""Spans of a text as arrays of struct (start, end, ...), places in code points: folded and cut in time linear in text and spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values whose running maximum is taken together.
BLOCK = 64
#: A character in this encoding has WIDTH bytes, so that any piece is found by its place.
ENCODING, WIDTH = "UTF-32", 4


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it, and not copied: a fold of nothing, and its last step."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def running_max(values: Column, body: Callable[[Column], Column], levels: int = 3) -> Column:
    """body(before), before having for each of values the greatest of those ahead of it, null for the first.

    Folds with arrays as their state copy them at each step. Here maxima of blocks, and of blocks of blocks, are taken once; a value looks at
    those of its own block and at what is ahead of the block.
    """
    n = F.size(values)
    if levels == 1:
        return bound(F.transform(values, lambda _, i: F.array_max(F.slice(values, F.lit(1), i))), body)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def within(ahead: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        own = lambda i: F.array_max(F.slice(values, block(i) * BLOCK + 1, i - block(i) * BLOCK))
        return bound(F.transform(values, lambda _, i: F.greatest(F.get(ahead, block(i)), own(i))), body)

    return bound(blocks, lambda b: running_max(b, within, levels - 1))


def running_sum(values: Column, body: Callable[[Column], Column], levels: int = 3) -> Column:
    """body(sums), sums having for each of values the sum up to and including it; by blocks, as running_max()."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(values)
    if levels == 1:
        return bound(F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i + 1))), body)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def within(upto: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        own = lambda i: total(F.slice(values, block(i) * BLOCK + 1, i - block(i) * BLOCK + 1))
        return bound(F.transform(values, lambda _, i: F.coalesce(F.get(upto, block(i) - 1), F.lit(0)) + own(i)), body)

    return bound(blocks, lambda b: running_sum(b, within, levels - 1))


def united(spans: Column, fields: list[str]) -> Column:
    """Sorted spans made disjoint: overlapping ones are one from the first start to the last end, with the other fields of the first."""

    def merged(s: Column) -> Column:
        def heads(before: Column) -> Column:
            each = F.transform(s, lambda x, i: F.struct(x.alias("span"), F.get(before, i).alias("before")))
            return F.filter(each, lambda h: h["before"].isNull() | (h["span"]["start"] >= h["before"]))

        def closed(h: Column) -> Column:
            last = F.array_max(F.transform(s, lambda x: x["end"]))
            end = lambda i: F.coalesce(F.get(h, i + 1)["before"], last)
            return F.transform(h, lambda x, i: F.struct(*((end(i) if f == "end" else x["span"][f]).alias(f) for f in fields)))

        ends = F.transform(s, lambda x: x["end"])
        found = bound(ends, lambda e: running_max(e, heads))
        return bound(found, closed)

    # an empty array has no blocks; it is its own union
    same = lambda s: F.transform(s, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return bound(spans, lambda s: F.when(F.size(s) > 1, merged(s)).otherwise(same(s)))


def rewritten(text: Column, spans: Column, said: Callable[[Column, Column], Column]) -> Column:
    """text with each of its spans (sorted, disjoint) replaced by said(span, its text). Without spans the text as it is."""

    def put_together(x: Column) -> Column:
        code, cuts = x["code"], x["cuts"]
        piece = lambda start, end: F.decode(F.substring(code, WIDTH * start + 1, WIDTH * (end - start)), ENCODING)
        before = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))
        parts = F.transform(cuts, lambda s, i: F.concat(piece(before(i), s["start"]), said(s, piece(s["start"], s["end"]))))
        n = F.floor(F.length(code) / WIDTH).cast("int")
        return F.concat(F.array_join(parts, ""), piece(F.element_at(cuts, -1)["end"], n))

    taken = bound(F.struct(F.encode(text, ENCODING).alias("code"), spans.alias("cuts")), put_together)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, taken).otherwise(text)
