"""Matches of a pattern with their places, and texts rebuilt with matches replaced; SQL only.

Work grows with the length of the text, also where a text has very many matches.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCK = 256


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches, or their group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ends(steps: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks so that long arrays stay cheap."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")

    def within(step):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / BLOCK).cast("int")),
                             lambda k: F.aggregate(F.slice(step, k * BLOCK + 1, F.lit(BLOCK)),
                                                   zero, add))
        bases = F.aggregate(blocks, F.array(zero),
                            lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return F.flatten(F.transform(F.array(bases), lambda base: F.transform(
            step, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + F.aggregate(
                F.slice(step, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1),
                zero, add))))

    held = F.transform(F.array(F.transform(steps, lambda x: x.cast("bigint"))), within)
    return F.when(F.size(steps) > 0, F.element_at(held, 1)).otherwise(
        F.expr("cast(array() as array<bigint>)"))


def placed(text: Column, pattern: str, found: Column, values: Column, kind: str, rank: int
           ) -> Column:
    """(start, rank, stop, kind, value) of each match; found holds the whole matches, values what
    counts of them. Places are code points, stop exclusive. The text is cut once, and only where
    there is a match."""
    parts = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(parts, 1, F.size(found)), found,
                       lambda p, m: F.char_length(p) + F.char_length(m))
    spans = F.transform(
        F.arrays_zip(ends(steps).alias("stop"), found.alias("m"), values.alias("v")),
        lambda x: F.struct((x["stop"] - F.char_length(x["m"])).alias("start"),
                           F.lit(rank).alias("rank"), x["stop"].alias("stop"),
                           F.lit(kind).alias("kind"), x["v"].alias("value")))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(NONE))


SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def replaced(text: Column, pattern: str, found: Column, change) -> Column:
    """The text with every match m replaced by change(m); the rest stays as it is."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.transform(found, change),
                        lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)
