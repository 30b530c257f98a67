"""Column helpers for operators made of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block of the two-level prefix sum over a text's matches.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column, zero=0) -> Column:
    return F.aggregate(numbers, F.lit(zero), lambda a, x: a + x)


def starts(gaps: Column, lengths: Column) -> Column:
    """Start of every match, given the lengths of the gaps before and of the matches.

    Prefix sums in two levels, so the work stays near linear in the matches.
    """
    def in_blocks(steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))

        def within(sums: Column) -> Column:
            def offsets(before: Column) -> Column:
                return F.transform(gaps, lambda g, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + g + total(
                    F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))
            return let(F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), offsets)
        return let(F.transform(blocks, lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))), within)
    return let(F.zip_with(gaps, lengths, lambda g, n: g + n), in_blocks)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, text) of the leftmost non-overlapping matches, in code points.

    ``pattern`` must not match the empty string.
    """
    none = F.array().cast("array<struct<start:int,text:string>>")

    def located(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        at = starts(gaps, F.transform(found, F.length))
        pairs = F.zip_with(at, found, lambda s, m: F.struct(s.alias("start"), m.alias("text")))
        return F.when(F.size(found) == 0, none).otherwise(pairs.cast("array<struct<start:int,text:string>>"))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
