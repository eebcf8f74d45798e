"""Arrays and long texts inside a row, in time that grows with their length alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold copies at once, and characters of a block of text.
WIDTH, BLOCK = 64, 4096


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def chunks(values: Column) -> Column:
    """Consecutive slices of an array, about as many as elements in each."""
    width = F.greatest(F.lit(WIDTH), F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"))
    return F.when(F.size(values) == 0, F.array(values)).otherwise(bound(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(values), w), lambda i: F.slice(values, i, w))))


def starts(lengths: Column, first: int = 0) -> Column:
    """Where each of consecutive pieces begins: `first` and the lengths before it. Appending to an array copies it, so sums are folded in chunks and over them."""

    def fold(xs: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def both(parts: Column) -> Column:
        sums = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, fold(sums, F.lit(first)), fold))

    return bound(lengths, lambda x: bound(chunks(x), both))


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The text in pieces of `size` characters. A place in a string is found by walking from its start, so pieces are cut from pieces of WIDTH times the size."""

    def cut(t: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / n).cast("int")), lambda i: F.substring(t, i * n + 1, F.lit(n)))

    return bound(text, lambda t: F.when(F.length(t) <= size, F.array(t)).otherwise(F.flatten(F.transform(cut(t, size * WIDTH), lambda x: cut(x, size)))))


def piece(parts: Column, start: Column, length: Column, size: int = BLOCK) -> Column:
    """`length` characters from `start`, counted from 0, of a text in blocks()."""
    lo = F.floor(start / size).cast("int")
    n = F.floor((start + F.greatest(length, F.lit(1)) - 1) / size).cast("int") - lo + 1
    return F.substring(F.array_join(F.slice(parts, lo + 1, n), ""), (start - lo * size + 1).cast("int"), length.cast("int"))
