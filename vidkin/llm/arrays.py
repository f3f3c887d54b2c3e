"""Array expressions whose work grows in proportion to the array (appending in a fold copies it at each step)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of an inner fold, and code points of a chunk of text.
FOLD, CHUNK = 256, 1024


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each entry of an int array the sum (or other associative merge, from 0) of those before it."""

    def fold(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda k: fold(F.slice(v, k * FOLD + 1, F.lit(FOLD))))
        joined = lambda b: F.zip_with(b, fold(F.transform(b, lambda x: x["at"]))["out"], lambda x, before: F.transform(x["out"], lambda y: merge(before, y)))
        return F.when(F.size(v) > 0, F.flatten(let(blocks, joined))).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def chunks(text: Column) -> Column:
    """text cut every CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of the text that chunks cut, without reading from its beginning."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    first = F.coalesce(F.get(cut, i), F.lit(""))
    over = F.concat(
        first.substr(start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.get(cut, j), F.lit("")).substr(F.lit(1), end % CHUNK)
    )
    return F.when(i == j, first.substr(start % CHUNK + 1, end - start)).otherwise(over)
