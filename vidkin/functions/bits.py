"""Hamming distance on packed hashes (arrays of 64-bit words)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(bits: int) -> int:
    return -(-bits // 64)


def hamming(a: Column, b: Column, bits: int) -> Column:
    """Differing bits; unrolled over the words, so it stays in generated code."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(words(bits))])


def distance(a: Column, b: Column, bits: int) -> Column:
    """hamming / bits as FLOAT."""
    return (hamming(a, b, bits) / F.lit(float(bits))).cast("float")


def f32(value: float) -> Column:
    return F.lit(value).cast("float")
