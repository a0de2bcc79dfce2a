"""Distance of term hashes by bit operations, within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every second bit: the lower bit of each two-bit cell.
LOW = 0x5555555555555555
PARTS = ("check", "c0", "c1", "c2", "c3")


def hash_parts(digest: Column) -> list[Column]:
    """The checksum digits and the 128 cells as four longs, named PARTS."""
    word = lambda k: F.conv(F.substring(digest, 7 + 16 * k, 16), 16, -10).cast("long").alias(f"c{k}")
    return [F.substring(digest, 1, 2).alias("check"), *map(word, range(4))]


def _planes(word: Column) -> tuple[Column, Column, Column]:
    """For t = 1, 2, 3: which cells are t or more."""
    high, low = F.shiftrightunsigned(word, 1).bitwiseAND(F.lit(LOW)), word.bitwiseAND(F.lit(LOW))
    return high.bitwiseOR(low), high, high.bitwiseAND(low)


def cell_distance(a: Column, b: Column) -> Column:
    """Sum over 32 cells of their difference, 3 counting as 6."""
    x1, x2, x3 = (p.bitwiseXOR(q) for p, q in zip(_planes(a), _planes(b), strict=True))
    return F.bit_count(x1) + F.bit_count(x2) + F.bit_count(x3) + 3 * F.bit_count(x1.bitwiseAND(x2).bitwiseAND(x3))


def parts_distance(a: str, b: str) -> Column:
    """Distance of two hashes given as columns PARTS under the prefixes a and b (such as "q_" and "")."""
    total = (F.col(f"{a}check") != F.col(f"{b}check")).cast("int")
    for k in range(4):
        total = total + cell_distance(F.col(f"{a}c{k}"), F.col(f"{b}c{k}"))
    return total


def circular(x: Column, y: Column, around: int) -> Column:
    """The shorter way from x to y on a ring of so many places."""
    d = F.abs(x - y)
    return F.least(d, around - d)


def digest_distance(a: Column, b: Column, header: bool = False, length: bool = False) -> Column:
    """Distance of two 70-digit hashes: 1 if the checksums differ, and the cells.

    header=True also compares the quartile ratios, length=True the lengths: the published distance. Both are left out by
    default, as an index never counts them.
    """
    pa, pb = hash_parts(a), hash_parts(b)
    total = (pa[0] != pb[0]).cast("int")
    for x, y in zip(pa[1:], pb[1:], strict=True):
        total = total + cell_distance(x, y)
    digit = lambda h, i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    if header:
        for i in (5, 6):
            d = circular(digit(a, i), digit(b, i), 16)
            total = total + F.when(d <= 1, d).otherwise((d - 1) * 12)
    if length:
        d = circular(digit(a, 4) * 16 + digit(a, 3), digit(b, 4) * 16 + digit(b, 3), 256)
        total = total + F.when(d <= 1, d).otherwise(d * 12)
    return total
