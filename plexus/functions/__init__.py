"""Column expressions that Spark has no function for: one row in, one value out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the second string up to which a common subsequence is counted in one word of bits.
WORD = 62


def synth_weight(u: Column, v: Column) -> Column:
    """Deterministic weight of an edge without one: 32-bit mix of its ends, from 1.00 to 100.00.

    Fixed values: the two multipliers, the shift, the modulus and the offset.
    """
    low = F.lit(0xFFFFFFFF)
    product = lambda c, m: (c.bitwiseAND(low) * F.lit(m)).bitwiseAND(low)
    h = product(u.cast("long"), 2654435761).bitwiseXOR(product(v.cast("long"), 2246822519))
    h = h.bitwiseXOR(F.shiftright(h, 16))
    return (h % 9901 + 100) / F.lit(100.0)


def knapsack(items: Column, capacity: int) -> Column:
    """Best value of a 0-1 knapsack over an array of ``(w, v)`` structs, for one row.

    The state is the best value for every capacity up to the limit.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), capacity + 1)

    def take(best: Column, item: Column) -> Column:
        with_item = lambda b, c: F.when(
            c >= item["w"], F.greatest(b, F.get(best, (c - item["w"]).cast("int")) + item["v"])
        ).otherwise(b)
        return F.transform(best, with_item)

    return F.element_at(F.aggregate(items, zeros, take), -1)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two strings, for one row.

    Up to ``WORD`` characters of ``y`` a row of the table is a word whose zero bits are its rises, and
    a character of ``x`` costs one addition; longer strings keep the row as an array.
    """
    ys, n = _characters(y), F.length(y)
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, n) - one

    def place(c: Column) -> Column:
        bits = F.transform(ys, lambda s, i: F.when(s == c, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    def fold(row: Column, at: Column) -> Column:
        return (row + row.bitwiseAND(at)).bitwiseOR(row.bitwiseAND(F.bitwise_not(at))).bitwiseAND(full)

    rises = F.aggregate(F.transform(_characters(x), place), full, fold)
    return F.when(n <= WORD, n - F.bit_count(rises)).otherwise(_long_lcs(x, ys, n))


def _long_lcs(x: Column, ys: Column, n: Column) -> Column:
    start = F.array_repeat(F.lit(0), n + 1)

    def row(best: Column, c: Column) -> Column:
        # state: the new row so far; best[j] is the old row
        return F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda made, j: F.concat(made, F.array(F.when(
                F.get(ys, j - 1) == c, F.get(best, j - 1) + 1
            ).otherwise(F.greatest(F.get(best, j), F.get(made, j - 1))))),
        )

    return F.element_at(F.aggregate(_characters(x), start, row), -1)
