"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """13 to 19 digits that pass Luhn."""
    d = digits(text)
    n = F.length(d)

    def worth(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _dihedral() -> tuple[list[list[int]], list[list[int]]]:
    """The multiplication table of the dihedral group of order ten, and the eight powers of the digit permutation."""
    mul = [[((a + b) % 5 if b < 5 else (a + b - 5) % 5 + 5) if a < 5 else ((a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5) for b in range(10)] for a in range(10)]
    #: The permutation's first power.
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([powers[-1][x] for x in first])
    return mul, powers


def verhoeff(text: Column) -> Column:
    """Exactly 12 digits, the first neither 0 nor 1, that pass Verhoeff."""
    mul, powers = _dihedral()
    d = digits(text)
    m, p = F.lit([x for row in mul for x in row]), F.lit([x for row in powers for x in row])
    digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    check = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: F.get(m, c * 10 + F.get(p, (i % 8) * 10 + digit(i))))
    return F.when((F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1"), check == 0).otherwise(False)
