"""Conjunctions of literals as two masks: ``care`` has the bits that are fixed, ``val`` their values.

With up to 62 features a mask is a long; with more it is an array of longs of 62 bits
each, the first features in the first.  ``wide`` tells which.  In Python a mask is a whole number of
any size; ``number`` and ``stored_form`` go between the two.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word, and so the features up to which a mask is a long.
MOST_FEATURES = WORD = 62


def wide(features: int) -> bool:
    return features > WORD


def sql_type(features: int) -> str:
    return "array<long>" if wide(features) else "long"


def words(features: int) -> int:
    return -(-features // WORD)


def bit(k: int) -> int:
    return 1 << k


def _word(columns: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        out = out + F.when(c, F.lit(bit(k))).otherwise(F.lit(0)).cast("long")
    return out


def pack(columns: list[Column]) -> Column:
    """Boolean columns as bits, the first lowest; null counts as false."""
    if not wide(len(columns)):
        return _word(columns)
    return F.array(*[_word(columns[i : i + WORD]) for i in range(0, len(columns), WORD)])


def number(mask) -> int:
    """A mask of either form, as a whole number."""
    return mask if isinstance(mask, int) else sum(w << (WORD * i) for i, w in enumerate(mask))


def stored_form(mask: int, features: int):
    """What a column of masks holds for a whole number."""
    return [mask >> (WORD * i) & (bit(WORD) - 1) for i in range(words(features))] if wide(features) else mask


def is_set(mask: Column, k: Column | int, wide: bool = False) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    if wide:
        mask, k = F.get(mask, (k / WORD).cast("int")), k % WORD
    return F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1


def plus(mask: str, k: str, wide: bool = False) -> Column:
    """Column ``mask`` with the bit that column ``k`` names, which it doesn't have."""
    if not wide:
        return F.expr(f"{mask} + shiftleft(1L, {k})")
    return F.expr(f"transform({mask}, (w, i) -> if(i = cast({k} / {WORD} AS int), w + shiftleft(1L, {k} % {WORD}), w))")


def literals(care: Column, wide: bool = False) -> Column:
    return F.aggregate(care, F.lit(0), lambda n, w: n + F.bit_count(w)) if wide else F.bit_count(care)


def of_bits(places: Column, features: int) -> Column:
    """The mask whose bits are the elements of an array of whole numbers."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, k: acc + one(k % WORD))
    of_word = lambda i: F.filter(places, lambda k: (k / WORD).cast("int") == i)
    return F.array(*[add(of_word(i)) for i in range(words(features))]) if wide(features) else add(places)


def care_masks(features: int, most: int) -> list[int]:
    """All sets of at most ``most`` features."""
    return [sum(bit(k) for k in ks) for n in range(most + 1) for ks in combinations(range(features), n)]


def sets_bound(features: int, most: int) -> int:
    """How many sets of at most ``most`` features there are."""
    return sum(comb(features, k) for k in range(most + 1))


def cells_bound(features: int, most: int) -> int:
    """Most cells that sets of at most ``most`` literals can have."""
    return sum(comb(features, k) * 2**k for k in range(most + 1))


def describe(care: int, val: int, names: list[str]) -> str:
    return " AND ".join(("" if val >> k & 1 else "NOT ") + names[k] for k in range(len(names)) if care >> k & 1) or "TRUE"
