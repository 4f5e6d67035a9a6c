"""Column functions over fingerprints kept as arrays of 64-bit words.

Each function is built from plain word expressions (no lambda functions), so
it stays inside generated code. Words are signed LONGs; only ``&``, ``|``,
``~``, shifts and ``bit_count`` touch them. A missing or NULL word is zero, and
words beyond the stated number are left out. The likeness of two empty
fingerprints is NULL, which no threshold accepts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Words = Sequence[Column]


def words(fingerprint: Column | str, n_bits: int) -> list[Column]:
    """The words of an array column, ``n_bits`` wide."""
    c = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return [F.coalesce(F.get(c, F.lit(i)), F.lit(0).cast("long")) for i in range((n_bits + 63) // 64)]


def literals(values: Sequence[int]) -> list[Column]:
    return [F.lit(int(v)).cast("long") for v in values]


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def popcount(w: Words) -> Column:
    return _sum([F.bit_count(x) for x in w])


def and_count(a: Words, b: Words) -> Column:
    return _sum([F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b)])


def or_count(a: Words, b: Words) -> Column:
    return _sum([F.bit_count(x.bitwiseOR(y)) for x, y in zip(a, b)])


def tanimoto(a: Words, b: Words, a_bits: Column | None = None, b_bits: Column | int | None = None) -> Column:
    """Bits in both over bits in either; with known bit counts one pass over the words is enough."""
    both = and_count(a, b)
    if a_bits is None or b_bits is None:
        return F.try_divide(both.cast("double"), or_count(a, b).cast("double"))
    return F.try_divide(both.cast("double"), (a_bits + b_bits - both).cast("double"))


def contains(target: Words, query: Words) -> Column:
    """Whether each bit of the query is set in the target."""
    return reduce(lambda a, b: a & b, [q.bitwiseAND(F.bitwise_not(t)) == 0 for t, q in zip(target, query)])


def has_bit(w: Words, bit: int) -> Column:
    return F.getbit(w[bit // 64], F.lit(bit % 64)) == 1


def segments(w: Words, k: int) -> list[Column]:
    """Bit counts of k runs of words; the last one takes what is left over."""
    step = max(1, len(w) // k)
    cuts = [w[i * step : (i + 1) * step if i < k - 1 else len(w)] for i in range(k)]
    return [popcount(c) if c else F.lit(0) for c in cuts]


def signature(w: Words, bits: Sequence[int]) -> Column:
    """The chosen bits as one number, the first one lowest."""
    return _sum([has_bit(w, b).cast("int") * (1 << i) for i, b in enumerate(bits)])


def host_words(bits: Sequence[int], n_bits: int) -> list[int]:
    """Signed words of a set of bit numbers."""
    out = [0] * ((n_bits + 63) // 64)
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def host_bits(values: Sequence[int | None], n_bits: int) -> list[int]:
    """Bit numbers set in signed words."""
    return [i * 64 + j for i, v in enumerate(list(values)[: (n_bits + 63) // 64]) for j in range(64) if ((v or 0) >> j) & 1]
