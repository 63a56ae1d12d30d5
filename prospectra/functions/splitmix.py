"""SplitMix64 (Steele, Lea and Flood 2014) as Column expressions: random numbers by counter, bit for bit those of 64-bit unsigned arithmetic.

Spark has no multiplication that wraps under ANSI rules, so products are made of 16-bit limbs, none of which overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The increment and the multipliers of SplitMix64.
GAMMA = 0x9E3779B97F4A7C15
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_mix(z: int) -> int:
    z = ((z ^ (z >> 30)) * M1) & _MASK
    z = ((z ^ (z >> 27)) * M2) & _MASK
    return z ^ (z >> 31)


def key_of(*parts: int) -> int:
    """A stream's key from its parts, e.g. a seed and a cycle."""
    key = 0
    for p in parts:
        key = plain_mix((key + ((p & _MASK) ^ GAMMA)) & _MASK)
    return key


def bound(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def add(x: Column, c: int) -> Column:
    """x + c modulo 2**64."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(c & 0xFFFFFFFF)
    high = F.shiftrightunsigned(x, 32) + F.lit((c & _MASK) >> 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def multiply(x: Column, c: int) -> Column:
    """x * c modulo 2**64."""
    limbs = [(c >> (16 * i)) & 0xFFFF for i in range(4)]
    part = lambda v, i: F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(0xFFFF))

    def sums(v: Column) -> Column:
        return F.array(*(sum((part(v, j) * F.lit(limbs[i - j]) for j in range(1, i + 1)), part(v, 0) * F.lit(limbs[i])) for i in range(4)))

    def carried(s: Column) -> Column:
        step = lambda a, r: F.struct((a["carry"] + r).bitwiseAND(F.lit(0xFFFF)).alias("x"), F.shiftrightunsigned(a["carry"] + r, 16).alias("carry"), F.concat(a["all"], F.array((a["carry"] + r).bitwiseAND(F.lit(0xFFFF)))).alias("all"))
        start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(s, start, step, lambda a: a["all"])

    joined = lambda p: F.get(p, 0).bitwiseOR(F.shiftleft(F.get(p, 1), 16)).bitwiseOR(F.shiftleft(F.get(p, 2), 32)).bitwiseOR(F.shiftleft(F.get(p, 3), 48))
    return bound(bound(bound(x, sums), carried), joined)


def mix(x: Column) -> Column:
    one = bound(x, lambda z: multiply(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), M1))
    two = bound(one, lambda z: multiply(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), M2))
    return bound(two, lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def uniform(index: Column, *parts: int) -> Column:
    """In [0, 1): the number at a place of the stream of the parts, the same for any partitioning."""
    return F.shiftrightunsigned(mix(add(index.cast("bigint"), key_of(*parts))), 11).cast("double") * F.lit(2.0**-53)


def mix_sql(z: str) -> str:
    """The finaliser for DuckDB, of an expression of type UHUGEINT below 2**64."""
    step = lambda x, s, m: f"((xor({x}, ({x} >> {s})) * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"(SELECT xor(c, c >> 31) FROM (SELECT {step('b', 27, M2)} AS c FROM (SELECT {step('a', 30, M1)} AS b FROM (SELECT {z} AS a))))"


def uniform_sql(index: str, *parts: int) -> str:
    return f"(({mix_sql(f'(({index})::UHUGEINT + {key_of(*parts)}::UHUGEINT) % 18446744073709551616::UHUGEINT')} >> 11)::DOUBLE * {2.0**-53!r})"
