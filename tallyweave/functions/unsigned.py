"""Unsigned 64-bit values in signed columns: the bit pattern is kept, comparisons and sums are unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLIP = -(2**63)
#: Sums are taken over limbs of 22, 22 and 20 bits: none passes 2^63 below 2^41 rows.
_LIMB = 22
_MASK = (1 << _LIMB) - 1


def to_signed(value: int) -> int:
    """The signed value with the bits of an unsigned one."""
    return value - 2**64 if value >= 2**63 else value


def from_signed(value: int) -> int:
    return value + 2**64 if value < 0 else value


def ordered(column: Column) -> Column:
    """A signed column in the order of the unsigned values: the sign bit is flipped."""
    return column.bitwiseXOR(F.lit(_FLIP))


unordered = ordered  # its own inverse


def compare(column: Column, op: str, constant: int, unsigned: bool) -> Column:
    """``column op constant``. Signed mode holds values below 2^63 only and keeps the comparison plain, so that
    scans can push it down; a larger constant then decides alone."""
    if op == "=" and (unsigned or constant < 2**63):
        return column == F.lit(to_signed(constant))
    if unsigned:
        left, right = ordered(column), F.lit(to_signed(constant ^ 2**63))
        return left < right if op == "<" else left > right
    if constant >= 2**63:
        return F.lit(op == "<")
    return column < F.lit(constant) if op == "<" else column > F.lit(constant)


def wrapping_product(factors: list[Column]) -> Column:
    """Product mod 2^64 as decimal(20, 0): the first factor of any size, the others counts below 10^18."""
    out = F.pmod(factors[0].cast("decimal(38,0)"), _modulus())
    for factor in factors[1:]:
        out = F.pmod((out.cast("decimal(20,0)") * factor.cast("decimal(18,0)")).cast("decimal(38,0)"), _modulus())
    return out.cast("decimal(20,0)")


def wrapping_sum_of_decimals(column: Column) -> Column:
    """Sum mod 2^64 of decimals below 2^64, as decimal(20, 0); null without rows. Exact below 5 * 10^18 rows."""
    return F.pmod(F.sum(column.cast("decimal(28,0)")), _modulus()).cast("decimal(20,0)")


def _modulus() -> Column:
    return F.lit(str(2**64)).cast("decimal(38,0)")


def wrapping_sum(column: Column) -> Column:
    """Sum mod 2^64 as decimal(20, 0); null without rows. Three long sums, so it stays a plain partial aggregation."""
    low = F.sum(column.bitwiseAND(F.lit(_MASK)))
    mid = F.sum(F.shiftrightunsigned(column, _LIMB).bitwiseAND(F.lit(_MASK)))
    high = F.sum(F.shiftrightunsigned(column, 2 * _LIMB))
    wide = lambda c, power: c.cast("decimal(38,0)") * F.lit(str(2**power)).cast("decimal(20,0)")
    total = low.cast("decimal(38,0)") + wide(mid, _LIMB).cast("decimal(38,0)") + wide(high, 2 * _LIMB).cast("decimal(38,0)")
    return F.pmod(total, F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")
