"""Exact sums of doubles that do not depend on the order of their rows.

A finite double is an integer of at most 56 bits times a power of two. Powers
fall into bins of 32; within a bin, integers add up exactly as decimals, in any
order, by partial aggregation. A sum is then at most 67 (bin, amount) pairs,
whatever its rows, which are carried into one long hexadecimal number and
rounded once, to the nearest double (ties to even), as ``math.fsum`` does.

Use: aggregate ``amount(x)`` and ``odd(x)`` by ``sum`` per group and ``bin_of(x)``,
then a group's pairs by ``rounded``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32  # exponents per bin
LIMB = 1 << BITS
AMOUNT = "decimal(38,0)"  # 29 digits per row leave room for 10^9 rows a group and bin
PAIRS = f"array<struct<bin:int,amount:{AMOUNT}>>"


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & (x != 0)


def _lowest(x: Column) -> Column:
    """An exponent q such that x * 2^-q is an integer of at most 56 bits."""
    return (F.floor(F.log2(F.abs(x))) - 54).cast("int")  # one more or less does not matter


def bin_of(x: Column) -> Column:
    """The bin of a double (0 for zero, NULL for what is not finite)."""
    return F.when(_finite(x), F.floor(_lowest(x) / BITS).cast("int")).when(x == 0, F.lit(0))


def amount(x: Column) -> Column:
    """A double in units of 2^(32 bin)."""
    q = _lowest(x)
    half = F.floor(-q / 2).cast("int")  # in two steps, so that no power overflows
    whole = (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -q - half)).cast("long").cast("decimal(18,0)")
    shift = F.pow(F.lit(2.0), q - BITS * F.floor(q / BITS)).cast("long").cast("decimal(10,0)")
    return F.when(_finite(x), (whole * shift).cast(AMOUNT)).when(x == 0, F.lit(0).cast(AMOUNT))


def odd(x: Column) -> Column:
    """NaN and infinities, whose sum is the same in any order; NULL for the rest."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)


def rounded(pairs: str, odd: str) -> Column:
    """The double nearest to the sum of a column of (bin, amount) pairs, each
    bin once; ``odd``, if not NULL, is the sum instead. No pairs: NULL."""
    first, last = f"array_min(transform({pairs}, x -> x.bin))", f"array_max(transform({pairs}, x -> x.bin))"

    def carried(sign: str) -> str:
        """(carry, digits) of the sum in limbs of 32 bits from the lowest bin to
        four beyond the highest: a carry of -1 tells a negative sum."""
        found = f"element_at(filter({pairs}, x -> x.bin = b), 1).amount"
        total = f"s.carry + {sign}coalesce(try_{found}, 0)"
        low = f"pmod(t, {LIMB}BD)"
        up = f"cast((t - {low}) / {LIMB}BD as {AMOUNT})"
        step = f"element_at(transform(array(cast({total} as {AMOUNT})), t -> named_struct('carry', {up}, 'digits', concat(lpad(hex(cast({low} as bigint)), {BITS // 4}, '0'), s.digits))), 1)"
        return f"aggregate(sequence({first}, {last} + 4), named_struct('carry', cast(0 as {AMOUNT}), 'digits', ''), (s, b) -> {step})"

    number = f"element_at(transform(array({carried('')}), p -> if(p.carry < 0, concat('-0x', {carried('-')}.digits), concat('0x', p.digits))), 1)"
    exact = f"cast(concat({number}, 'p', cast({BITS} * {first} as string)) as double)"
    return F.expr(f"CASE WHEN {odd} IS NOT NULL THEN {odd} WHEN size({pairs}) > 0 THEN {exact} END")
