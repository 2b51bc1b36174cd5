"""Scalar expressions of the engine, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A linear congruential step that any SQL engine can repeat; its high bits are used.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31


def lcg(key: Column, seed: int = 0) -> Column:
    """A pseudo-random integer from 0 to 2**24 - 1 of a key, the same on every engine and partitioning."""
    step = lambda x: ((x % LCG_M) * LCG_A + LCG_C) % LCG_M
    value = step(key.cast("long") + F.lit(seed))
    return F.floor(value / F.lit(128)).cast("long")


def soft_shrink(x: Column, tol: float) -> Column:
    """Towards zero by ``tol``, and zero within it."""
    return F.least(x + tol, F.lit(0.0)) + F.greatest(x - tol, F.lit(0.0))


def hard_threshold(x: Column, least: Column | float) -> Column:
    return F.when(F.abs(x) < least, F.lit(0.0)).otherwise(x)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def degree_power(degree: Column, power: float, isolated_to_zero: bool = False) -> Column:
    """``degree ** power`` with the degree at least 1e-12; 0 for isolated nodes where that is asked for."""
    value = F.pow(F.greatest(degree.cast("double"), F.lit(1e-12)), F.lit(power))
    return F.when(degree == 0, F.lit(0.0)).otherwise(value) if isolated_to_zero else value
