"""Column expressions for money and ratios.

Adding doubles gives a different last digit for every task order. Amounts here
carry two decimals, so they are summed as whole cents in a ``bigint`` — exact in
any order, and a plain long addition inside generated code — and turned into a
double once, after the aggregate. Nothing is cut on the way: a value that is no
whole number of units, NaN or infinity raises and says so; pass a larger scale
for such columns. In ANSI mode an overflow raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(name: str | Column, scale: int = 2) -> Column:
    """A double as a whole number of ``10**-scale`` units (cents by default), NULL kept.

    Raises for a value between two units; only the error of its binary form is let through.
    """
    value = F.col(name) if isinstance(name, str) else name
    scaled = value.cast("double") * F.lit(float(10**scale))
    units = F.floor(scaled + F.lit(0.5))
    fits = F.abs(scaled - F.floor(scaled + F.lit(0.5))) <= F.lit(1e-6) + F.abs(scaled) * F.lit(1e-15)
    finite = F.abs(scaled) < F.lit(9.2e18)
    problem = F.concat(value.cast("string"), F.lit(f" is not a whole number of 10^-{scale}; sum it with a larger scale"))
    return F.when(value.isNull(), F.lit(None).cast("bigint")).when(finite & fits, units).otherwise(
        F.raise_error(problem).cast("bigint")
    )


def nearest(value: Column, scale: int = 2) -> Column:
    """The nearest whole number of units, half upwards; for values that are meant to be rounded."""
    return F.floor(value * F.lit(float(10**scale)) + F.lit(0.5))


def from_fixed(units: Column, scale: int = 2) -> Column:
    return units.cast("double") / F.lit(float(10**scale))


def total_of(name: str | Column, scale: int = 2) -> Column:
    """Exact SUM, as a double."""
    return from_fixed(F.sum(fixed(name, scale)), scale)


def mean_of(name: str | Column, scale: int = 2) -> Column:
    """Exact-sum AVG: NULLs count neither in the sum nor in the divisor."""
    value = F.col(name) if isinstance(name, str) else name
    return total_of(value, scale) / F.nullif(F.count(value), F.lit(0))


def over(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator instead of an ANSI error."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return over(numerator, denominator) * F.lit(100.0)


def round2(value: Column) -> Column:
    """ROUND(x, 2) on a decimal, half away from zero.

    Rounding a double depends on its shortest decimal form (1.005); a decimal
    with eight places rounds the same way everywhere.
    """
    return F.round(value.cast("decimal(28,8)"), 2).cast("double")
