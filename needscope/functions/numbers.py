"""Sums and averages that do not depend on the order rows arrive in.

Double addition is not associative, so a retried task or another partition
count can change the last bit of a sum and flip a rounded result. Sums here
run on decimals with nine places and return to double at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

EXACT = DecimalType(28, 9)


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(EXACT)).cast("double")


def exact_avg(value: Column) -> Column:
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def exact_stddev(value: Column) -> Column:
    """Sample deviation from exact sums of x and x²; null for fewer than two values."""
    n = F.count(value)
    spread = exact_sum(value * value) - exact_sum(value) * exact_sum(value) / F.nullif(n, F.lit(0))
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero divisor instead of failing."""
    return top / F.nullif(bottom, F.lit(0))


def count_where(test: Column) -> Column:
    """Rows on which the test is true, as a bigint, zero on empty input."""
    return F.count_if(test)


def money_cents(value: Column) -> Column:
    """Double money with two places as whole cents: exact and cheap to add."""
    return F.rint(value * 100).cast("bigint")
