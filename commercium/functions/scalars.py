"""Column expressions shared by the jobs.  All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def quarter_start(date: Column) -> Column:
    """First day of the calendar quarter, as a DATE."""
    return F.trunc(date, "quarter")


def quarter_label(date: Column) -> Column:
    """Period label such as ``2024Q1``."""
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator (ANSI division raises)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL, which greatest/least alone would lose."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


#: Doubles below this size are summed exactly; their whole part fits decimal(28, 12).
EXACT_BELOW = 1e15


def exact_sum(value: Column | str, over: WindowSpec | None = None) -> Column:
    """Sum that does not depend on the order or partitions of the rows.

    Every value is taken at 12 decimals, half away from zero, and summed as a decimal,
    so the only error left is that of the last cast to double.  A group with a value
    from 1e15 on, an infinity or NaN is summed in floating point, where twelve decimals
    mean nothing.  No values give NULL; a sum past 1e26 raises.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    small = F.abs(number) < EXACT_BELOW
    large, exact, plain = (
        part if over is None else part.over(over)
        for part in (F.max(~small), F.sum(F.when(small, number).cast("decimal(28,12)")), F.sum(number))
    )
    return F.when(large, plain).otherwise(exact.cast("double"))


def exact_mean(value: Column | str) -> Column:
    """Mean over the values that are not NULL, from a sum that does not depend on order."""
    number = F.col(value) if isinstance(value, str) else value
    return ratio(exact_sum(number), F.count(number))


def sum_parts(value: Column, name: str) -> list[Column]:
    """Aggregates ``name_exact``, ``_plain``, ``_large`` and ``_count`` that can be grouped again.

    ``sum_of_parts`` and ``mean_of_parts`` over them equal ``exact_sum`` and ``exact_mean``
    over the values themselves, bit for bit as long as the exact part counts.
    """
    number = value.cast("double")
    small = F.abs(number) < EXACT_BELOW
    return [
        F.sum(F.when(small, number).cast("decimal(28,12)")).alias(f"{name}_exact"),
        F.sum(number).alias(f"{name}_plain"),
        F.max(~small).alias(f"{name}_large"),
        F.count(number).alias(f"{name}_count"),
    ]


def sum_of_parts(name: str) -> Column:
    exact, plain = F.sum(f"{name}_exact").cast("double"), F.sum(f"{name}_plain")
    return F.when(F.max(f"{name}_large"), plain).otherwise(exact)


def mean_of_parts(name: str) -> Column:
    return ratio(sum_of_parts(name), F.sum(f"{name}_count"))


def round_half_up(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, as SQL NUMERIC does.

    The value is first taken at 15 significant digits, as a cast to NUMERIC takes
    it, which removes binary noise such as 1.00499999999999989.  Sums that are rounded
    come from ``exact_sum``, as the order of a plain one can show in the last digits.
    Values from 1e15, infinities and NaN have no places to round and stay as they are.

    Digits are only written out near a half: elsewhere neither the 15 digits nor the
    multiplication can move a value over one, and a whole number divided by a power of
    ten is the double next to that decimal.
    """
    number = value.cast("double")
    if not 0 <= digits <= _PLAIN_DIGITS:
        return _round_written(number, digits)
    scale = float(10**digits)
    scaled = number * F.lit(scale)
    nearest = F.rint(scaled)
    plain = (F.abs(scaled) < _PLAIN_BELOW) & (F.abs(scaled - nearest) < 0.5 - _NEAR_HALF)
    # Adding zero turns -0.0 into 0.0, as a decimal has one zero.
    # Inside an array function, which is evaluated and not generated, the rare way does not
    # make the code of a wide projection too long to be compiled.
    written = F.transform(F.array(number), lambda x: _round_written(x, digits))[0]
    return F.when(plain, (nearest + F.lit(0.0)) / F.lit(scale)).otherwise(written)


#: Scaled values below 1e10 are off by less than 1e-4 at 15 significant digits.
_PLAIN_BELOW, _NEAR_HALF, _PLAIN_DIGITS = 1e10, 1e-3, 12


def _round_written(number: Column, digits: int) -> Column:
    """``round_half_up`` on the digits of the value, written out and read as a decimal."""
    decimal = F.format_string("%.14e", number).try_cast("decimal(38,20)")
    return F.when(F.abs(number) >= 1e15, number).otherwise(F.round(decimal, digits).cast("double"))


def round_half_even(value: Column, digits: int) -> Column:
    """Round half to even in binary floating point, as data-frame libraries do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def percent_label(value: Column) -> Column:
    """Signed whole percent for display, such as ``+5%``."""
    return F.format_string("%+.0f%%", value)


def amount_label(value: Column) -> Column:
    """Amount with thousands separators and two decimals for display."""
    return F.format_number(value, 2)


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds; 0 for an empty group, never NULL."""
    return F.count(F.when(condition, F.lit(1)))


def null_safe_equal(left, right, columns) -> Column:
    """Join condition on equally named columns under which NULL matches NULL."""
    return reduce(
        lambda acc, nxt: acc & nxt,
        [left[c].eqNullSafe(right[c]) for c in columns],
        F.lit(True),
    )
