"""Numeric column helpers shared by every score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def py_round(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value.

    ``F.round`` and ``F.bround`` decide ties on the shortest decimal text of a double, so
    2.675 goes up although the stored value is below the tie. Here the product
    ``x * 10**digits`` is held as a head and an exact remainder (a Dekker product; powers of
    ten up to 1e6 are exact), and the remainder decides the tie.
    """
    return round_at(x, F.lit(float(10**digits)))


def round_at(x: Column, scale: Column) -> Column:
    """:func:`py_round` with a power of ten, at most 1e9, for the digits."""
    head = x * F.lit(134217729.0)
    hi = head - (head - x)
    lo = x - hi
    product = x * scale
    err = (hi * scale - product) + lo * scale
    low = F.floor(product).cast("double")
    over = (product - low) - F.lit(0.5) + err
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return F.when(x.isNotNull(), (low + F.when(up, 1.0).otherwise(0.0)) / scale)


def with_rounded(df: DataFrame, columns: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds columns rounded by :func:`py_round`, each value computed once.

    The rounding mentions its argument many times; a column of its own in between keeps the
    optimizer from copying a long expression into every mention.
    """
    raw = df.withColumns({f"_raw_{n}": x for n, (x, _) in columns.items()})
    out = raw.withColumns({n: py_round(F.col(f"_raw_{n}"), d) for n, (_, d) in columns.items()})
    return out.drop(*[f"_raw_{n}" for n in columns])


def clamp(lo: float, hi: float, x: Column) -> Column:
    """``x`` held within [lo, hi]; null stays null (greatest/least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def truthy(x: Column) -> Column:
    """Null for 0 and NaN-free null for null: a value that counts as missing when zero."""
    return F.nullif(x, F.lit(0.0))


def clean_number(x: Column) -> Column:
    """Text to double: strips blanks and thousands commas; '-', blank and junk are null."""
    return F.regexp_replace(F.trim(x), ",", "").try_cast("double")


def decay(age_days: Column, half_life: float) -> Column:
    """Half-life decay of an age in days, never above one."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / F.lit(half_life))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def scale_percent(x: Column) -> Column:
    """Shareholding percent: fractions up to 1 become percent, larger values are percent."""
    return F.when(x <= 1.0, py_round(x * 100.0, 2)).otherwise(py_round(x, 2))


def within_tolerance(ours: Column, theirs: Column, pct: float, absolute: float) -> Column:
    return F.abs(ours - theirs) <= F.greatest(F.abs(theirs) * pct, F.lit(absolute))
