"""Ratios, averages, rounding and the order of rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of what has no first value to compare with.
NEW = 1.7976931348623157e308


def pct(part: Column, whole: Column) -> Column:
    """Percentage of a positive whole, else 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(0.0)


def per_profile(total: Column, profiles: Column) -> Column:
    """The mean over profiles, of which there is one at least."""
    return total.cast("double") / F.greatest(profiles, F.lit(1)).cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, of the value shifted by ``digits`` and then back."""
    shift = float(10**digits)
    return F.round(value * shift) / shift


def delta(first: Column, last: Column) -> Column:
    return last - first


def delta_pct(first: Column, last: Column) -> Column:
    """Change relative to the first value, 0 without one."""
    return F.when(first != 0, (last - first) / F.abs(first) * 100).otherwise(0.0)


def sort_key(values: Column, mode: str) -> Column:
    """What rows are ranked by, downwards: ``values`` are a row's cells by group."""
    first, last = F.element_at(values, 1), F.element_at(values, -1)
    if mode == "delta":
        return delta(first, last)
    if mode == "deltaPct":
        change = F.when((first == 0) & (last > 0), NEW).otherwise(delta_pct(first, last))
        return F.when(F.size(values) < 2, 0.0).otherwise(change)
    return F.greatest(F.lit(0.0), F.array_max(values))


def iso_time(ts: Column) -> Column:
    """RFC 3339 in UTC to the second, empty for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
