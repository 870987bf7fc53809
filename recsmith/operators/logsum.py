"""Mergeable log-sum-exp: a running maximum and scaled sum as plain partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the value bands that are summed apart: e**256 times any count stays far inside a double.
BAND = 256.0


def log_sum_exp(df: DataFrame, keys, value: str | Column, name: str = "lse") -> DataFrame:
    """``keys, name`` with ``ln(sum(exp(value)))`` of each group.

    Values are summed by bands of width ``BAND``, each scaled by its band's lower end, so a
    partial sum neither over- nor underflows whatever its size, partial sums add up in any order
    (Spark combines them before the shuffle) and no task sees a group whole.  The few bands of a
    group are then scaled to its highest one.  Nulls do not count; a group of nulls gives null, one
    whose values are all minus infinity gives that, and one with an infinity gives infinity.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    band, scaled, top, held = _apart(keys, ["_band", "_scaled", "_top", "_held"])
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    endless = F.lit(float("inf"))
    finite = lambda c: F.abs(c) < endless
    # an infinite value is a band of its own: its place decides, its sum does not matter
    rows = df.select(*keys, v.alias(scaled)).withColumn(band, F.when(finite(F.col(scaled)), F.floor(F.col(scaled) / BAND).cast("double")).otherwise(F.col(scaled)))
    part = F.when(finite(F.col(scaled)), F.exp(F.col(scaled) - F.col(band) * BAND))
    bands = rows.groupBy(*keys, band).agg(F.sum(part).alias(scaled))
    # at most a handful of bands: one for each 256 of the values' range
    tops = bands.groupBy(*keys).agg(F.max(band).alias(top), F.collect_list(F.struct(band, scaled)).alias(held))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.coalesce(F.when(finite(x[band]), x[scaled] * F.exp((x[band] - F.col(top)) * BAND)), F.lit(0.0)))
    return tops.select(*keys, F.when(finite(F.col(top)), F.col(top) * BAND + F.log(total)).otherwise(F.col(top)).alias(name))


def _apart(keys: list[str], names: list[str]) -> list[str]:
    """Column names that no key has (Spark does not tell upper from lower case)."""
    taken = {k.lower() for k in keys}
    fresh = []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        fresh.append(n)
    return fresh
