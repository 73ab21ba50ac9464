"""Samples against a timeline of context changes: running clocks and an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clocked(samples: DataFrame, start: str = "start_us", delta: str = "delta", by: tuple[str, ...] = ("profile_id",), order: str = "i") -> DataFrame:
    """``samples`` with ``at``: the start plus the deltas up to and with the sample's own."""
    return samples.withColumn("at", F.col(start) + F.sum(delta).over(W.partitionBy(*by).orderBy(order)))


def asof(samples: DataFrame, changes: DataFrame, value: str, at: str = "at", by: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """``samples`` with ``value`` of the last change at or before their time, null before the first.

    One window over both tables: no join on ranges, one shuffle by ``by``.
    """
    names = samples.columns
    s = samples.select(F.struct(*names).alias("row"), F.col(at).alias("t"), *[F.col(b).alias(f"_{b}") for b in by], F.lit(1).alias("kind"), F.lit(None).cast(changes.schema[value].dataType).alias("v"))
    c = changes.select(F.lit(None).cast(s.schema["row"].dataType).alias("row"), F.col(at).alias("t"), *[F.col(b).alias(f"_{b}") for b in by], F.lit(0).alias("kind"), F.col(value).alias("v"))
    seen = W.partitionBy(*[f"_{b}" for b in by]).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = s.unionByName(c).withColumn("v", F.last("v", ignorenulls=True).over(seen)).filter("kind = 1")
    return both.select("row.*", F.col("v").alias(value))
