"""What a stream of labelled rows tells of D1 and of scaling: mergeable counts and moments by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ir_to_d1


def windowed_imbalance(events: DataFrame, time: str, is_min: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, n, n_minority, d1) by tumbling window; for batch frames and streams alike."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(is_min)).alias("n_minority"))
    d1 = F.when(F.col("n_minority").between(1, F.col("n") - 1), ir_to_d1((F.col("n") - F.col("n_minority")) / F.col("n_minority"))).otherwise(1.0)
    return w.select(F.col("w.start").alias("start"), "n", "n_minority", d1.alias("d1"))


def windowed_moments(events: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, n, lo, hi, mean, std) of a feature by tumbling window; std is of the population."""
    v = F.col(value)
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return w.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).select(F.col("w.start").alias("start"), "n", "lo", "hi", "mean", "std")
