"""Constant columns go, the others are scaled: one aggregate over the long view, then a projection."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import BinaryDataset

SCALINGS = ("standard", "robust", "none")


def doubles(values: list[float]) -> Column:
    """An array of constants that is one literal of the plan, however long."""
    return (F.split(F.lit(",".join(map(repr, map(float, values)))), ",") if len(values) else F.array()).cast("array<double>")


def feature_stats(data: BinaryDataset, quartiles: bool = False) -> DataFrame:
    """(f, lo, hi, mean, std[, q]) for each feature; std is of the population, quartiles are exact."""
    more = [F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")] if quartiles else []
    return data.long().groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *more)


def preprocess(data: BinaryDataset, scaling: str = "standard") -> tuple[BinaryDataset, dict[str, Any]]:
    if scaling not in SCALINGS:
        raise ValueError(f"scaling is one of {SCALINGS}")
    stats = sorted(feature_stats(data, scaling == "robust").collect(), key=lambda r: r["f"])  # a row for each feature
    kept = [r for r in stats if r["hi"] - r["lo"] != 0]
    if not kept:
        raise ValueError("all columns are constant")
    fallback: list[int] = []
    if scaling == "robust":
        centre = [r["q"][1] for r in kept]
        width = [r["q"][2] - r["q"][0] for r in kept]
        fallback = [r["f"] for r, w in zip(kept, width, strict=True) if w == 0]
        width = [w if w else r["std"] for r, w in zip(kept, width, strict=True)]
    else:
        centre, width = [r["mean"] for r in kept], [r["std"] for r in kept]
    if scaling != "none" and not all(math.isfinite(c) and math.isfinite(w) and w > 0 for c, w in zip(centre, width, strict=True)):
        raise ValueError("scaling gives non-finite values")
    x = F.col("x")
    if len(kept) < len(stats):
        x = F.transform(doubles([r["f"] for r in kept]).cast("array<int>"), lambda i: F.get("x", i))
    if scaling != "none":
        x = F.zip_with(F.zip_with(x, doubles(centre), lambda a, c: a - c), doubles(width), lambda a, w: a / w)
    info = {"scaling": scaling, "dropped_columns": [r["f"] for r in stats if r["hi"] - r["lo"] == 0], "robust_std_fallback_columns": fallback}
    return data.with_features(data.rows.withColumn("x", x), len(kept)), info
