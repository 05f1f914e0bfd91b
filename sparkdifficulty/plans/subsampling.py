"""Seeded draws of bounded size, and the folding of several draws' results into one."""

from __future__ import annotations

import logging
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import BinaryDataset
from ..result import DimensionResult
from ..storage import materialize

logger = logging.getLogger(__name__)

#: Seed streams. Fixed values.
STREAM_BOTH, STREAM_MINORITY = 0, 1
#: Rows that one task numbers.
RUN = 100_000


def check_seed(seed: Any) -> int:
    if isinstance(seed, bool) or not isinstance(seed, int | np.integer) or seed < 0:
        raise ValueError("random_state must be a whole number of at least 0")
    return int(seed)


def derive_seed(seed: int, stream: int, draw: int) -> int:
    return int(np.random.SeedSequence(entropy=check_seed(seed), spawn_key=(stream, draw)).generate_state(1, dtype=np.uint32)[0])


def numbered(rows: DataFrame) -> DataFrame:
    """rows with pos long: the place by row_id among all rows, from 0, without one task that sees them all.

    Ids are dealt out by range in sorted partitions of about equal size; rows start after the earlier partitions' rows.
    """
    parts = max(1, min(100_000, rows.count() // RUN))
    dealt = materialize(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("row_id").alias("at")).repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    inner = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    return dealt.withColumn("inner", inner).join(counts.select("part", "before"), "part").select("row.*", (F.col("inner") + F.col("before")).alias("pos"))


def _take(rows: DataFrame, positions: np.ndarray) -> DataFrame:
    """The numbered rows at these positions."""
    chosen = rows.sparkSession.createDataFrame(pa.table({"pos": np.sort(positions).astype(np.int64)}))  # n_max numbers
    return rows.join(F.broadcast(chosen), "pos", "left_semi").drop("pos")


def numbered_classes(data: BinaryDataset) -> tuple[DataFrame, DataFrame]:
    """numbered() of the minority and of the others, for several draws."""
    return numbered(data.minority()), numbered(data.rows.where("NOT is_min"))


def stratified(data: BinaryDataset, n_max: int, seed: int, classes: tuple[DataFrame, DataFrame] | None = None) -> BinaryDataset:
    """n_max rows without replacement, classes in proportion (halves round to even), at least two of the minority.

    classes: numbered_classes() of data, if it is there.
    """
    share = n_max * data.n_minority / data.n
    if round(share) < 2:
        logger.warning("a draw of %d rows would hold %.2f of the minority; two are taken", n_max, share)
    n_min = min(max(round(share), 2), data.n_minority)
    n_maj = min(n_max - n_min, data.n_majority)
    rng = np.random.default_rng(seed)
    few, many = rng.choice(data.n_minority, n_min, replace=False), rng.choice(data.n_majority, n_maj, replace=False)
    classes = classes or numbered_classes(data)
    rows = _take(classes[0], few).union(_take(classes[1], many))
    return data.subset(rows, n_min + n_maj, n_min)


def minority_draw(data: BinaryDataset, n_max: int, seed: int) -> BinaryDataset:
    """All majority rows and n_max of the minority; for what looks at minority rows alone."""
    rows = _take(numbered(data.minority()), np.random.default_rng(seed).choice(data.n_minority, n_max, replace=False))
    return BinaryDataset(rows, data.n, data.d, n_max, data.minority_label, data.majority_label, data.name)


def keep_minority(rows: DataFrame, n_max: int, seed: int = 0, whole: bool = False) -> DataFrame:
    """All minority rows and as many others as make n_max, by a hash of the id. A minority of n_max or more is drawn in
    proportion, or kept and alone if whole."""
    n, few = rows.agg(F.count("*"), F.count_if("is_min")).first()
    n_min = few if whole or few < n_max else round(n_max * few / n)
    key = (F.col("row_id") * 2654435761 + seed) % 4294967296
    part = lambda df, k: df.orderBy(key, "row_id").limit(k)
    own = rows.where("is_min")
    return (own if n_min == few else part(own, n_min)).union(part(rows.where("NOT is_min"), max(0, n_max - n_min)))


def median_iqr(values: list[float]) -> tuple[float, float]:
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    return float(q2), float(q3 - q1)


def folded(runs: list[DimensionResult], seeds: list[int], n_used: int) -> DimensionResult:
    """One result of one draw or several: medians and ranges of numbers, all of booleans, every component by draw;
    seconds of components are added up."""
    meta: dict[str, Any] = {"n_used": n_used, "subsampled": bool(seeds), "n_subsamples": len(runs), "seeds": seeds, "values": [r.value for r in runs]}
    if not seeds:
        return DimensionResult(runs[0].dimension_id, runs[0].value, runs[0].components, meta | runs[0].metadata)
    by_draw = {k: [r.components[k] for r in runs] for k in runs[0].components}
    whole = {k: all(v) for k, v in by_draw.items() if all(isinstance(x, bool) for x in v)}
    spread = {k: median_iqr(v) for k, v in by_draw.items() if k not in whole and all(isinstance(x, int | float) for x in v)}
    components = {k: whole[k] if k in whole else spread[k][0] for k in by_draw if k in whole or k in spread}
    meta |= {"components_iqr": {k: v[1] for k, v in spread.items()}, "components_per_subsample": by_draw, "run_metadata": [r.metadata for r in runs]}
    parts = [r.metadata["component_seconds"] for r in runs if "component_seconds" in r.metadata]
    if parts:
        meta["component_seconds"] = {k: sum(p[k] for p in parts) for k in parts[0]}
    value, iqr = median_iqr(meta["values"])
    return DimensionResult(runs[0].dimension_id, value, components, meta, iqr)
