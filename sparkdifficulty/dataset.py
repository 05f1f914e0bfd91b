"""A binary-labelled feature table: validated once, in one aggregate job."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MIN_MINORITY = 10, 2


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@dataclass(frozen=True)
class BinaryDataset:
    """rows is (row_id long, x array<double>, is_min boolean); counts are known."""

    rows: DataFrame
    n: int
    d: int
    n_minority: int
    minority_label: Any
    majority_label: Any
    name: str = "dataset"

    @classmethod
    def of(cls, df: DataFrame, features: list[str] | str, label: str, minority_label: Any, majority_label: Any, id_col: str, name: str = "dataset") -> BinaryDataset:
        """features: numeric columns, or one array column. The class roles are declared, never inferred.

        Raises ValueError for no feature, rows of several lengths, null or non-finite features, other than two labels,
        unknown labels, fewer than 10 rows or 2 minority rows, and ids that are null or repeat.
        """
        if not features:
            raise ValueError("at least one feature is needed")
        x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
        if minority_label == majority_label:
            raise ValueError("the two labels are the same")
        rows = df.select(F.col(id_col).cast("long").alias("row_id"), x.alias("x"), F.col(label).alias("label"))
        got = rows.agg(
            F.count("*").alias("n"),
            F.count_distinct("row_id").alias("ids"),
            F.min(F.size("x")).alias("d"),
            F.max(F.size("x")).alias("d_most"),
            F.bool_and(F.coalesce(F.forall("x", finite), F.lit(False))).alias("finite"),
            F.count_distinct("label").alias("labels"),
            F.count_if(F.col("label").isNull()).alias("null_labels"),
            F.count_if(F.col("label") == F.lit(minority_label)).alias("n_min"),
            F.count_if(F.col("label") == F.lit(majority_label)).alias("n_maj"),
        ).first()
        if got["n"] < MIN_ROWS:
            raise ValueError(f"{got['n']} rows; at least {MIN_ROWS} are needed")
        if not got["finite"] or got["d"] != got["d_most"] or got["d"] < 1:
            raise ValueError("features must be finite numbers, as many in each row")
        if got["ids"] != got["n"]:
            raise ValueError(f"{id_col} is null or repeats")
        if got["labels"] != 2 or got["null_labels"] or not got["n_min"] or not got["n_maj"]:
            raise ValueError("there must be exactly the two labels that are declared")
        if got["n_min"] < MIN_MINORITY:
            raise ValueError(f"{got['n_min']} minority rows; at least {MIN_MINORITY} are needed")
        if got["n_min"] > got["n_maj"]:
            warnings.warn("the declared minority is the larger class; roles are kept", stacklevel=2)
        return cls(rows.select("row_id", "x", (F.col("label") == F.lit(minority_label)).alias("is_min")), got["n"], got["d"], got["n_min"], minority_label, majority_label, name)

    @classmethod
    def inferred(cls, df: DataFrame, features: list[str] | str, label: str, id_col: str, name: str = "dataset") -> BinaryDataset:
        """The rarer label is the minority; declare the roles instead. ValueError if both are as frequent."""
        warnings.warn("inferred class roles are deprecated; declare them", DeprecationWarning, stacklevel=2)
        counts = df.groupBy(label).count().orderBy("count").limit(3).collect()
        if len(counts) != 2 or counts[0]["count"] == counts[1]["count"]:
            raise ValueError("the minority can't be inferred")
        return cls.of(df, features, label, counts[0][label], counts[1][label], id_col, name)

    @property
    def n_majority(self) -> int:
        return self.n - self.n_minority

    @property
    def ir(self) -> float:
        return self.n_majority / self.n_minority

    @property
    def minority_is_majority(self) -> bool:
        return self.n_minority > self.n_majority

    def minority(self) -> DataFrame:
        return self.rows.where("is_min")

    def long(self) -> DataFrame:
        """(row_id, is_min, f, v): one row for each value."""
        return self.rows.select("row_id", "is_min", F.posexplode("x").alias("f", "v"))

    def subset(self, rows: DataFrame, n: int, n_minority: int) -> BinaryDataset:
        if n < MIN_ROWS or n_minority < MIN_MINORITY:
            raise ValueError(f"a draw of {n} rows, {n_minority} of the minority, is too small")
        return replace(self, rows=rows, n=n, n_minority=n_minority)

    def with_features(self, rows: DataFrame, d: int) -> BinaryDataset:
        if d < 1:
            raise ValueError("at least one feature is needed")
        return replace(self, rows=rows, d=d)
