"""Readers and the cleaning that tables need before they are a BinaryDataset. Unreadable files raise."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv(spark: SparkSession, paths: str | list[str], header: bool = True, sep: str = ",", infer: bool = True) -> DataFrame:
    """One or many CSV files; trimmed names; columns missing in some files are null there."""
    frames = [spark.read.csv(p, header=header, inferSchema=infer, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True) for p in ([paths] if isinstance(paths, str) else paths)]
    frames = [f.toDF(*[c.strip() for c in f.columns]) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """(label, features array<double>)."""
    return spark.read.format("libsvm").load(path).select("label", vector_to_array("features").alias("features"))


def words(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Fields apart by white space, as strings."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)])


def spectra(signals: DataFrame, signal: str = "signal", segment: int = 256, bins: int = 128) -> DataFrame:
    """Magnitudes of the Fourier transform of non-overlapping segments: (row of signals' other columns, seg, features)."""
    keep = [c for c in signals.columns if c != signal]
    at = signals.columns.index(signal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, segs, out = [], [], []
            for i in range(b.num_rows):
                x = np.array(b.column(at)[i].as_py() or [], dtype=float)
                for j in range(len(x) // segment):
                    rows.append(i)
                    segs.append(j)
                    out.append(np.abs(np.fft.rfft(x[j * segment : (j + 1) * segment]))[:bins].tolist())
            others = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(segs, pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=[*keep, "seg", "features"])

    schema = "".join(f"`{c}` {t}, " for c, t in signals.dtypes if c != signal)
    return signals.mapInArrow(run, f"{schema}seg int, features array<double>")


def label_codes(df: DataFrame, col: str, out: str, null_code: int | None = -1) -> DataFrame:
    """Places of the sorted distinct values, from 0; the distinct values alone are ranked."""
    codes = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(col)) - 1)
    joined = df.join(codes, col, "left")
    return joined if null_code is None else joined.withColumn(out, F.coalesce(out, F.lit(null_code)))


def drop_sparse(df: DataFrame, most: float = 0.5) -> DataFrame:
    """df without columns of which more than `most` is null."""
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if (share[c] or 0) <= most])


def number(text: Column) -> Column:
    """The text as a finite number, or null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the exact median of the column."""
    medians = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return df.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) if c in columns else F.col(c) for c in df.columns])


def transpose(df: DataFrame, id_col: str) -> DataFrame:
    """Rows become columns: (name, one column for each id)."""
    others = [c for c in df.columns if c != id_col]
    return df.unpivot([id_col], others, "name", "value").groupBy("name").pivot(id_col).agg(F.first("value"))


def top_variance(df: DataFrame, columns: list[str], n: int) -> list[str]:
    """The n columns of largest sample variance, ties by name."""
    got = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict()
    return sorted(columns, key=lambda c: (-(got[c] or 0.0), c))[:n]


def contains(col: Column, part: str) -> Column:
    return F.contains(col, F.lit(part))


#: Loaders by name; a loader takes (spark, folder) and returns (table, features, label, minority, majority);
#: features are names of columns or the name of an array column.
LOADERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, list[str] | str, str, Any, Any]]] = {}


def loader(name: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        LOADERS[name] = f
        return f

    return add


@loader("pima_diabetes")
def _pima(spark: SparkSession, folder: str):  # noqa: ANN202
    df = csv(spark, f"{folder}/diabetes.csv")
    return df, [c for c in df.columns if c != "Outcome"], "Outcome", 1, 0


@loader("credit_card_fraud")
def _card(spark: SparkSession, folder: str):  # noqa: ANN202
    df = csv(spark, f"{folder}/creditcard.csv")
    return df, [c for c in df.columns if c not in ("Time", "Class")], "Class", 1, 0


@loader("breast_cancer")
def _wdbc(spark: SparkSession, folder: str):  # noqa: ANN202
    df = csv(spark, f"{folder}/wdbc.data", header=False).withColumn("label", (F.col("_c1") == "M").cast("int"))
    return df, [f"_c{i}" for i in range(2, 32)], "label", 1, 0


def _coded(df: DataFrame, columns: list[str], null_code: int | None = -1) -> DataFrame:
    """df with the columns replaced by their values' places."""
    for c in columns:
        df = label_codes(df, c, "code of it", null_code).drop(c).withColumnRenamed("code of it", c)
    return df


def _but(df: DataFrame, *others: str) -> list[str]:
    return [c for c in df.columns if c not in others]


@loader("paysim")
def _paysim(spark: SparkSession, folder: str):  # noqa: ANN202
    df = _coded(csv(spark, f"{folder}/PS_20174392719_1491204439457_log.csv").drop("nameOrig", "nameDest", "isFlaggedFraud"), ["type"])
    return df, _but(df, "isFraud"), "isFraud", 1, 0


@loader("ieee_cis")
def _ieee(spark: SparkSession, folder: str):  # noqa: ANN202
    df = drop_sparse(csv(spark, f"{folder}/train_transaction.csv").drop("TransactionID"))
    features = _but(df, "is_fraud")
    df = _coded(df, [c for c, t in df.dtypes if t == "string"], None)
    return fill_medians(df, features), features, "is_fraud", 1, 0


@loader("svmguide1")
def _svmguide(spark: SparkSession, folder: str):  # noqa: ANN202
    df = libsvm(spark, f"{folder}/svmguide1.txt")
    few, many = (r["label"] for r in df.groupBy("label").count().orderBy("count", "label").limit(2).collect())
    return df, "features", "label", few, many


@loader("nsl_kdd")
def _kdd(spark: SparkSession, folder: str):  # noqa: ANN202
    df = csv(spark, f"{folder}/KDDTrain+.txt", header=False).withColumn("label", (F.col("_c41") != "normal").cast("int")).drop("_c41", "_c42")
    return _coded(df, ["_c1", "_c2", "_c3"]), _but(df, "label"), "label", 1, 0


@loader("cic_ids")
def _cic(spark: SparkSession, folder: str):  # noqa: ANN202
    """All shards of the folder; one that can't be read raises."""
    df = csv(spark, files(spark, folder, ".csv"), infer=False)
    features = _but(df, "Label")
    numbers = df.select(*[number(F.col(f"`{c}`")).alias(c) for c in features], (F.trim("Label") != "BENIGN").cast("int").alias("label"))
    return fill_medians(numbers, features), features, "label", 1, 0


@loader("cwru")
def _cwru(spark: SparkSession, folder: str):  # noqa: ANN202
    df = csv(spark, f"{folder}/feature_time_48k_2048_load_1.csv")
    fault = df.columns[-1]
    return df.withColumn("label", (~F.coalesce(contains(F.col(f"`{fault}`"), "Normal"), F.lit(False))).cast("int")), _but(df, fault), "label", 1, 0


@loader("tcga_brca")
def _tcga(spark: SparkSession, folder: str):  # noqa: ANN202
    """The 2,000 genes of largest variance, of samples of four known kinds."""
    genes = csv(spark, f"{folder}/Human__TCGA_BRCA__UNC__RNAseq__HiSeq_RNA__01_28_2016__BI__Gene__Firehose_RSEM_log2.cct", sep="\t")
    facts = csv(spark, f"{folder}/Human__TCGA_BRCA__MS__Clinical__Clinical__01_28_2016__BI__Clinical__Firehose.tsi.txt", sep="\t")
    kind = facts.where(F.col(f"`{facts.columns[0]}`") == "PAM50").drop(facts.columns[0])
    kind = kind.unpivot([], kind.columns, "name", "kind").where(F.col("kind").isin("LumA", "LumB", "Basal", "Her2"))
    long = genes.unpivot([genes.columns[0]], genes.columns[1:], "name", "value").withColumnRenamed(genes.columns[0], "gene").join(kind, "name")
    top = long.groupBy("gene").agg(F.var_samp("value").alias("v")).orderBy(F.desc_nulls_last("v"), "gene").limit(2000).select("gene")
    rows = long.join(top, "gene").groupBy("name", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", F.col("value").cast("double").alias("value")))), lambda s: s["value"]).alias("features"))  # 2,000 a sample
    return rows.withColumn("label", F.col("kind").isin("Basal", "Her2").cast("int")), "features", "label", 1, 0


def _word_table(spark: SparkSession, path: str, n: int, minority: str):  # noqa: ANN202
    features = [f"x{i}" for i in range(n)]
    df = words(spark, path, ["name", *features, "kind"])
    return df.select(*[number(F.col(c)).alias(c) for c in features], (F.col("kind") == minority).cast("int").alias("label")), features, "label", 1, 0


@loader("yeast_me3")
def _yeast(spark: SparkSession, folder: str):  # noqa: ANN202
    return _word_table(spark, f"{folder}/yeast.data", 8, "ME3")


@loader("ecoli_imu")
def _ecoli(spark: SparkSession, folder: str):  # noqa: ANN202
    return _word_table(spark, f"{folder}/ecoli.data", 7, "imU")


def files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """The folder's files of that ending, in order; the folder may be in any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().endswith(ending))


def write_json(records: list[Any], path: str) -> None:
    """Records with as_dict(), as one JSON array."""
    Path(path).write_text(json.dumps([r.as_dict() for r in records], indent=2))
