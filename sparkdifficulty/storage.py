"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir (or setCheckpointDir) names. Where it is unset, a session in one process gets a
    folder of its own; on a cluster that is an error, as executors share no local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkdifficulty-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The shuffle files behind df aren't needed any more then. Spark's cleaner removes those of unreachable plans when
    the driver's JVM collects garbage, so ask for that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.java.lang.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.materialized_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.materialized_at)
        path.getFileSystem(conf).delete(path, True)
