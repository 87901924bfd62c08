"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder and a cluster session a
    folder under its warehouse, which all executors can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        named = Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri()
    else:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The paths that ``staged`` has written in this process and ``clear_staged`` hasn't deleted.
staged_paths: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    staged_paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete what has been staged, from the ``since``-th table on and but for the last ``but``; gives the number of tables.

    Call it once the results that read them are written.
    """
    own = staged_paths[since : len(staged_paths) - but]
    for path in own:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del staged_paths[since : since + len(own)]
    return len(own)


def bytes_in_memory(df: DataFrame) -> int:
    """About what a table's rows take in memory: Spark's own guess is the size of the files, in which repeated values hardly count."""
    row = F.octet_length(F.to_json(F.struct("*"))) + 32 + 8 * len(df.columns)
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0
