"""Tables written once and read many times.

A staged table cuts the lineage at a reliable place: the shared folder the cluster names in
``spark.checkpoint.dir``. Unlike an RDD checkpoint it stays columnar, so later scans prune
columns and push filters. Without that setting a scratch folder is made per session, in local mode only: executors of a
cluster would each write to a disk of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="barloom-")
    return _SCRATCH[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/barloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared store and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
