"""Event topics: one reader for brokers and files, one append sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Topic name and partition count (fixed values).
TOPICS = {
    "raw-prices": 6, "macro-signals": 3, "ts-model-signals": 3, "llm-decisions": 3, "notifications": 1, "audit": 1,
}


def read_topic(spark: SparkSession, topic: str, schema: T.StructType | str, servers: str, options: dict | None = None) -> DataFrame:
    """JSON events of a Kafka topic as typed rows (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in (options or {}).items():
        raw = raw.option(k, v)
    value = F.from_json(F.col("value").cast("string"), schema)
    return raw.load().select(value.alias("e")).select("e.*")


def read_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The same rows from files landing in a folder. Zone-less times are taken as UTC."""
    r = spark.readStream.schema(schema).format(fmt)
    if name_filter:
        r = r.option("pathGlobFilter", name_filter)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    df = r.load(folder)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Exactly-once append to files; runs until all present input is read, then stops."""
    return (
        stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merge_into(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None], mode: str = "update"):
    """Hand every micro-batch to ``merge(batch, batch_id)``, for keyed tables."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(merge).trigger(availableNow=True).start()
    )


def drain(stream: DataFrame, path: str, checkpoint: str, schema: T.StructType | None = None) -> DataFrame:
    """Run the stream over what is there and read the written table back."""
    q = append_to(stream, path, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(path)
