"""Runs that arrive as files of JSON lines, taken into a run table once each, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType | str):
    """Starts a query over new files in ``source``; a run key that ``target`` already holds is not taken again, so a
    batch that is repeated after a failure adds nothing. ``target`` must be a folder of Parquet files, or not exist."""

    def take(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["run_key"])
        try:
            done = batch.sparkSession.read.schema("run_key string").parquet(target)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(done, "run_key", "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
