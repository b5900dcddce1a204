"""A keyed table kept current from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators.index import latest
from lodestone.session import ensure_checkpoint_dir


def stream_latest(spark: SparkSession, path: str, key: str, at: str, pattern: str, watermark: str = "36500 days") -> DataFrame:
    """The last row of every key of a folder of change files, read as a stream until no file is left.

    Every micro-batch is reduced to its own last rows and appended to a table in the shared folder under its batch id,
    so that a batch that is run again replaces itself; the reader takes the last row over all batches.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    schema = spark.read.parquet(f"{path}/{pattern}").schema

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    query = (
        spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{path}/{pattern}")
        .writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{base}/rows/*")
    return latest(rows, key, at)


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts and sums per window of event time; rows later than ``late`` are left out when the source is a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", F.round("total", 4).alias("total"))
