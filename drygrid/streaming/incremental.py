"""Day-by-day ingestion of new files with a dead-letter log.

The unit of work is the arriving file. Each run takes the files not seen yet, stores their rows by day and batch, and logs rows that
cannot be used. Re-running after a failure repeats a batch with the same result. A day that arrives again is stored beside the
earlier one; :func:`ingested` reads the newest row of each key and time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from drygrid.functions.values import declare_missing


def ingest_new_days(
    spark: SparkSession, inbox: str, schema: StructType | str, cube: str, failures: str, progress: str,
    time: str = "time", value: str = "value", keys: tuple[str, ...] = ("cell_id",), files_per_run: int | None = None,
) -> StreamingQuery:
    """Start a run over the new files of ``inbox``; it stops by itself when they are done.

    Rows without a key or time go to ``failures`` under the batch number, the rest, each key and time once, to ``cube`` by day
    and batch. Both are overwritten per batch, so a repeated batch leaves no duplicates.
    """
    reader = spark.readStream.schema(schema)
    if files_per_run is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    rows = declare_missing(reader.parquet(inbox))

    def store(batch: DataFrame, number: int) -> None:
        usable = F.col(time).isNotNull()
        for k in keys:
            usable = usable & F.col(k).isNotNull()
        good = batch.where(usable).dropDuplicates([*keys, time]).withColumn("day", F.to_date(time)).withColumn("batch", F.lit(number))
        bad = batch.where(~usable).select(F.col(time).cast("string").alias("time"), F.lit("row without key or time").alias("error"), F.lit(number).alias("batch"))
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(cube)
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(failures)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", progress).trigger(availableNow=True).start()


def ingested(spark: SparkSession, cube: str, time: str = "time", keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """The stored rows, of each key and time the one that came last."""
    rows = spark.read.parquet(cube)
    newest = rows.groupBy(*keys, time).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, time)]), "batch").alias("_row"))
    return newest.select(*keys, time, "_row.*")


def days_to_retry(expected: DataFrame, cube: DataFrame, time: str = "time") -> DataFrame:
    """Expected days not yet in the stored cube; only its partition column ``day`` is read."""
    return expected.select(time).join(cube.select(F.col("day").alias(time)).distinct(), time, "left_anti")
