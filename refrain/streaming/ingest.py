"""Incremental ingest: each micro-batch adds the entries whose key is not stored yet."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], late: Column | None = None, broken: Column | None = None, **trigger):
    """Start a query that appends new rows of ``stream`` to the Parquet table ``target``.

    Each batch writes a folder of its own, so that a batch that is run again replaces what it wrote. The folder is named
    by the checkpoint too: with a new checkpoint, what other ones have written stays and is not written again.

    late: a condition on rows that are too old to be added (null: not late), as one on the backfill horizon.
    broken: a condition on rows that cannot be used; they go to ``target``_broken, and the rest of the batch goes on.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if broken is not None:
            bad = F.coalesce(broken, F.lit(False))
            batch.where(bad).write.mode("overwrite").parquet(f"{target}_broken/run={run}/batch={number}")
            batch = batch.where(~bad)
        if late is not None:
            batch = batch.where(~F.coalesce(late, F.lit(False)))
        fresh = batch.dropDuplicates(keys)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.option("basePath", target).parquet(target)
            held = held.where((F.col("run") != run) | (F.col("batch") < number))
            fresh = fresh.join(held.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_once(stream: DataFrame, target: str, checkpoint: str, keys: list[str], late: Column | None = None, broken: Column | None = None, forget: tuple[str, str] | None = None, **trigger):
    """Start a query that appends the rows of ``stream`` whose keys no earlier row had to the Parquet table ``target``.

    What has been seen is keyed state of the query (RocksDB, by key, kept with the checkpoint): no batch reads the target, and a
    restart goes on where it stopped. The sink's own log makes a batch that is run again count once. Rows that match
    ``broken`` are put aside; ``added`` reads the others. late: as in ``ingest``.

    forget: a time column and a delay. Keys are forgotten once the watermark is that far behind, which bounds the state; rows that
    come later than that are dropped. Without it keys are known for good, also those of rows without a time.
    """
    spark = stream.sparkSession
    rows = stream.withColumn("broken", F.coalesce(broken, F.lit(False)) if broken is not None else F.lit(False))
    if late is not None:
        rows = rows.where(~F.coalesce(late, F.lit(False)))
    if forget is None:
        fresh = rows.dropDuplicates([*keys, "broken"])
    else:
        fresh = rows.withWatermark(*forget).dropDuplicatesWithinWatermark([*keys, "broken"])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("broken").outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def added(spark: SparkSession, target: str, broken: bool = False) -> DataFrame:
    """The rows that ``ingest_once`` has added so far, or those it has put aside."""
    return spark.read.parquet(target).where(F.col("broken").cast("boolean") == broken).drop("broken")
