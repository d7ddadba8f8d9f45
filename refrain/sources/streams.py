"""A store of hash streams that is read through: what it lacks is computed once and added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.session import exists

STREAM = "id long, fp array<bigint>"


def stored(items: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, fp of ``items`` (id, ...) from the Parquet table ``store``; ``compute`` gives id, fp of those that are not in it.

    Only items without a row in the store are computed, and nothing is written if there are none. A run that fails adds
    nothing; runs at the same time may add an item twice, so an item's first stream counts.
    """
    spark = items.sparkSession
    held = spark.read.schema(STREAM).parquet(store) if exists(spark, store) else spark.createDataFrame([], STREAM)
    absent = items.join(held.select("id"), "id", "left_anti")
    if absent.select("id").head(1):
        made = compute(absent).select(F.col("id").cast("long").alias("id"), F.col("fp").cast("array<bigint>").alias("fp"))
        made.write.mode("append").parquet(store)
    asked = items.select(F.col("id").cast("long").alias("id")).distinct()
    return spark.read.schema(STREAM).parquet(store).join(asked, "id", "left_semi").dropDuplicates(["id"])


def unfolded(streams: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, id, pos, h: a row for each place of the streams. groups: id, grp."""
    return streams.join(groups.select("id", "grp"), "id").select("grp", "id", F.posexplode("fp").alias("pos", "h"))
