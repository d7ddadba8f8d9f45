"""Queries over a catalog of groups, items and removed segments; ``as_of`` stands for the present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.scalar import percent


def progress(groups: DataFrame, items: DataFrame, key: str, done: Column) -> DataFrame:
    """groups with total, processed and progress_pct, in one grouped pass and one left join."""
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"))
    out = groups.join(n, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "processed")})
    return out.withColumn("progress_pct", percent(F.col("processed"), F.col("total")))


def eta(df: DataFrame, started: str, as_of: Column) -> DataFrame:
    """Adds eta_s: elapsed / done * what is left, whole seconds; null before the first is done."""
    elapsed = as_of.cast("timestamp").cast("double") - F.col(started).cast("timestamp").cast("double")
    left = elapsed / F.col("processed") * (F.col("total") - F.col("processed"))
    return df.withColumn("eta_s", F.when(F.col("processed") > 0, left.cast("long")))


def new_items(feed: DataFrame, stored: DataFrame, keys: list[str], date: str, cutoff: Column) -> DataFrame:
    """Feed entries not stored yet, once per key; undated ones stay, dated ones from ``cutoff`` on."""
    recent = feed.where(F.col(date).isNull() | (F.col(date) >= cutoff))
    return recent.join(stored.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def pending(items: DataFrame, path: str, date: str, cutoff: Column) -> DataFrame:
    """Items without a path, newest first; here undated ones go."""
    return items.where(F.col(path).isNull() & (F.col(date) >= cutoff)).orderBy(F.col(date).desc_nulls_last())


def delete_group(groups: DataFrame, items: DataFrame, segments: DataFrame, gone: DataFrame, group: str, item: str):
    """The three tables without the groups of ``gone`` and what hangs on them."""
    left = items.join(gone.select(group), group, "left_anti")
    lost = items.join(gone.select(group), group, "left_semi").select(item)
    return groups.join(gone.select(group), group, "left_anti"), left, segments.join(lost, item, "left_anti")


def shown(items: DataFrame, got: Column, date: str, cutoff: Column) -> DataFrame:
    """What a group's page lists: items already there, of any or no date, and recent ones."""
    return items.where(got | (F.col(date) >= cutoff))


def queue(items: DataFrame, waiting: Column, date: str, key: str, most: int = 20) -> DataFrame:
    """The ``most`` newest waiting items; the first is being worked on and leaves the list after the cut."""
    top = items.where(waiting).orderBy(F.col(date).desc_nulls_last(), key).limit(most)
    return top.orderBy(F.col(date).desc_nulls_last(), key).offset(1)


def listed(items: DataFrame, group: str, key: str, date: str) -> DataFrame:
    """group, keys, n: a group's items in order of date (undated first), as one string."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(date).cast("timestamp").cast("double"), F.lit(float("-inf"))).alias("d"), key)))
    return items.groupBy(group).agg(F.array_join(F.transform(order, lambda x: x[key].cast("string")), ",").alias("keys"), F.count(F.lit(1)).alias("n"))


def reprocess(items: DataFrame, done: Column, key: str, only: DataFrame | None = None) -> DataFrame:
    """Processed items to be done again: all, or those that ``only`` names."""
    again = items.where(done)
    return again if only is None else again.join(only.select(key), key, "left_semi")


def replace_items(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The segment table with all of an item's old rows replaced by its fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def served(items: DataFrame, done: Column, path: str, files: DataFrame) -> DataFrame:
    """The items that a feed may list: processed, with a path, and a file of that name is among ``files``."""
    there = files.select(F.col("name").alias(path)).distinct()
    return items.where(done & F.col(path).isNotNull()).join(there, path, "left_semi").select(*items.columns)


def update_rows(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The stored rows with the columns that ``changes`` has (one row per key) set anew where it has a value.

    Keys that are not stored add nothing; the columns keep their order and types.
    """
    new = {c: f"__new_{c}" for c in changes.columns if c != key}
    joined = stored.join(changes.select(key, *[F.col(c).alias(n) for c, n in new.items()]), key, "left")
    kinds = dict(stored.dtypes)
    return joined.select(*[F.coalesce(F.col(new[c]).cast(kinds[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns])
