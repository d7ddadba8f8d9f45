"""Recompute of what new items change: pairs of new items with those that share something with them, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators import catalog


def frontier(marks: DataFrame, fresh: DataFrame) -> DataFrame:
    """id: the fresh items (id) and all that share a mark (grp, id, h) with one of them in their group."""
    new = fresh.select("id").distinct()
    shared = marks.join(new, "id", "left_semi").select("grp", "h").distinct()
    return marks.join(shared, ["grp", "h"], "left_semi").select("id").union(new).distinct()


def touched(marks: DataFrame, fresh: DataFrame) -> DataFrame:
    """The marks that can make pairs with a fresh item: those that stand in one, whoever holds them; fresh says who is fresh."""
    new = fresh.select("id").distinct()
    shared = marks.join(new, "id", "left_semi").select("grp", "h").distinct()
    held = marks.join(shared, ["grp", "h"], "left_semi").join(new.withColumn("fresh", F.lit(True)), "id", "left")
    return held.withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def updated_pairs(stored: DataFrame, marks: DataFrame, fresh: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pair results (a, b, ...) of all items: the stored ones of old pairs, and those of pairs with a fresh item computed anew.

    ``compute`` makes pair results of marks (grp, id, pos, h); it is given only marks that a fresh item has too. That is all
    where a pair's result depends on marks that both have. It may leave out pairs without a fresh item, as the marks say who is
    fresh. Stored results of items that are computed again go.
    """
    return merged_pairs(stored, compute(touched(marks, fresh)), fresh)


def merged_pairs(stored: DataFrame, found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pair results (a, b, ...): those of ``found`` with a fresh item (id), and the stored ones of pairs without."""
    new = fresh.select("id").distinct()
    old = stored.join(new.select(F.col("id").alias("a")), "a", "left_anti").join(new.select(F.col("id").alias("b")), "b", "left_anti")
    one, two = new.select(F.col("id").alias("a"), F.lit(True).alias("na")), new.select(F.col("id").alias("b"), F.lit(True).alias("nb"))
    mine = found.join(one, "a", "left").join(two, "b", "left").where("na or nb").select(*stored.columns)
    return old.select(*stored.columns).union(mine)


def updated_items(stored: DataFrame, changed: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of all items (id, ...): those of ``changed`` (id) computed anew, the others as they are stored."""
    again = changed.select("id").distinct()
    return catalog.replace_items(stored.join(again, "id", "left_anti"), compute(again).select(*stored.columns), "id")
