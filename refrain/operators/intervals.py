"""Interval algebra per group: union, complement, overlap, splice positions, greedy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parted(df: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """df with __part: which union of intervals a row belongs to."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    return marked.withColumn("__part", F.sum("__new").over(order)).drop("__new")


def union(df: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """keys, start, end: intervals merged where one starts within ``gap`` after all before it (inclusive)."""
    out = parted(df, keys, gap).groupBy(*keys, "__part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.drop("__part")


def complement(df: DataFrame, keys: list[str], whole: str) -> DataFrame:
    """keys, start, end of what disjoint intervals leave of [0, whole]."""
    order = Window.partitionBy(*keys).orderBy("start")
    last = df.groupBy(*keys).agg(F.max("end").alias("start"), F.max(whole).alias("end"))
    before = df.select(*keys, F.coalesce(F.lag("end").over(order), F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    return before.union(last.select(*keys, "start", "end")).where("end > start")


def splices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds splice: where an interval's cut lies once those before it are gone, 0 at least."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    gone = F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("splice", F.greatest(F.col("start") - F.coalesce(gone, F.lit(0.0)), F.lit(0.0)))


def _binned(df: DataFrame, a: Column, b: Column, width: float, name: str) -> DataFrame:
    """A row for each bin of ``width`` that an interval touches, with the first of them."""
    low, high = (F.floor(f(a, b) / width) for f in (F.least, F.greatest))
    marked = df.withColumns({f"{name}_first": low, f"{name}_last": high})
    return marked.withColumn(f"{name}_bin", F.explode(F.sequence(f"{name}_first", f"{name}_last"))).drop(f"{name}_last")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], at: tuple[str, str] = ("start", "end"), by: tuple[str, str] = ("__s", "__e"), width: float = 64.0) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap strictly. ``at`` names the bounds of left, ``by`` those of right.

    Both sides are dealt into bins of time, and a pair meets in the first bin that both touch, so that an item of very many
    intervals does not meet itself in full and no pair comes twice.
    """
    l = _binned(left.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()), F.col(at[0]), F.col(at[1]), width, "__l")
    r = _binned(right.where(F.col(by[0]).isNotNull() & F.col(by[1]).isNotNull()), F.col(by[0]), F.col(by[1]), width, "__r")
    met = l.join(r.withColumnRenamed("__r_bin", "__l_bin"), [*keys, "__l_bin"])
    hit = (F.col(by[1]) > F.col(at[0])) & (F.col(by[0]) < F.col(at[1])) & (F.col("__l_bin") == F.greatest("__l_first", "__r_first"))
    return met.where(hit).drop("__l_bin", "__l_first", "__r_first")


def text_between(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """spans with text: that of all segments that overlap them strictly, in order."""
    seg = segments.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), "idx", F.col("text").alias("__t"))
    joined = overlapping(spans, seg, keys)
    parts = F.array_sort(F.collect_list(F.struct("idx", "__t")))
    return joined.groupBy(*spans.columns).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), " ").alias("text"))


def greedy(df: DataFrame, keys: list[str], slack: float = 0.5) -> DataFrame:
    """Runs kept in order of rising ber, each unless it overlaps a kept one by more than ``slack``."""
    run = F.struct("ber", "start", "end")
    kind = "array<struct<ber:double,start:double,end:double>>"
    kept = F.aggregate(
        F.array_sort(F.collect_list(run)),
        F.array().cast(kind),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: (x["start"] < k["end"] - slack) & (x["end"] > k["start"] + slack)), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return df.groupBy(*keys).agg(kept.alias("k")).select(*keys, F.inline("k"))
