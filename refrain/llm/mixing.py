"""Mixing sources to target weights, in DataFrame functions alone.

Every document gets a hash-random key. Within its source the keys are ordered by range: the key's leading
bits name one of many even ranges, rows are sorted inside a range, and the ranges' sums are added up per
source. So prefix sums of word counts come out without a source in one task. A source with less than its
target is repeated in whole epochs; the last epoch is cut at the exact budget, inside one document.

Targets are the water level: a source gets its weight's share, but 3 times its own size at most, and what
is above is shared anew by weight. Sorted by cap over weight, a source is capped exactly if its cap lies
below the level that those before it leave.

Defined cases: null or blank text has size 0 and nothing is taken of it; a null source is a source, the
last; rows that repeat id and size share a key and stand in any order, with equal results; empty tables
give none; extra columns are ignored. If all is empty, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import WORD, free_name, only, text_or_empty
from refrain.session import Scratch

#: Rows of a range, about.
RANGE_ROWS = 2_000
#: Epochs at most.
REPEATS = 3


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def with_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> the same with weight and target. One row per source, so one task sorts them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("weight").over(after))
    # The level only rises along the order while sources are capped: the first uncapped one sets it.
    w = w.withColumn("open_level", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    w = w.withColumn("final", F.first("open_level", ignorenulls=True).over(everything_by(order)))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("final") * F.col("weight"))
    )
    return w.select("source", "source_size", "weight", target.alias("target"))


def everything_by(order):
    return order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    d = only(docs, doc_id="long", text="string", source="string")
    key = F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = scratch.save(d.select("doc_id", "source", words_in(text_or_empty()).alias("size"), key.alias("key")), "rows")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(lead * F.lit(ranges) / F.lit(2**32)).cast("long"))
    sums = scratch.save(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "sums")
    sources = with_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    sums_of = starts.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    starts = scratch.save(
        sums_of.select("a.source", "range", "start", "source_size", "target"), "starts"
    )
    scratch.drop("sums")
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.range") == F.col("s.range"))
    placed = placed.alias("r").join(starts.alias("s"), on).select("r.*", "start", "source_size", "target")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    taken = (whole * F.col("size") + cut).cast("long").alias("taken")
    return placed.select("doc_id", "size", "source_size", "target", taken, "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, as often as they are taken.

    Documents stay whole: the one at a source's cut is kept as a whole document, so a source may exceed
    its target by less than that one. A document without words is kept once. Rows that repeat id and size
    share how often they are taken; an empty table gives none; columns of any name come through.
    """
    ident, size, time, own_id, own_size = (free_name(docs, c) for c in ("mix_id", "mix_size", "mix_time", "row_id", "row_size"))
    n = mix_sources(docs).groupBy(F.col("doc_id").alias(ident), F.col("size").alias(size)).agg(F.max("taken").alias("taken"))
    times = F.when(F.col(size) == 0, 1).otherwise(F.ceil(F.col("taken") / F.col(size))).cast("int")
    n = n.select(ident, size, times.alias(time))
    own = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_size, words_in(text_or_empty()))
    joined = own.join(n, F.col(own_id).eqNullSafe(F.col(ident)) & (F.col(own_size) == F.col(size))).where(F.col(time) > 0)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(time))).alias(time)).drop(time)


#: DuckDB SQL for the rows of ``mix_sources``.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k,
         (sum(source_size) OVER ())::DOUBLE AS total FROM s
), f AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), o AS (
  SELECT arg_min(level, k) AS final FROM f WHERE cap / weight > level
), t AS (
  SELECT source, source_size, coalesce(least(cap, final * weight), cap)::DOUBLE AS target FROM f LEFT JOIN o ON true
), p AS (
  SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
        + greatest(0, least(size, (CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END) - before)))::BIGINT AS taken, source
FROM p
"""
