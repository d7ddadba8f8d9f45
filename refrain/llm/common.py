"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: A word: any run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that tell documents apart: the md5 of id and text.

    Rows that repeat both share a key. That is harmless where a result depends on nothing else.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat_ws("|", ident, text_or_empty(text_col)).cast("binary")))


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with these types and nothing else, so that no extra column can clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with marks behind it until no column of ``df`` has that name in any case."""
    held = {c.lower() for c in df.columns}
    while base.lower() in held:
        base += "_"
    return base


def by_pandas(df: DataFrame, each, columns: str) -> DataFrame:
    """mapInPandas with doc_id as a string meanwhile: pandas would make floats of ids with nulls among them."""
    out = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(each, f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _stars(edges: DataFrame) -> bool:
    """Does every hi of distinct edges hang on one lo, and is no lo a hi? Then nothing is left to hang elsewhere."""
    most = edges.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if most is not None and most > 1:
        return False
    return not edges.select(F.col("lo").alias("hi")).distinct().join(edges.hint("merge"), "hi", "left_semi").head(1)


def components(edges: DataFrame, scratch) -> DataFrame:
    """node, root: the smallest node that undirected edges (a, b) reach from it; nodes with edges only.

    Each round hangs every neighbour on the smallest node seen from a centre, larger neighbours first and
    smaller ones next, until all hang on the smallest of their component. Groups are only aggregated, never gathered, and each round
    is a written table. The smallest nodes are written apart, so that both sides of a join are plain shuffles
    and a centre with very many neighbours is split where the planner finds it skewed.
    """
    cur = scratch.save(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "e0"
    )
    n = 0
    while not _stars(cur):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"m{n}")
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.save(large, f"l{n}")
        down = scratch.save(large.groupBy("hi").agg(F.min("lo").alias("m")), f"d{n}")
        joined = large.join(down.hint("merge"), "hi")
        small = joined.select("hi", F.col("m").alias("lo")).union(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        nxt = scratch.save(small.distinct(), f"e{n + 1}")
        scratch.drop(f"e{n}", f"m{n}", f"l{n}", f"d{n}")
        n, cur = n + 1, nxt
    return scratch.save(cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()), "roots")
