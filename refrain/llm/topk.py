"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is its signs, 64 bits, in SEGMENTS of 16. Codes are indexed by the value of each segment. The
search grows by steps: step t looks, in segment t mod SEGMENTS, at the values that differ from the query's own
in t div SEGMENTS bits. A code at distance t or less is seen by step t at the latest, so a query is done as soon
as its kth verified neighbour lies within t. Steps 0 to FIRST - 1 are taken at once, then one segment at a time,
so that the last and dearest radius is tried in as few segments as may be. Distinct codes are indexed, with how
many rows have them, so a vector that very many rows share is one entry.

The index is dealt by segment and the leading bits of its value to blocks, a block by hash to parts of PART codes
at most, and the queries of a block to parts of PART queries. A query goes to the blocks whose leading bits differ
from its own in no more bits than the step's radius. A part holds its codes sorted by value, finds the values at
the step's very distance and verifies their codes, all in arrays, and puts out the k best a query at most that are
no farther than its kth so far. No pairs go through a join.

Defined cases: null vectors and ids have no code and are left out; a missing element counts as negative; vectors
of more than BITS elements are an error; ties go to the smaller vec_id; rows that repeat vector and id count each,
and only a query's own row is left out, once; a table with fewer rows gives fewer neighbours; empty tables give
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.session import Scratch

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Steps that the first round takes at once: radius 0 to 2 in all segments.
FIRST = 3 * SEGMENTS
#: The distance of no code.
NOWHERE = BITS + 1
#: Codes, and queries, of a part.
PART = 1 << 15
#: Leading bits of a value that name its block, at least and at most.
BLOCK_BITS = (5, 12)
#: Entries of the arrays that compare a part's queries with its values at once, about.
CELLS = 1 << 21
K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 20


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code (64 sign bits as a long)."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    d = d.where("vec_id is not null and e is not null")
    bit = [F.when(F.get("e", F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    code = bit[0]
    for b in bit[1:]:
        code = code.bitwiseOR(b)
    wide = F.raise_error(F.lit(f"a vector has more than {BITS} elements")).cast("long")
    return d.select("vec_id", F.when(F.size("e") > BITS, wide).otherwise(code).alias("code"))


def segment(code, i):
    return F.shiftrightunsigned(code, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


class _Part:
    """A part's codes by the value of one segment."""

    def __init__(self, seg: int, code: np.ndarray, n: np.ndarray, least: np.ndarray):
        own = _value(code, seg)
        order = np.argsort(own, kind="stable")
        self.seg, self.code, self.n, self.least = seg, code[order], n[order], least[order]
        self.value, self.start, self.count = np.unique(own[order], return_index=True, return_counts=True)

    def near(self, q: np.ndarray, kth: np.ndarray, steps: range, k: int) -> pd.DataFrame:
        """The k best codes of every query that these steps see first, here, and that are not beyond its kth."""
        found = []
        each = max(1, CELLS // max(1, len(self.code)))
        for at in range(0, len(q), each):
            own = q[at : at + each]
            apart = np.bitwise_count(_value(own, self.seg)[:, None] ^ self.value[None, :])
            radii = [t // SEGMENTS for t in steps if t % SEGMENTS == self.seg]
            row, val = np.nonzero(np.isin(apart, radii))
            # The codes of the values found, one entry each.
            times = self.count[val]
            row = np.repeat(row, times)
            place = np.repeat(self.start[val] - np.cumsum(times) + times, times) + np.arange(len(row))
            other = own[row] ^ self.code[place]
            distance = np.bitwise_count(other)
            ok = distance <= kth[at : at + each][row]
            row, place, other, distance = row[ok], place[ok], other[ok], distance[ok]
            first = np.min([np.bitwise_count(_value(other, i)).astype(np.int64) * SEGMENTS + i for i in range(SEGMENTS)], axis=0)
            ok = (first >= steps.start) & (first < steps.stop) & (first % SEGMENTS == self.seg)
            row, place, distance = row[ok], place[ok], distance[ok]
            order = np.lexsort((self.least[place], distance, row))
            row, place, distance = row[order], place[order], distance[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            ok = nth < k
            row, place, distance = row[ok], place[ok], distance[ok]
            found.append((own[row], self.code[place], distance.astype(np.int32), self.n[place], self.least[place]))
        q, code, distance, n, least = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"q": q.view(np.int64), "code": code.view(np.int64), "distance": distance, "n": n, "least": least})


def _value(code: np.ndarray, seg: int) -> np.ndarray:
    return (code >> np.uint64(seg * WIDTH)) & np.uint64((1 << WIDTH) - 1)


def _searched(steps: range, k: int):
    """Rows sorted by part, its codes (kind 0) before its queries (kind 1); a part's codes are held, queries stream."""
    key = ["seg", "block", "i", "j"]

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, part = None, [], None
        for b in batches:
            if not len(b):
                continue
            names, kind = b[key].to_numpy(np.int64), b["kind"].to_numpy()
            code, n, least, kth = (b[c].to_numpy(np.int64) for c in ("code", "n", "least", "kth"))
            new = np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1) | (kind[1:] != kind[:-1])])
            edges = [*np.flatnonzero(new).tolist(), len(b)]
            for s, e in zip(edges, edges[1:], strict=False):
                name = tuple(names[s].tolist())
                if name != now:
                    now, held, part = name, [], None
                if kind[s] == 0:
                    held.append((code[s:e].view(np.uint64), n[s:e], least[s:e]))
                elif held:
                    if part is None:
                        part = _Part(name[0], *(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield part.near(code[s:e].view(np.uint64), kth[s:e], steps, k)

    return searched


def _places(code: str, bits: int, segs) -> list:
    """Structs of segment and block (the value's leading bits), one for each segment."""
    return [F.struct(F.lit(i).alias("seg"), F.shiftright(segment(F.col(code), i), WIDTH - bits).alias("block")) for i in segs]


def search(index: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """q, code, distance, n, least: per query code (q) codes enough to hold its k nearest rows.

    ``index``: code, n (rows that have it), least (their smallest id). ``queries``: q, distinct.
    """
    spark = index.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max(BLOCK_BITS[0], (index.count() // PART).bit_length()), BLOCK_BITS[1])
    each = index.select("code", "n", "least", F.explode(F.array(*_places("code", bits, range(SEGMENTS)))).alias("s"))
    each = each.select("s.seg", "s.block", "code", "n", "least")
    codes_in = _by_block(each, bits)
    none = F.lit(0).cast("long")
    # Every query has a row without a code that stays to the end, beyond all others.
    best = queries.select("q", none.alias("code"), F.lit(NOWHERE).alias("distance"), none.alias("n"), none.alias("least"), F.lit(False).alias("full"), F.lit(NOWHERE).cast("long").alias("kth"))
    done, names, steps, ended = [], [], range(0, FIRST), False
    of_query = Window.partitionBy("q")
    while not ended:
        radius, segs = (steps.stop - 1) // SEGMENTS, sorted({t % SEGMENTS for t in steps})
        near = [m for m in range(1 << bits) if m.bit_count() <= radius]
        left = best.where(F.col("distance") == NOWHERE).select("q", "kth", F.explode(F.array(*_places("q", bits, segs))).alias("s"))
        left = left.select("q", "kth", "s.seg", "s.block")
        # Only blocks that queries which are left may come to are planned, and only their codes are shipped.
        queries_in = _by_block(left, bits)
        if done and not queries_in.any():
            break
        plan = _plan(spark, codes_in, queries_in, near, segs)
        asks = left.select("q", "kth", "seg", "block", F.explode(F.array(*[F.lit(m) for m in near])).alias("mask"))
        asks = asks.select("q", "kth", "seg", F.col("block").bitwiseXOR(F.col("mask")).alias("block")).join(plan, ["seg", "block"])
        asks = asks.select("seg", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(F.xxhash64("q"), F.col("shares")).cast("int").alias("j"), F.lit(1).alias("kind"), F.col("q").alias("code"), none.alias("n"), none.alias("least"), "kth")
        held = each.where(F.col("seg").isin(segs)).join(plan, ["seg", "block"])
        held = held.select("seg", "block", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("j"), F.lit(0).alias("kind"), "code", "n", "least", none.alias("kth"))
        dealt = held.union(asks).repartition(tasks, "seg", "block", "i", "j").sortWithinPartitions("seg", "block", "i", "j", "kind")
        found = dealt.mapInPandas(_searched(steps, k), "q long, code long, distance int, n long, least long")
        ranked = found.union(best.select(*found.columns)).withColumn("rank", F.row_number().over(of_query.orderBy("distance", "least")))
        ranked = ranked.where((F.col("rank") <= k) | (F.col("distance") == NOWHERE))
        proven = F.sum(F.when(F.col("distance") < steps.stop, F.col("n")).otherwise(0)).over(of_query)
        kth = F.coalesce(F.max(F.when(F.col("rank") == k, F.col("distance"))).over(of_query), F.lit(NOWHERE)).cast("long")
        ranked = ranked.select(*found.columns, (proven >= k).alias("full"), kth.alias("kth"))
        names.append(f"best{steps.start}")
        round_ = scratch.save(ranked, names[-1])
        ended = steps.stop > SEGMENTS * (WIDTH + 1) - 1
        done.append(round_ if ended else round_.where("full"))
        best = round_.where("not full")
        steps = range(steps.stop, steps.stop + 1)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    found = scratch.save(out.where(F.col("distance") < NOWHERE).select("q", "code", "distance", "n", "least"), "found")
    scratch.drop(*names)
    return found


def _by_block(placed: DataFrame, bits: int) -> np.ndarray:
    """How many rows a segment's blocks have: SEGMENTS << BLOCK_BITS numbers at most."""
    out = np.zeros((SEGMENTS, 1 << bits), np.int64)
    for r in placed.groupBy("seg", "block").count().collect():
        out[r["seg"], r["block"]] = r["count"]
    return out


def _plan(spark, codes_in: np.ndarray, queries_in: np.ndarray, near: list[int], segs: list[int]) -> DataFrame:
    """seg, block, parts, shares: into how many parts a block's codes and the queries that may come to it are dealt."""
    blocks = np.arange(codes_in.shape[1])
    coming = sum(queries_in[:, blocks ^ m] for m in near)
    at = [(s, b) for s in segs for b in blocks.tolist() if codes_in[s, b] and coming[s, b]]
    seg, block = (np.array([x[i] for x in at], np.int32) for i in (0, 1))
    made = {"seg": seg, "block": block, "parts": -(-codes_in[seg, block] // PART), "shares": -(-coming[seg, block] // PART)}
    return spark.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in made.items()}))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest other rows of every query row, ties by vec_id."""
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(codes(vectors), "codes")
    index = scratch.save(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "distinct")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    # One more than k, as the query's own row is among them.
    found = search(index, scratch.save(asked.select("q").distinct(), "asked"), k + 1, scratch)
    scratch.drop("distinct", "asked")
    # Of each code the k + 1 smallest ids are enough; the limit is pushed below the shuffle.
    by_id = Window.partitionBy("code").orderBy("vec_id")
    ids = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).drop("nth")
    wide = found.select("q", "code", "distance").join(ids, "code")
    near = Window.partitionBy("q").orderBy("distance", "vec_id")
    wide = wide.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1)
    lists = wide.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near"))
    per = asked.join(lists, "q")
    own = F.array_position("near", F.struct(F.lit(0).alias("distance"), F.col("query_id").alias("vec_id")))
    # A query that is not among the first k + 1 (many equal codes with smaller ids) leaves out the last.
    at = F.when(own > 0, own).otherwise(F.lit(k + 1))
    others = F.filter("near", lambda x, i: i + 1 != at)
    per = per.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return per.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("distance"))


TOPK_SQL = """
WITH c AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END
                           FOR i IN range(64)])::UBIGINT AS code
  FROM {embeddings} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM c q JOIN c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
