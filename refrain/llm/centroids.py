"""Centroid clustering (Lloyd's rounds in whole numbers) filtered by ball trees.

Every task keeps metric trees of its own vectors, at most TREE in each, written once: a node is a ball and has its
radius, how many vectors it holds and their sum as whole numbers. In a round a tree is gone through from its root. A
ball's nearest centroid is d away from its middle; by the triangle inequality no centroid farther than d + 2 * radius
is nearest to any vector in it. If one centroid is left, the ball goes to it whole, by count and sum. Else its halves
are looked at with the centroids that are left, and in a leaf the vectors one by one, in whole numbers. What leaves a task
are its centroids' counts and sums.

Defined cases: vectors that are null, have another length than DIM or a null or non-finite component are left out; a
component over 2^27 / 256 is an error, as squared distances would not fit in 64 bits; ties go to the smaller number;
null ids are clustered as others but start no centroid while others can; rows that repeat count each; with fewer vectors than
centroids each starts one; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm import integers
from refrain.llm.integers import DIM
from refrain.session import Scratch

K, ROUNDS, SEED = 40, 5, 2
#: Vectors of a tree, and of a leaf, at most.
TREE, LEAF = 4096, 24


def bounds(n: int) -> list[np.ndarray]:
    """For every level the places where its balls start, and n."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > LEAF:
        a = out[-1]
        out.append(np.concatenate([np.stack([a[:-1], (a[:-1] + a[1:]) // 2], axis=1).ravel(), a[-1:]]))
    return out


def grown(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the vectors, and radius and sum of all balls, level by level: halves at the widest component's median."""
    levels, order = bounds(len(v)), np.arange(len(v))
    for at in levels[:-1]:
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = v[order[a:b]]
            widest = np.argmax(own.max(0) - own.min(0))
            order[a:b] = order[a:b][np.argpartition(own[:, widest], (a + b) // 2 - a)]
    own, radius, sums = v[order], [], []
    for at in levels:
        sums.append(np.add.reduceat(own, at[:-1], axis=0))
        size = np.diff(at)
        middle = sums[-1] / size[:, None]
        far = np.sqrt(((own - np.repeat(middle, size, axis=0)) ** 2).sum(1))
        radius.append(np.maximum.reduceat(far, at[:-1]))
    return order, np.concatenate(radius), np.concatenate(sums)


class Tree:
    def __init__(self, v: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.v, self.radius, self.sums = v, radius, sums
        self.levels = bounds(len(v))

    def assigned(self, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The nearest centroid of all vectors, and the balls that went whole: (first, behind, ball, centroid)."""
        out, whole = np.zeros(len(self.v), np.int64), []
        balls, left = np.zeros(1, int), np.ones((1, len(c)), bool)
        before = 0
        for depth, at in enumerate(self.levels):
            size = np.diff(at)
            middle = self.sums[before + balls] / size[balls][:, None]
            far = np.sqrt(np.maximum(((middle[:, None, :] - c[None]) ** 2).sum(2), 0)) if len(balls) * len(c) < 512 else self._far(middle, c)
            nearest = np.where(left, far, np.inf).min(1)
            reach = nearest + 2 * self.radius[before + balls]
            # A little more than the inequality asks, for what floats round off.
            left &= far <= (reach * (1 + 1e-6) + 1e-3)[:, None]
            one = left.sum(1) == 1
            for ball, to in zip(balls[one], left[one].argmax(1), strict=True):
                whole.append((at[ball], at[ball + 1], before + ball, to))
                out[at[ball] : at[ball + 1]] = to
            balls, left = balls[~one], left[~one]
            before += len(at) - 1
            if not len(balls):
                break
            if depth + 1 < len(self.levels):
                balls, left = np.stack([2 * balls, 2 * balls + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)
            else:
                rows = np.concatenate([np.arange(at[x], at[x + 1]) for x in balls])
                d = integers.squares(self.v[rows], c)
                d[~np.repeat(left, size[balls], axis=0)] = np.iinfo(np.int64).max
                out[rows] = d.argmin(1)
        return out, whole

    @staticmethod
    def _far(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        b = c.astype(np.float64)
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0))

    def contributions(self, c: np.ndarray) -> np.ndarray:
        """A row for each centroid: the sum of its vectors, and their count. Whole balls give theirs as they are."""
        out = np.zeros((len(c), DIM + 1), np.int64)
        to, whole = self.assigned(c)
        single = np.ones(len(self.v), bool)
        for a, b, ball, k in whole:
            single[a:b] = False
            out[k, :DIM] += self.sums[ball]
            out[k, DIM] += b - a
        np.add.at(out[:, DIM], to[single], 1)
        order = np.argsort(to[single], kind="stable")
        k, rows = to[single][order], self.v[single][order]
        if len(k):
            starts = np.flatnonzero(np.diff(k, prepend=-1))
            out[k[starts], :DIM] += np.add.reduceat(rows, starts, axis=0)
        return out


TREES = "ids array<long>, v binary, radius binary, sums binary"


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TREE):
            part = b.slice(at, TREE)
            v = integers.whole(part.column("e"))
            order, radius, sums = grown(v)
            ids = part.column("vec_id").take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (v[order].astype("<i4").tobytes(), radius.tobytes(), sums.tobytes()))],
                ["ids", "v", "radius", "sums"],
            )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Tree]]:
    for b in batches:
        for ids, v, radius, sums in zip(*(b.column(c) for c in ("ids", "v", "radius", "sums")), strict=True):
            tree = Tree(integers.unpacked([v.as_py()]).reshape(-1, DIM), np.frombuffer(radius.as_py()), np.frombuffer(sums.as_py(), np.int64).reshape(-1, DIM))
            yield ids.as_py(), tree


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; k does not grow with the data."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "e").limit(k).select("e").collect()
    return integers.whole(pa.array([r["e"] for r in first], pa.list_(pa.float64())))


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: one row per usable vector."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    usable = integers.kept(vectors)
    trees = scratch.save(usable.mapInArrow(_planted, TREES), "trees")
    c = starts(usable, k, seed)

    for _ in range(rounds if len(c) else 0):

        def added(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(c), DIM + 1), np.int64)
            for _, tree in _trees(batches):
                out += tree.contributions(c)
            yield integers.slots(out.ravel())

        sums = integers.by_slot(trees.mapInArrow(added, "slot long, total long"), len(c) * (DIM + 1)).reshape(-1, DIM + 1)
        held = sums[:, DIM] > 0
        c = np.where(held[:, None], sums[:, :DIM] // np.maximum(sums[:, DIM:], 1), c)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            to, _ = tree.assigned(c)
            d = ((tree.v - c[to]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(to.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    found = scratch.save(trees.mapInArrow(final, "vec_id long, cluster int, distance long"), "found")
    scratch.drop("trees")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(c))]).cast("array<long>")
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for x in c.tolist()]).cast("array<string>")
    return found.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )


def clusters_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL: distances to all centroids, round by round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, sha256('{seed}:' || vec_id) AS h FROM {{embeddings}}
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS k, v AS c FROM v QUALIFY row_number() OVER (ORDER BY h, v) <= {k})",
    ]
    for r in range(rounds + 1):
        dist = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, min({{'d': {dist}, 'k': k}}) AS x FROM v, c{r} GROUP BY vec_id, v)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT k, i, floor(sum(y) / count(*)::DOUBLE)::BIGINT AS m FROM (SELECT x.k AS k, unnest(v) AS y, unnest(range({DIM})) AS i FROM a{r}) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m ORDER BY i) AS m FROM s{r} GROUP BY k) USING (k))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, x.k AS cluster, x.d AS distance, sum(x.d) OVER (PARTITION BY x.k)::BIGINT AS cluster_inertia, sum(x.d) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = x.k"""
