"""MinHash near-duplicates by circulant permutations, with exact Jaccard verification.

A document's set is its distinct shingles of SHINGLE words. Two permutations give all signature coordinates: the
first puts a shingle on a circle of 2^32 places, the second, turned by k places, ranks the circle for coordinate k,
and the coordinate is the least rank. ROWS coordinates make a band. Two sets of similarity 0.85 share none of the
BANDS bands with probability (1 - 0.85^6)^40, about 6 in 10^9, and more similar ones still less often.

Texts of equal words are a class, and all work is on one text of every class. Classes that share a band hang on the
band's least class; what hangs together is a cluster of candidates. A cluster's members are dealt out in blocks, each
with the cluster's least member in it, and a block puts out the edges of a spanning forest of its links, found by
comparing full sets. Clusters of several blocks that this leaves apart are compared once more, block by block. No
pairs are put out but the edges of forests, and no link between members of a cluster is lost.

Defined cases: null, empty and blank texts have no shingles and link with nothing; texts with fewer words than a
shingle have the whole sequence as their one; null ids never name a component unless it has no other, and are kept
only then; rows that repeat come back each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import components, only, row_key
from refrain.session import Scratch

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS, BANDS = 6, 40
#: Members, and shingles of all members, of a block, about.
MEMBERS, CELLS = 256, 1 << 21
#: Shingles whose ranks are computed at once, and words whose hashes are remembered.
AT_ONCE, REMEMBERED = 512, 1 << 20
SPREAD = np.uint32(0x85EBCA6B)

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], known: _Words) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = len(w) - SHINGLE + 1
    if n < 1:
        return _mixed((w * _ODD[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    h = w[:n] * _ODD[0]
    for i in range(1, SHINGLE):
        h += w[i : i + n] * _ODD[i]
    return np.unique(_mixed(h))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Circulant:
    """Signatures of many sets at once."""

    def __init__(self, coordinates: int = ROWS * BANDS):
        self.turns = np.arange(coordinates, dtype=np.uint32)[:, None] * SPREAD
        self.x = np.empty((coordinates, AT_ONCE), np.uint32)
        self.y = np.empty_like(self.x)

    def ranks(self, places: np.ndarray) -> np.ndarray:
        """Row k: the rank of every place on the circle turned by k."""
        x, y = self.x[:, : len(places)], self.y[:, : len(places)]
        # (place - turn) * SPREAD, then the rest of the permutation.
        np.subtract(places * SPREAD, self.turns, out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        return np.multiply(x, np.uint32(0xC2B2AE35), out=x)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of coordinates for each set; none of the sets is empty."""
        size = np.array([len(s) for s in sets])
        places = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        owner = np.repeat(np.arange(len(sets)), size)
        out = np.full((len(sets), len(self.turns)), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(places), AT_ONCE):
            own = owner[at : at + AT_ONCE]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(self.ranks(places[at : at + AT_ONCE]), starts, axis=1).T
            rows = own[starts]
            out[rows] = np.minimum(out[rows], least)
        return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A row of BANDS signed 64-bit keys for each signature; a band's number is part of its key."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = parts[:, :, 0] * _ODD[0]
    for i in range(1, ROWS):
        keys = _mixed(keys + parts[:, :, i] * _ODD[i])
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, rk, text to doc_id, rk, key, n, bands; equal texts of a batch are computed once."""
    known, circle = _Words(), Circulant()
    for b in batches:
        place: dict[bytes, int] = {}
        sets, at, keys = [], [], []
        for text in b.column("text"):
            words = split(text.as_py())
            key = hashlib.md5(b" ".join(words)).digest() if words else None
            if key is not None and key not in place:
                place[key] = len(sets)
                sets.append(shingle_set(words, known))
            keys.append(key)
            at.append(-1 if key is None else place[key])
        found = bands(circle.signatures(sets)) if sets else np.zeros((0, BANDS), np.int64)
        found = np.concatenate([found, np.zeros((1, BANDS), np.int64)])[at]
        size = np.array([*map(len, sets), 0], np.int64)[at]
        flat = pa.ListArray.from_arrays(np.arange(0, len(at) * BANDS + 1, BANDS, dtype=np.int32), found.ravel())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rk"), pa.array(keys, pa.binary()), pa.array(size), flat], ["doc_id", "rk", "key", "n", "bands"]
        )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, rk (names id and text), key (names the words; null without), n (set size), bands."""
    plain = only(docs, doc_id="long", text="string").withColumn("rk", row_key())
    return plain.mapInArrow(_signed, "doc_id long, rk binary, key binary, n long, bands array<long>")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets: a set that is linked needs no second link."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(flat.max(initial=0) + 1, bool)
    out: list[tuple[int, int]] = []
    left = np.arange(len(order))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            # Only sets of a like size can link; left is in order of size.
            a, b = np.searchsorted(size[left], [-(-size[one] * PERCENT // 100), size[one] * 100 // PERCENT + 1])
            near = left[a:b]
            if not len(near):
                continue
            own = flat[start[one] : start[one + 1]]
            held[own] = True
            lens = size[near]
            ends = np.cumsum(lens)
            cells = np.repeat(start[near] - (ends - lens), lens) + np.arange(ends[-1])
            both = np.add.reduceat(held[flat[cells]], ends - lens, dtype=np.int64)
            held[own] = False
            hit = 100 * both >= PERCENT * (size[one] + lens - both)
            found = near[hit]
            if len(found):
                out.extend((int(order[one]), int(order[x])) for x in found)
                front.extend(found)
                left = np.concatenate([left[:a], near[~hit], left[b:]])
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, key, label, text) sorted by task to the links a, b of each task; tasks of one label give none."""
    known = _Words()
    task, keys, texts, labels = None, [], [], set()

    def compared() -> pa.RecordBatch:
        edges = forest([shingle_set(split(t), known) for t in texts]) if len(labels) > 1 else []
        a, b = [keys[i] for i, _ in edges], [keys[j] for _, j in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for batch in batches:
        for t, k, label, text in zip(*(batch.column(c).to_pylist() for c in ("task", "key", "label", "text")), strict=True):
            if t != task:
                if len(keys) > 1:
                    yield compared()
                task, keys, texts, labels = t, [], [], set()
            keys.append(k)
            texts.append(text)
            labels.add(label)
    if len(keys) > 1:
        yield compared()


def _confirmed(tasks: DataFrame) -> DataFrame:
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.select("task", "key", "label", "text").repartition(n, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_links, "a binary, b binary")


def candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: classes that share a band, each with the band's least class."""
    each = classes.select("key", F.explode("bands").alias("band"))
    buckets = each.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.save(buckets.select("band", "least"), "buckets")
    stars = each.join(buckets.hint("merge"), "band").where("key <> least")
    stars = scratch.save(stars.select(F.col("key").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    scratch.drop("buckets")
    return stars


def links(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """key, label: the least class that links reach, for classes with links; None where there are no candidates."""
    spark = docs.sparkSession
    stars = candidates(classes, scratch)
    if not stars.head(1):
        return None
    clusters = components(stars, Scratch(spark, "minhash-clusters"))
    own = classes.select("key", "rk", "n").join(clusters.withColumnRenamed("node", "key"), "key")
    size = own.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("cells"))
    blocks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("cells") / CELLS)).cast("int").alias("blocks")
    own = scratch.save(own.join(size.select("root", blocks), "root"), "own")
    text = only(docs, doc_id="long", text="string").withColumn("rk", row_key()).select("rk", "text")
    # Rows that repeat id and text have one rk: one text of each class stays.
    met = text.join(own.hint("merge"), "rk").groupBy("key", "root", "blocks").agg(F.first("text").alias("text"))
    met = scratch.save(met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "texts")
    # A cluster's least member stands in all its blocks.
    every = F.when(F.col("key") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = met.select("key", F.col("key").alias("label"), "text", "root", F.explode(every).alias("i"))
    found = scratch.save(_confirmed(first.withColumn("task", F.xxhash64("root", "i"))), "links1")
    labels = components(found, Scratch(spark, "minhash-first"))
    large = own.where("blocks > 1").select("key", "root").join(labels.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left")
    large = scratch.save(large.withColumn("label", F.coalesce("label", "key")), "large")
    apart = large.groupBy("root").agg((F.min("label") != F.max("label")).alias("apart")).where("apart")
    apart = scratch.save(large.join(apart.select("root"), "root", "left_semi").select("key", "label"), "apart")
    if apart.head(1):
        # Pairs of blocks of the clusters that are still apart; pairs inside a block are done.
        mixed = met.join(apart, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        mixed = mixed.withColumn("task", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")))
        more = scratch.save(_confirmed(mixed), "links2")
        labels = components(found.union(more), Scratch(spark, "minhash-all"))
    return labels.select(F.col("node").alias("key"), F.col("root").alias("label"))


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row per document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.save(signed(docs), "rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, "classes")
    labels = links(docs, classes, scratch)
    named = classes.select("key", "least")
    if labels is None:
        ids = named.withColumnRenamed("least", "component_id")
    else:
        named = named.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        tops = named.groupBy("label").agg(F.min("least").alias("component_id"))
        ids = named.join(tops, "label").select("key", "component_id")
    ids = scratch.save(ids, "ids")
    scratch.drop("classes", "stars", "own", "texts", "links1", "links2", "large", "apart")
    worded = rows.where("key is not null").select("doc_id", "n", "key").join(ids.hint("merge"), "key").select("doc_id", "n", "component_id")
    blank = rows.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return worded.union(blank).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


#: Fixed values of the contract: words, shingles of five, 85 percent.
MINHASH_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {documents}
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 85 * (u.n + v.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, t.doc_id = c AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS c FROM r GROUP BY 1) ON node = t.doc_id
"""
