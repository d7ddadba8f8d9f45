"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt by their own first bytes to shards of bounded size. A shard's
task builds a minimal perfect hash by displacement: n slots for n digests, each slot with the full
digest, the winner's locator (its doc_id) and how many rows it stands for. A batch's distinct digests
meet their shard; a slot is trusted only when all its 32 bytes are the digest looked up. Members join the
history's group; the others are groups of their own.

Defined cases: null text counts as empty; null doc_id sorts below every other id; of rows that repeat
both id and text one stays; an empty history or batch is fine; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import ascii_lower, free_name, only, text_or_empty
from refrain.session import Scratch

#: Digests a shard holds at most, about: it bounds a task's memory, and the number of shards follows the data.
SHARD_DIGESTS = 50_000
#: Shards per shuffle partition at least, so that a partition's load evens out.
SHARDS_EACH = 4
#: Copies of a repeated row that are unfolded at once.
COPIES = 4_096
#: Mean number of digests that share a displacement.
BUCKET_DIGESTS = 3

INDEX = "shard int, n int, displace binary, digests binary, winners binary, counts binary"
GROUPS = "digest binary, keep_id long, group_size long"
NO_ID = np.iinfo(np.int64).min


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte SHA-256 of the text with A-Z lower-cased."""
    d = only(docs, doc_id="long", text="string")
    return d.select("doc_id", F.unhex(F.sha2(ascii_lower(text_or_empty()), 256)).alias("digest"))


def per_digest(rows: DataFrame) -> DataFrame:
    """One row per distinct digest; partial aggregation makes a hot digest a row per task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return groups.withColumn("shard", (lead % shards).cast("int"))


#: Fixed odd multipliers and the 64-bit mask of the slot hash.
_M1, _M2, _M3, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit values of each digest; the first 4 bytes have chosen the shard."""
    return tuple(np.ascontiguousarray(digest[:, a : a + 8]).view("<u8")[:, 0] for a in (8, 16))


def _slot(b: int, d: int, n: int) -> int:
    """The slot that displacement ``d`` gives to value ``b``: a new even spread for every d."""
    x = (b ^ (d * _M1 & _ALL)) * _M2 & _ALL
    x = (x ^ x >> 32) * _M3 & _ALL
    return (x ^ x >> 29) % n


def build_mph(digest: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct digests (n x 32 bytes).

    Buckets are placed largest first with the smallest displacement that finds free slots; buckets of one
    digest then take the slots that are left, written as -slot - 1.
    """
    n = len(digest)
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    displace = np.zeros(buckets, np.int64)
    if not n:
        return displace
    a, b = _words(digest)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    start = np.concatenate([[0], np.cumsum(size)])
    base = b.tolist()
    taken, free = bytearray(n), 0
    order = order.tolist()
    for k in np.argsort(-size, kind="stable").tolist():
        own = order[start[k] : start[k + 1]]
        if not own:
            break
        if len(own) == 1:
            while taken[free]:
                free += 1
            displace[k], taken[free] = -free - 1, 1
            continue
        d = 0
        while True:
            slots = {_slot(base[i], d, n) for i in own}
            if len(slots) == len(own) and not any(taken[s] for s in slots):
                break
            d += 1
        displace[k] = d
        for s in slots:
            taken[s] = 1
    return displace


def slots_of(digest: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot that each digest would have; for nonmembers it is some slot or other."""
    a, b = _words(digest)
    d = displace[(a % np.uint64(len(displace))).astype(np.int64)]
    m1, m2, m3, s32, s29 = (np.uint64(v) for v in (_M1, _M2, _M3, 32, 29))
    x = (b ^ (d.astype(np.uint64) * m1)) * m2
    x = (x ^ x >> s32) * m3
    return np.where(d < 0, -d - 1, ((x ^ x >> s29) % np.uint64(n)).astype(np.int64))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digest, n = _matrix(pdf["digest"]), len(pdf)
    displace = build_mph(digest)
    slot = slots_of(digest, displace, n)
    held, winners, counts = np.zeros((n, 32), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    held[slot] = digest
    winners[slot] = pdf["top"].map(lambda x: NO_ID if pd.isna(x) else int(x)).to_numpy(np.int64)
    counts[slot] = pdf["n"].to_numpy(np.int64)
    row = [int(pdf["shard"].iloc[0]), n, *(x.tobytes() for x in (displace, held, winners, counts))]
    return pd.DataFrame([row], columns=["shard", "n", "displace", "digests", "winners", "counts"])


def _lookup(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard: every slot with what the batch adds to it, and the batch's nonmembers."""
    digest = _matrix(batch["digest"]) if len(batch) else np.zeros((0, 32), np.uint8)
    top = batch["top"].map(lambda x: NO_ID if pd.isna(x) else int(x)).to_numpy(np.int64)
    count = batch["n"].to_numpy(np.int64)
    member = np.zeros(len(digest), bool)
    parts = []
    if len(index):
        i = index.iloc[0]
        held = np.frombuffer(i["digests"], np.uint8).reshape(-1, 32)
        winners, counts = (np.frombuffer(i[c], np.int64).copy() for c in ("winners", "counts"))
        if len(digest):
            slot = slots_of(digest, np.frombuffer(i["displace"], np.int64), int(i["n"]))
            member = (held[slot] == digest).all(axis=1)
            winners[slot[member]] = np.maximum(winners[slot[member]], top[member])
            counts[slot[member]] += count[member]
        parts.append((held, winners, counts))
    parts.append((digest[~member], top[~member], count[~member]))
    held, winners, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids = pd.array(winners, dtype="Int64")
    ids[winners == NO_ID] = pd.NA
    return pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": ids, "group_size": counts})


def build_index(spark: SparkSession, history: DataFrame, scratch: Scratch, shards: int) -> DataFrame:
    """The written index: a row per shard with its displacements and slots."""
    return scratch.save(_sharded(history, shards).groupBy("shard").applyInPandas(_build, INDEX), "index")


def groups(spark: SparkSession, rows: DataFrame, historical, scratch: Scratch) -> DataFrame:
    """digest, keep_id (largest doc_id) and group_size over all rows (doc_id, digest).

    ``historical``: a condition on doc_id; those rows are the history, the others the batch.
    """
    old = scratch.save(per_digest(rows.where(historical)), "history")
    new = scratch.save(per_digest(rows.where(~historical)), "batch")
    least = SHARDS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-max(old.count(), new.count()) // SHARD_DIGESTS))
    index = build_index(spark, old, scratch, shards)
    looked = _sharded(new, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup, GROUPS)
    return scratch.save(looked, "groups")


def _is_history():
    """Half of the ids, chosen by checksum, stand for what came before."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def exact_dedup(docs: DataFrame, historical=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A repeated row (same id, same text) comes back as often as it came; one of them is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(digests(docs), "digests")
    found = groups(spark, rows, _is_history() if historical is None else historical, scratch)
    copies = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    # Hot digests: a plain sort-merge join, which AQE splits on the side of the rows.
    joined = copies.join(found.hint("merge"), "digest")
    # A row that came very often is unfolded in two steps, so that no list is longer than COPIES or its number of lists.
    last = F.floor((F.col("copies") - 1) / F.lit(COPIES))
    each = joined.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    own = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("block") * COPIES)
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), own)))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns as they came.

    Of rows that repeat id and text one stays; an empty table keeps none; columns of any name come through.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.save(digests(docs), "digests")
    found = groups(spark, rows, _is_history(), scratch)
    scratch.drop("history", "batch", "index")
    ident, digest, own_digest = (free_name(docs, c) for c in ("keep_id", "keep_digest", "own_digest"))
    stay = found.select(F.col("keep_id").alias(ident), F.col("digest").alias(digest))
    own = docs.withColumn(own_digest, F.unhex(F.sha2(ascii_lower(text_or_empty()), 256)))
    # By id first: ids are spread evenly where digests are not.
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.col(own_digest) == F.col(digest))
    once = own.join(stay, on, "left_semi")
    repeats = rows.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    if repeats:
        once = once.dropDuplicates(["doc_id", own_digest])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
