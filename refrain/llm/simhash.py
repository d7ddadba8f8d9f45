"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at THRESHOLD differing bits or fewer. Each half of 32 bits is covered by
anchors: the words of the [31,26] Hamming code (covering radius 1), with the 32nd bit as it is. Of two
fingerprints that link, one half differs in at most half the threshold, 2 bits, so some word of that half
lies 1 bit from both; its anchor is within 1 + 1 bits of both. So each fingerprint is replicated to every
anchor that is nearest to a word at most 1 bit away, 33 per half at most, and fingerprints are compared in
full anchor by anchor. All work is on distinct fingerprints, so copies of a text cost nothing.

An anchor's members are compared in blocks of BLOCK; an anchor with more is dealt out as pairs of blocks.
Within a block no pairs are put out but the edges of a spanning forest.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; null ids
never name a component unless it has no other; repeated rows come back each; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import by_pandas, components, free_name, only
from refrain.session import Scratch

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Members of an anchor that one comparison takes at once.
BLOCK = 512
#: Shingle hashes whose bits are counted at once.
HASHES = 1 << 14


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles, repeats included; unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, HASHES):
        part = words[i : min(i + HASHES, n) + SHINGLE - 1]
        quads = zip(part, part[1:], part[2:], part[3:], strict=False)
        h = np.fromiter((digest(b" ".join(q), SEED) for q in quads), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = [_signed(fingerprint(t)) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array(fps, np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    return by_pandas(only(docs, doc_id="long", text="string"), _fingerprints, "fp long")


def _code_words(half: np.ndarray) -> np.ndarray:
    """The nearest word of the code to each 32-bit word: the syndrome names the bit to flip."""
    syndrome = np.zeros(len(half), np.uint32)
    for i in range(31):
        syndrome ^= np.where(half >> np.uint32(i) & np.uint32(1), np.uint32(i + 1), np.uint32(0))
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0))
    return half ^ flip


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): each row's anchors, once each."""
    moves = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint32)
    near = _code_words((half[:, None] ^ moves[None, :]).ravel()).reshape(len(half), -1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(first)[0], near[first]


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = b["fp"].to_numpy(np.int64)
        for half in (0, 1):
            word = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
            row, anchor = anchors(word)
            yield pd.DataFrame({"anchor": anchor.astype(np.int64) + (half << 32), "fp": fp[row]})


def _near(one: np.uint64, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many) <= THRESHOLD


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, out = fp, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            hit = _near(one, left)
            if hit.any():
                found = left[hit]
                out.extend((int(one), int(x)) for x in found)
                front.extend(found)
                left = left[~hit]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (task, fp) sorted by task: a task's rows are compared together; the last one stays open."""
    rest_t, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def compared(t: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(t)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
        size, a, b = ends - starts, [], []
        two = starts[size == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= THRESHOLD]
        a.append(f[two])
        b.append(f[two + 1])
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            pairs = np.array(forest(f[s:e]), np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    for batch in batches:
        t = np.concatenate([rest_t, batch["task"].to_numpy(np.int64)])
        f = np.concatenate([rest_f, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(t):
            continue
        cut = int(np.searchsorted(t, t[-1]))
        rest_t, rest_f = t[cut:], f[cut:]
        if cut:
            yield compared(t[:cut], f[:cut])
    if len(rest_t):
        yield compared(rest_t, rest_f)


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links enough to span every component of the distinct fingerprints (fp)."""
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(n, "fp")
    placed = spread.mapInPandas(_replicate, "anchor long, fp long")
    counted = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counted = scratch.save(counted, "anchors")
    # Anchors of one member go; larger ones than a block become pairs of blocks.
    own = placed.join(counted.hint("merge"), "anchor")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = own.select("anchor", "fp", block.alias("i"), blocks.alias("n"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = F.xxhash64("anchor", F.least("i", "j"), F.greatest("i", "j")).alias("task")
    tasks = dealt.select(task, "fp").repartition(n, "task").sortWithinPartitions("task")
    return tasks.mapInPandas(_links, "a long, b long").distinct()


def near_components(docs: DataFrame, name: str = "simhash") -> DataFrame:
    """doc_id, fp (signed), component_id (smallest doc_id reachable)."""
    scratch = Scratch(docs.sparkSession, name)
    rows = scratch.save(fingerprints(docs), "rows")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = scratch.save(links(distinct.select("fp"), scratch), "links")
    scratch.drop("anchors")
    roots = components(edges, scratch)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = scratch.save(named.join(tops, "root").select("fp", "component_id"), "ids")
    scratch.drop("distinct", "links", "roots")
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row per document."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return near_components(docs).select("doc_id", hexed, "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents with all their columns, of each component the one with the smallest doc_id.

    Rows that repeat id and text stay once; documents without an id stay if their component has none with
    an id, once per text. Null and blank texts are one group with all that link to fingerprint zero. An empty
    table keeps none; columns of any name come through.
    """
    found = near_components(docs, "simhash-keep")
    ident = free_name(docs, "stay_id")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(ident)).distinct()
    kept = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
