"""Repeated byte strings by suffix arrays and their common-prefix interval trees.

Every string of ``length`` bytes (a window) that starts more than once, anywhere, is removed with all it
covers. Windows are dealt by content, so that equal ones meet: a window's key is the least hash of its
GRAM-byte grams. Consecutive windows with one key are a run. Then:

1. A key with one run, which cannot repeat within itself, is done: nothing equals it, and only the keys were
   shuffled to find that. The other keys' runs of equal content form a class, and a class goes on as one run
   and how often it occurs.
2. Shards of these classes get an enhanced suffix array (sorted suffixes and longest common
   prefixes). A stack scan yields the common-prefix intervals, a class that occurs often being a leaf that
   counts as often; those whose occurrences differ in the byte before them are maximal repeats. All
   occurrences are covered, or put out with their group (``repeat_groups``).
3. A key with over HOT classes (a passage that very many texts share) would make a shard too large. Its
   windows are dealt singly by their hash, and counted: the exact way for such keys.

A repeat that goes on over several runs is a group in each of them, and so are the pieces of RUN windows of
a text that repeats within itself.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat id and
text repeat each other, and go whole if long enough; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import only, row_key, text_or_empty
from refrain.session import Scratch

LENGTH = 400
GRAM = 128
#: Classes of a key that a shard takes: with runs of 672 bytes (more only where a gram comes again) as much as SHARD_BYTES.
HOT = 512
#: Windows of a run, and windows that are hashed at once.
RUN = 1024
BLOCK = 1 << 17
#: Bytes of a suffix array, and rows of an output batch, about.
SHARD_BYTES = 1 << 19
ROWS = 10_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of every gram."""
    n = len(data)
    power = np.ones(n, np.uint64)
    power[1:] = _BASE
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(np.cumprod(power) * (data.astype(np.uint64) + np.uint64(1)), out=prefix[1:])
    back = np.ones(n - gram + 1, np.uint64)
    back[1:] = _INVERSE
    h = (prefix[gram:] - prefix[:-gram]) * np.cumprod(back)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values, from running minima of blocks both ways."""
    n = len(h) - width + 1
    pad = -len(h) % width
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, bytes, int, int, bool]]:
    """(key, content hash, start, windows, may repeat within itself) of every run of a text."""
    found: list[list] = []
    n = len(data) - length + 1
    buf = np.frombuffer(data, np.uint8)
    for at in range(0, n, BLOCK):
        stop = min(at + BLOCK, n)
        h = _gram_hashes(buf[at : stop + length - 1], gram)
        least = _sliding_min(h, length - gram + 1)
        cut = np.flatnonzero(np.diff(least)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(least)]])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            key = least[s]
            self_like = e - s > 1 and int((h[s : e - 1 + length - gram + 1] == key).sum()) > 1
            if found and s == 0 and found[-1][0] == key:
                # A run goes on over the border of a block; whether it repeats within itself is left open.
                found[-1][2:] = [at + e, True]
            else:
                found.append([key, at + s, at + e, self_like])
    out = []
    for key, start, end, self_like in found:
        for a in range(start, end, RUN):
            b = min(a + RUN, end)
            out.append((int(key.view(np.int64)), xxhash.xxh3_128_digest(data[a : b - 1 + length]), a, b - a, self_like))
    return out


#: Symbols that the first ranks look at: 9 bits each, as a mark below all bytes ends every text.
FIRST = 7


class SuffixArray:
    """Chosen suffixes of several texts, sorted, with the longest common prefixes of neighbours.

    Ranks of prefixes of FIRST, 2 FIRST, 4 FIRST, ... symbols come from sorting pairs of the ranks before;
    they also give common prefixes by trying the lengths from the largest down.
    """

    def __init__(self, contents: list[bytes], least: int):
        sizes = np.array([len(c) for c in contents], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1  # the mark's place
        self.begins = self.ends - sizes
        raw = np.frombuffer(b"".join(c + b"\0" for c in contents), np.uint8)
        self.data = raw.astype(np.int64) + 1
        self.data[self.ends] = 0
        n = len(raw)
        padded = np.concatenate([self.data, np.zeros(FIRST, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(FIRST):
            key = key << 9 | padded[i : i + n]
        ranks, h = [(FIRST, np.unique(key, return_inverse=True)[1].astype(np.int64))], FIRST
        while h <= int(sizes.max()):
            r = ranks[-1][1]
            after = np.zeros(n, np.int64)
            after[: max(n - h, 0)] = r[h:] + 1
            h *= 2
            ranks.append((h, np.unique(r * np.int64(n + 2) + after, return_inverse=True)[1].astype(np.int64)))
        at = [np.arange(b, e - least + 1) for b, e in zip(self.begins, self.ends, strict=True) if e - b >= least]
        start = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.start = start[np.argsort(ranks[-1][1][start], kind="stable")]
        a, b = self.start[:-1].copy(), self.start[1:].copy()
        self.lcp = np.zeros(len(a), np.int64)
        for h, r in reversed(ranks):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = r[a[inside]] == r[b[inside]]
            self.lcp[same] += h
            a[same] += h
            b[same] += h
        for _ in range(FIRST - 1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = self.data[a[inside]] == self.data[b[inside]]
            going = same if not _ else going & same
            self.lcp[going] += 1
            a[going] += 1
            b[going] += 1
        left = self.ends[np.searchsorted(self.ends, self.start)] - self.start
        self.lcp = np.minimum(self.lcp, np.minimum(left[:-1], left[1:]))


def maximal_repeats(sa: SuffixArray, least: int, times: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of all occurrences) of every left-diverse common-prefix interval of ``least`` or more.

    A text stands for as many equal ones as ``times`` says. Where it is no prefix of another suffix, its leaf is
    an interval of its own; what precedes those texts is open, so that it counts as diverse.
    """
    lcp, first = sa.lcp, np.isin(sa.start, sa.begins)
    text = np.searchsorted(sa.ends, sa.start)
    own = sa.ends[text] - sa.start
    beside = np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]]))[: len(own)]
    for i in np.flatnonzero(first & (times[text] > 1) & (own > beside)).tolist():
        yield int(own[i]), sa.start[i : i + 1]
    before = np.where(first, -1 - np.arange(len(sa.start)), sa.data[sa.start - 1])
    hit = np.flatnonzero(lcp >= least)
    if not len(hit):
        return
    # Where the common prefix falls below ``least`` the stack is empty: the scan starts anew behind it.
    for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
        lo, hi = int(part[0]), int(part[-1]) + 2
        left, heights = before[lo:hi].tolist(), lcp[lo : hi - 1].tolist() + [0]
        # Open intervals: common prefix, first place, the byte before all so far (None: they differ).
        stack: list[list] = []
        for i, height in enumerate(heights):
            begin, char = i, left[i]
            while stack and stack[-1][0] > height:
                top, begin, seen = stack.pop()
                char = seen if seen == char else None
                if char is None:
                    yield top, sa.start[lo + begin : lo + i + 1]
            if stack and stack[-1][0] == height:
                if stack[-1][2] != char:
                    stack[-1][2] = None
            elif height:
                stack.append([height, begin, char])


def _sharing(contents: list[bytes], length: int) -> np.ndarray:
    """Which texts may share a string of ``length`` bytes with another or within themselves, by hash: never too few."""
    on = np.zeros(len(contents), bool)
    sizes = np.array([len(c) for c in contents], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return on
    text = np.repeat(np.arange(len(contents)), windows)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = _gram_hashes(np.frombuffer(b"".join(contents), np.uint8), length)[(np.cumsum(sizes) - sizes)[text] + inside]
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    on[text[order[same]]] = on[text[order[same + 1]]] = True
    return on


def _groups(contents: list[bytes], times: list[int], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, places in them) of every maximal repeat of the texts given.

    A text that shares no string of ``length`` bytes has a leaf only, and no need to be sorted among the others.
    """
    sharing = _sharing(contents, length)
    for t in np.flatnonzero(~sharing).tolist():
        if times[t] > 1 and len(contents[t]) >= length:
            yield len(contents[t]), np.array([t]), np.array([0])
    own = np.flatnonzero(sharing)
    if len(own):
        sa = SuffixArray([contents[t] for t in own.tolist()], length)
        for depth, found in maximal_repeats(sa, length, np.array(times)[own]):
            text = np.searchsorted(sa.ends, found)
            yield depth, own[text], found - sa.begins[text]


def covered(contents: list[bytes], times: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per text, the bytes that windows cover which start twice or more in the texts given: (from, to)."""
    sizes = np.array([len(c) for c in contents], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    marks = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    for depth, text, at in _groups(contents, times, length):
        np.add.at(marks, begins[text] + at, 1)
        np.add.at(marks, begins[text] + at + depth, -1)
    on = np.cumsum(marks[:-1]) > 0
    out = []
    for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on[b : b + n].view(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def occurrences(contents: list[bytes], times: list[int], length: int = LENGTH) -> list[list[tuple[int, int, bytes]]]:
    """Per text, the places of the maximal repeats of the texts given: (from, to, hash of the repeated string)."""
    out: list[list] = [[] for _ in contents]
    for depth, text, at in _groups(contents, times, length):
        group = xxhash.xxh3_128_digest(contents[text[0]][at[0] : at[0] + depth])
        for t, a in zip(text.tolist(), at.tolist(), strict=True):
            out[t].append((a, a + depth, group))
    return out


def _emit_runs(length: int):
    layout = ["doc", "key", "content", "start", "windows", "self_like"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc"], b["text"], strict=True):
                rows.extend((d, *r) for r in runs_of((t or "").encode(), length))
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=layout)
                    rows = []
            yield pd.DataFrame(rows, columns=layout)

    return run


def _fetch(length: int):
    """Content of the runs asked for; of hot keys a row per window instead, with the window's hash."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for text, asked in zip(b["text"], b["asked"], strict=True):
                data = (text or "").encode()
                for a in asked:
                    own = data[a["start"] : a["start"] + a["windows"] - 1 + length]
                    if a["hot"]:
                        rows.extend(
                            (a["key"], a["content"], a["n"], None, xxhash.xxh3_128_digest(own[i : i + length]), i)
                            for i in range(a["windows"])
                        )
                    else:
                        rows.append((a["key"], a["content"], a["n"], own, None, None))
                    size += len(own) if not a["hot"] else a["windows"] * 64
                    if size > 1 << 20:
                        yield _fetched(rows)
                        rows, size = [], 0
            if rows:
                yield _fetched(rows)

    return fetch


def _fetched(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "content", "n", "bytes", "window", "at"])
    out["at"] = out["at"].astype("Int32")
    return out


def _shard(length: int, grouped: bool):
    """Rows (key, content, n, bytes) sorted by key and content; a suffix array for about SHARD_BYTES of whole keys.

    A class that came twice, as rows that repeat id and text bring it, is taken once.
    """

    def solved(rows: list) -> pd.DataFrame:
        own, times = [r[3] for r in rows], [r[2] for r in rows]
        if grouped:
            spans = [[{"a": a, "b": b, "group": g} for a, b, g in s] for s in occurrences(own, times, length)]
        else:
            spans = [[{"a": a, "b": b, "group": None} for a, b in s] for s in covered(own, times, length)]
        out = [(k, c, s) for (k, c, _, _), s in zip(rows, spans, strict=True) if s]
        return pd.DataFrame(out, columns=["key", "content", "spans"])

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for b in batches:
            for row in zip(b["key"].tolist(), b["content"], b["n"].tolist(), b["bytes"], strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if size > SHARD_BYTES and row[0] != rows[-1][0]:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield solved(rows)

    return shard


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"], strict=True):
            data = (text or "").encode()
            gone = _merged(spans) if spans is not None else []
            digest, at = hashlib.sha256(), 0
            for x, y in gone:
                digest.update(data[at:x])
                at = y
            digest.update(data[at:])
            rows.append((doc_id, len(data), sum(y - x for x, y in gone), len(gone), digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


SPANS = "array<struct<a:long,b:long,group:binary>>"


def _repeats(d: DataFrame, scratch: Scratch, length: int, grouped: bool) -> DataFrame:
    """doc, spans (from, to, group): a row per run of the texts (doc, text) that holds repeats.

    ``grouped``: every occurrence of every group; otherwise merged spans within each run, without groups.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = "doc binary, key long, content binary, start long, windows int, self_like boolean"
    runs = scratch.save(d.select("doc", "text").mapInPandas(_emit_runs(length), layout), "runs")
    # The keys are written apart, so that both sides of the join are plain shuffles and a key of very many runs is split.
    met = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("self_like").alias("inner")).where("n > 1 or inner")
    met = scratch.save(met.select("key"), "keys")
    runs = scratch.save(runs.join(met.hint("merge"), "key", "left_semi").drop("self_like"), "met")
    scratch.drop("runs", "keys")
    classes = runs.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start", "windows")).alias("one"))
    classes = scratch.save(classes, "classes")
    keys = classes.groupBy("key").agg((F.count(F.lit(1)) > HOT).alias("hot"))
    asked = classes.join(keys.hint("merge"), "key")
    if not grouped:
        # In a hot key a class of several runs goes whole, which its count shows; its windows still meet the single runs'.
        whole = asked.where("hot and n > 1").select("key", "content")
    asked = asked.select("one.doc", F.struct("key", "content", "n", "one.start", "one.windows", "hot").alias("a"))
    asked = asked.groupBy("doc").agg(F.collect_list("a").alias("asked"))
    once = d.select("doc", "text").join(asked.hint("merge"), "doc")
    fetched = once.select("text", "asked").mapInPandas(
        _fetch(length), "key long, content binary, n long, bytes binary, window binary, at int"
    )
    fetched = scratch.save(fetched, "fetched")
    cold = fetched.where(F.col("bytes").isNotNull()).select("key", "content", "n", "bytes")
    cold = cold.repartition(n, "key").sortWithinPartitions("key", "content")
    spans = cold.mapInPandas(_shard(length, grouped), f"key long, content binary, spans {SPANS}")
    hot = fetched.where(F.col("window").isNotNull()).select("key", "content", "n", "window", "at")
    # Two places of a window, or one in a class of several runs. A row that came twice is the same place.
    place = F.xxhash64("content", "at")
    often = hot.groupBy("window").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("n").alias("n"))
    often = often.where("x <> y or n > 1").select("window")
    hot = hot.join(often.hint("merge"), "window") if grouped else hot.where("n = 1").join(often.hint("merge"), "window")
    span = F.struct(
        F.col("at").cast("long").alias("a"), (F.col("at") + length).cast("long").alias("b"),
        (F.col("window") if grouped else F.lit(None).cast("binary")).alias("group"),
    )
    parts = spans.union(hot.groupBy("key", "content").agg(F.collect_set(span).alias("spans")))
    if not grouped:
        parts = parts.union(whole.select("key", "content", F.lit(None).cast(SPANS).alias("spans")))
    gone = runs.join(parts.hint("merge"), ["key", "content"])
    all_of_it = F.array(
        F.struct(F.lit(0).cast("long").alias("a"), (F.col("windows") - 1 + length).cast("long").alias("b"), F.lit(None).cast("binary").alias("group"))
    )
    shifted = F.transform(
        F.coalesce("spans", all_of_it),
        lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"), s["group"].alias("group")),
    )
    return gone.select("doc", shifted.alias("spans"))


def repeated_spans(d: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """doc, spans (from, to; they may overlap): what goes of the texts (doc, text)."""
    gone = _repeats(d, scratch, length, grouped=False)
    gone = gone.select("doc", F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("spans"))
    return gone.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _documents(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="long", text="string").select("doc_id", text_or_empty().alias("text"), row_key().alias("doc"))


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """repeat (16 bytes, hash of the string), size, doc_id, at: a row per occurrence of every maximal repeat.

    ``at`` and ``size`` count UTF-8 bytes. A repeat is maximal within its run; in keys of over HOT classes the
    groups are single windows. Rows that repeat id and text share a key, and each is named as often as it came.
    """
    d = _documents(docs)
    found = _repeats(d, Scratch(docs.sparkSession, "repeat-groups"), length, grouped=True)
    each = found.select("doc", F.explode("spans").alias("s"))
    ids = d.select("doc", "doc_id").distinct()
    return each.join(ids, "doc").select(F.col("s.group").alias("repeat"), (F.col("s.b") - F.col("s.a")).alias("size"), "doc_id", F.col("s.a").alias("at"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    d = _documents(docs)
    spans = scratch.save(repeated_spans(d, scratch, length), "spans")
    scratch.drop("met", "classes", "fetched")
    joined = d.join(spans.hint("merge"), "doc", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans")
    out = joined.mapInPandas(_cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
