"""Compression of vectors to codes: Lloyd's rounds for every part's codebook, maintained by differences.

A vector of DIM whole numbers is cut into PARTS; a part's code is the nearest entry of that part's codebook. Assignments of
the last round are a written table beside the vectors, and so are the running sums and counts of all entries. A round
assigns anew, and only parts whose entry changed give something: plus to the new entry, minus from the old one, summed in
the task before it is shuffled. Parts that stay cost no row.

Defined cases: vectors that are null, have another length than DIM or a null or non-finite component are dropped; a
component over 2^27 / 256 is an error; ties go to the lower entry; null ids are coded as others but start no entry while
others can; rows that repeat count each; with fewer vectors than entries the codebooks are shorter; null labels are
one label; a table without the column label has null labels; extra columns are ignored; an empty table gives none.
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

PARTS, ENTRIES, ROUNDS = 16, 64, 2
WIDTH = DIM // PARTS
#: Of an entry: its sums, and its count.
FIELDS = WIDTH + 1
STATE = "vec_id long, label string, v binary, codes binary, was binary"


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector its parts' entries and their squared distances. books: part, entry, place."""
    codes, error = np.zeros((len(v), PARTS), np.uint8), np.zeros((len(v), PARTS), np.int64)
    for p in range(PARTS):
        d = integers.squares(v[:, p * WIDTH : (p + 1) * WIDTH], books[p])
        codes[:, p] = d.argmin(1)
        error[:, p] = d.min(1)
    return codes, error


def _rows(b: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.uint8).reshape(-1, PARTS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = pa.array(integers.packed(integers.whole(b.column("e"))), pa.binary())
        none = pa.nulls(b.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v, none, none], ["vec_id", "label", "v", "codes", "was"])


def _assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, _ = nearest(integers.unpacked(b.column("v").to_pylist()).reshape(-1, DIM), books)
            new = pa.array([x.tobytes() for x in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), new, b.column("codes")], ["vec_id", "label", "v", "codes", "was"])

    return state.mapInArrow(each, STATE)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose codes changed to slot, total: what entries gain and lose in this task."""
    out = np.zeros((PARTS, ENTRIES, FIELDS), np.int64)
    for b in batches:
        v = integers.unpacked(b.column("v").to_pylist()).reshape(-1, PARTS, WIDTH)
        codes, first = _rows(b, "codes").astype(int), b.column("was").null_count == b.num_rows
        was = codes if first else _rows(b, "was").astype(int)
        moved = np.ones(codes.shape, bool) if first else codes != was
        row, part = np.nonzero(moved)
        gain = np.concatenate([v[row, part], np.ones((len(row), 1), np.int64)], axis=1)
        np.add.at(out, (part, codes[row, part]), gain)
        if not first:
            np.subtract.at(out, (part, was[row, part]), gain)
    yield integers.slots(out.ravel())


def _start(state: DataFrame) -> np.ndarray:
    """The codebooks made of the smallest ids' vectors, ENTRIES at most."""
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    v = integers.unpacked([bytes(r["v"]) for r in first]).reshape(-1, PARTS, WIDTH)
    return v.transpose(1, 0, 2).copy()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per usable vector."""
    scratch = Scratch(vectors.sparkSession, "codes")
    label = F.col("`label`") if "label" in map(str.lower, vectors.columns) else F.lit(None)
    usable = integers.kept(vectors, label.cast("string").alias("label"))
    state = scratch.save(usable.mapInArrow(_whole, STATE), "state0")
    books = _start(state)
    sums = None
    for n in range(1, ROUNDS + 1 if books.size else 1):
        state = scratch.save(_assign(state, books), f"state{n}")
        scratch.drop(f"state{n - 1}")
        moved = state.where("was is null or codes <> was").select("v", "codes", "was")
        gained = moved.mapInArrow(_differences, "slot long, total long")
        sums = gained if sums is None else sums.union(gained)
        sums = scratch.save(sums.groupBy("slot").agg(F.sum("total").alias("total")), f"sums{n}")
        held = integers.by_slot(sums, PARTS * ENTRIES * FIELDS).reshape(PARTS, ENTRIES, FIELDS)[:, : books.shape[1]]
        count = held[:, :, WIDTH:]
        books = np.where(count > 0, held[:, :, :WIDTH] // np.maximum(count, 1), books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = nearest(integers.unpacked(b.column("v").to_pylist()).reshape(-1, DIM), books)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([x.tobytes().hex() for x in codes]), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    found = scratch.save(state.mapInArrow(final, "vec_id long, label string, code string, error long"), "found")
    scratch.drop(*(f"state{n}" for n in range(ROUNDS + 1)), *(f"sums{n}" for n in range(ROUNDS + 1)))
    labels = found.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = found.join(labels, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def codes_sql() -> str:
    """The same in SQL, every round from all parts."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM {{embeddings}}
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"p AS MATERIALIZED (SELECT vec_id, label, p, v[p * {WIDTH} + 1:(p + 1) * {WIDTH}] AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM v))",
        f"f AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS k FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT p, k, x AS c FROM p JOIN f USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        dist = "+".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, WIDTH + 1))
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': ({dist})::BIGINT, 'k': k}}) AS a FROM p JOIN c{r} USING (p) GROUP BY ALL)")
        if r < ROUNDS:
            means = ", ".join(f"floor(sum(x[{i}]) / count(*)::DOUBLE)::BIGINT" for i in range(1, WIDTH + 1))
            parts.append(f"m{r} AS (SELECT p, a.k AS k, [{means}] AS m FROM a{r} GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))")
    return f"""WITH {", ".join(parts)},
        e AS (SELECT vec_id, label, string_agg(lower(printf('%02x', a.k)), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
        b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, b"""
