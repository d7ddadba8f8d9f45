"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A run is a table bucketed and sorted by hash: in how many documents a line was found and
the largest doc_id of those. A batch's hashes are merge-anti-joined with the runs so far, bucket by bucket and without
a shuffle of the runs: a hash that a run has settled, as it is in LEAST_DOCS documents there and its largest
doc_id is no smaller than the batch's, adds no row. What is left, fresh hashes and what still changes known ones,
becomes the batch's own run. FAN runs of a level are compacted into one of the next level, so a batch meets few runs.
The last compaction over all levels gives the lines to drop, whatever the batches were.

Defined cases: null and empty texts are one empty line; a document is a row, and rows that repeat id and
text count once and get the same result; a null doc_id is below every other; if all holders of a line have
null ids, they all keep it; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import ascii_lower, only, row_key, text_or_empty
from refrain.session import Scratch

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Batches of one whole run, and runs of a level that are compacted together.
BATCHES = 3
FAN = 2

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def long_lines(docs: DataFrame) -> DataFrame:
    """doc, doc_id, pos, h: the md5 of every line key of LEAST_CHARS code points or more."""
    lines = docs.select("doc", "doc_id", F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.length("line") >= LEAST_CHARS)  # a key is no longer than its line
    lines = lines.select("doc", "doc_id", "pos", line_key(F.col("line")).alias("key"))
    hashed = F.unhex(F.md5(F.col("key").cast("binary"))).alias("h")
    return lines.where(F.length("key") >= LEAST_CHARS).select("doc", "doc_id", "pos", hashed)


class Levels:
    """Runs by level: level i holds fewer than FAN runs of FAN**i batches each; a run is a table's name."""

    def __init__(self, scratch: Scratch, spark: SparkSession):
        self.scratch, self.spark, self.levels, self.names = scratch, spark, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.option("path", self.scratch.path(name)).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.names.append(name)
        return name

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch``: h, docs, top. What no run has settled becomes a run, which is returned; then compact."""
        batch = batch.alias("b")
        for run in self.runs():
            settled = self.spark.table(run).where(F.col("docs") >= LEAST_DOCS).hint("merge").alias("r")
            # A null id is below every other.
            none_above = F.col("b.top").isNull() | (F.col("r.top") >= F.col("b.top"))
            batch = batch.join(settled, (F.col("b.h") == F.col("r.h")) & none_above, "left_anti").alias("b")
        run = self._save(batch)
        self._push(0, run)
        return self.spark.table(run)

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            merged = self._save(self._compact(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    def _compact(self, runs: list[str]) -> DataFrame:
        """The runs as one. Their files are read without their buckets: the planner takes a union of bucketed tables
        to be dealt by hash and groups it without a shuffle, but does not read it so."""
        files = self.spark.read.schema("h binary, docs long, top long").parquet(*[self.scratch.path(r) for r in runs])
        return files.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def all(self) -> DataFrame:
        return self._compact(self.runs())

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*self.names)


def line_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, kept (the text that is left): one row per document."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    d = only(docs, doc_id="long", text="string").withColumn("doc", row_key())
    lines = scratch.save(long_lines(d), "lines")
    # Of a document's equal lines one counts; partial aggregation takes most of that off the shuffle.
    levels = Levels(scratch, docs.sparkSession)
    for i in range(batches):
        part = lines.where(F.pmod(F.crc32("doc"), F.lit(batches)) == i)
        once = part.groupBy("h", "doc").agg(F.first("doc_id").alias("doc_id"))
        levels.add(once.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top")))
    found = scratch.save(levels.all().where(F.col("docs") >= LEAST_DOCS).select("h", "top"), "found")
    levels.drop()
    goes = lines.join(found.hint("merge"), "h").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    # By set: rows that repeat id and text share a doc.
    per_doc = scratch.save(goes.groupBy("doc").agg(F.collect_set("pos").alias("goes")), "goes")
    scratch.drop("lines", "found")
    joined = d.join(per_doc.hint("merge"), "doc", "left")
    parts = joined.select("doc_id", "goes", F.split(text_or_empty(), "\n", -1).alias("parts"))
    # The places that stay, by hash: in proportion to a document's lines, however many go.
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("goes", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n")
    rows = parts.select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_kept"), kept.alias("kept"))
    return rows.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_dropped"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "kept",
    )


LINES_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, pos, line, f.top IS NOT NULL AND f.top <> k.doc_id AS goes FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (goes))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
