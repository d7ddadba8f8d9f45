"""Queries over streams and over what runs leave behind, with their SQL. Streams are made of the given tables by Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from refrain.operators import alignment, catalog, incremental, sequences
from refrain.plans import registry
from refrain.session import Scratch, table
from refrain.sources import feeds, files, streams
from refrain.streaming import ingest, isolation, status

AS_OF = "2024-01-31 00:00:00"
#: What an event stands for in the log of a group's work.
KINDS = {"signup": "found", "click": "started", "purchase": "done", "error": "failed", "view": "finished"}


def _log(spark, sf_dir):
    """Users are groups: their events found, start, end and finish items."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.floor("value") % 7 + 1).alias("n"), F.col("event_id").alias("item"))


def _shown(s):
    return status.with_eta(s, F.lit(AS_OF)).withColumn("started", F.unix_micros(F.col("started_at").cast("timestamp"))).drop("started_at")


def group_status(spark, sf_dir):
    """The status machine as keyed state of a stream over the log, with the times left."""
    scratch = Scratch(spark, "status")
    log = scratch.save(_log(spark, sf_dir), "log")
    tracked = status.track(spark.readStream.schema(log.schema).parquet(scratch.path("log")))
    status.keep(tracked, scratch.path("kept"), scratch.path("checkpoint")).awaitTermination()
    return _shown(status.current(spark.read.parquet(scratch.path("kept"))))


def progress_status(spark, sf_dir):
    """A group's page: progress by counts, status and times left by the log; groups without a log are idle."""
    counts = registry.group_progress(spark, sf_dir).select(F.col("c_custkey").alias("id"), "total", "processed", "progress_pct")
    held = _shown(status.statuses(_log(spark, sf_dir))).select("id", "status", "current", "eta_s", "eta_min")
    return counts.join(held, "id", "left").withColumn("status", F.coalesce("status", F.lit("idle")))


def ingested_once(spark, sf_dir):
    """Keys of line items through a stream of several batches, once each; what was shipped before 1995 is too old."""
    scratch = Scratch(spark, "ingested")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").repartition(6)
    source = scratch.save(lines, "source")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(scratch.path("source"))
    late = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")
    ingest.ingest_once(stream, scratch.path("target"), scratch.path("checkpoint"), ["l_orderkey", "l_linenumber"], late=late).awaitTermination()
    return ingest.added(spark, scratch.path("target")).select("l_orderkey", "l_linenumber")


def streamed_feed(spark, sf_dir):
    """Feeds of all groups, written as XML and read again as a stream of entries."""
    scratch = Scratch(spark, "feed")
    feeds.write_feeds(registry.full_feeds(spark, sf_dir), scratch.path("feeds"))
    stream = feeds.stream_feed(spark, scratch.path("feeds"), 4)
    ingest.ingest_once(stream, scratch.path("target"), scratch.path("checkpoint"), ["guid"]).awaitTermination()
    got = ingest.added(spark, scratch.path("target"))
    return got.select("guid", "title", "description", F.unix_seconds(F.col("pub_date").cast("timestamp")).alias("at"), "audio_url", F.col("duration_s").cast("long").alias("seconds"))


def isolated_items(spark, sf_dir):
    """A step of one user at a time that raises for some: their error, and the others' results."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        if rows["event_type"].iloc[0] == "error":
            raise ValueError("began with an error")
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "k": [int(rows["k"].sum())]})

    e = table(spark, sf_dir, "events").where("user_id is not null")
    e = e.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows, failed = isolation.isolated(e, "user_id", each, "user_id long, k long")
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def stored_streams(spark, sf_dir):
    """Hash streams of documents from a store that is read through: half of the items first, then all."""
    path = Scratch(spark, "streams").path("store")
    docs = registry._docs(spark, sf_dir).where("id is not null")

    def compute(items):
        hashes = registry._fingerprints(spark, sf_dir).join(items.select("id"), "id", "left_semi")
        listed = hashes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("x"))
        return items.select("id").join(listed, "id", "left").select("id", F.coalesce(F.transform("x", lambda x: x["h"]), F.array().cast("array<bigint>")).alias("fp"))

    streams.stored(docs.where("grp < 'src4'"), path, compute)
    got = streams.stored(docs, path, compute)
    return got.select("id", F.size("fp").alias("n"), F.aggregate("fp", F.lit(0).cast("long"), lambda s, h: s + h).alias("total"))


def recomputed_offsets(spark, sf_dir):
    """Offset clusters of all documents after those with a label came last: only pairs with one of them are computed again."""
    docs = registry._docs(spark, sf_dir)
    fresh = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    stored = alignment.text_offsets(docs.join(fresh, "id", "left_anti"))
    flagged = docs.join(fresh.withColumn("fresh", F.lit(True)), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return incremental.merged_pairs(stored, alignment.text_offsets(flagged), fresh)


def home_page(spark, sf_dir):
    """The six newest groups with their progress."""
    p = registry.group_progress(spark, sf_dir)
    return registry.newest_groups(spark, sf_dir).select("c_custkey").join(p, "c_custkey").select("c_custkey", "c_name", "total", "processed", "progress_pct")


def hash_neighbours(spark, sf_dir):
    """Distances of the documents' hashes to those beside them."""
    return sequences.hamming_neighbours(registry._fingerprints(spark, sf_dir))


def served_items(spark, sf_dir):
    """What a feed may list: processed items whose day's archive is there. Spark writes archives for the days of urgent processed orders."""
    path = Scratch(spark, "served").path("archive")
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    done = F.col("o_orderstatus") == "F"
    urgent = o.where(done & (F.col("o_orderpriority") == "1-URGENT") & F.col("day").isNotNull())
    urgent.select("day", F.col("o_orderkey").cast("string").alias("value")).repartition("day").write.partitionBy("day").text(path)
    archives = files.files_below(spark, path).select(F.substring_index("name", "/", 1).alias("name"))
    items = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.concat(F.lit("day="), "day").alias("path"))
    return catalog.served(items, done, "path", archives).select("c_custkey", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (group_status, progress_status, ingested_once, streamed_feed, isolated_items, stored_streams, recomputed_offsets, home_page, hash_neighbours, served_items)
}

_KIND = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())
_STATUS = f"""lg AS (SELECT user_id AS id, ts, event_id AS item, CASE event_type {_KIND} END AS kind, floor(value)::BIGINT % 7 + 1 AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    fd AS (SELECT *, coalesce(max(CASE WHEN kind = 'found' THEN r END) OVER (PARTITION BY id), 0) AS f FROM lg),
    dn AS (SELECT *, max(CASE WHEN kind = 'done' AND r > f THEN r END) OVER (PARTITION BY id) AS d FROM fd),
    st AS (SELECT id, coalesce(arg_max(CASE kind WHEN 'found' THEN 'downloading' WHEN 'started' THEN 'processing' ELSE 'idle' END, r) FILTER (kind IN ('found', 'started', 'finished')), 'idle') AS status,
        CASE WHEN arg_max(kind, r) FILTER (kind IN ('started', 'finished')) = 'started' THEN arg_max(item, r) FILTER (kind IN ('started', 'finished')) END AS current,
        (count(*) FILTER (kind = 'started' AND r > f AND r < d))::BIGINT AS processed, coalesce(max(n) FILTER (r = f), 0)::BIGINT AS total, max(epoch_us(ts)) FILTER (r = f) AS started FROM dn GROUP BY id),
    el AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - started) / 1000000.0::DOUBLE AS elapsed FROM st),
    et AS (SELECT *, CASE WHEN status = 'processing' AND processed > 0 THEN elapsed / processed * (total - processed) END AS left_ FROM el),
    ss AS (SELECT id, status, current, processed, total, started, trunc(left_)::BIGINT AS eta_s, round(left_ / 60, 1) AS eta_min,
        CASE WHEN status = 'processing' AND current IS NOT NULL THEN trunc(CASE WHEN processed > 0 THEN elapsed / processed ELSE {status.PRIOR} END)::BIGINT END AS item_eta_s FROM et)"""
_FP = f"""t AS (SELECT doc_id AS id, {registry._TOK} AS w FROM documents),
    fp AS (SELECT id, unnest(range(len(w)))::INT AS pos, ('0x' || left(md5(unnest(w)), 8))::BIGINT AS h FROM t)"""

SQL = {
    "group_status": f"WITH {_STATUS} SELECT * FROM ss",
    "progress_status": f"""WITH {_STATUS} SELECT c_custkey AS id, p.total, p.processed, progress_pct, coalesce(status, 'idle') AS status, current, eta_s, eta_min
        FROM ({registry._PROGRESS}) p LEFT JOIN ss ON ss.id = c_custkey""",
    "ingested_once": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate IS NULL OR l_shipdate >= TIMESTAMP '1995-01-01'",
    "streamed_feed": """SELECT DISTINCT lpad(o_orderkey::VARCHAR, 10, '0') AS guid, 'Part ' || o_orderkey AS title, coalesce(o_orderpriority, '') AS description, epoch(o_orderdate)::BIGINT AS at,
        'http://host/audio/' || o_orderkey AS audio_url, 60::BIGINT AS seconds FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer)""",
    "isolated_items": """WITH u AS (SELECT user_id, arg_min(event_type, event_id) = 'error' AS bad, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events WHERE user_id IS NOT NULL GROUP BY 1)
        SELECT user_id, CASE WHEN NOT bad THEN k END AS k, CASE WHEN bad THEN 'ValueError: began with an error' END AS error FROM u""",
    "stored_streams": f"WITH {_FP} SELECT t.id, len(any_value(w))::INT AS n, coalesce(sum(h), 0)::BIGINT AS total FROM t LEFT JOIN fp ON fp.id = t.id GROUP BY t.id",
    "recomputed_offsets": registry.SQL["offset_clusters"],
    "home_page": f"""SELECT c_custkey, c_name, total, processed, progress_pct FROM ({registry._PROGRESS})
        WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_orderdate) DESC NULLS LAST, 1 LIMIT 6)""",
    "served_items": """SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'
        AND o_orderdate::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
    "hash_neighbours": f"""WITH {_FP} SELECT id, pos, least(coalesce(bit_count(xor(h, lag(h) OVER w)), 32), coalesce(bit_count(xor(h, lead(h) OVER w)), 32), 32)::INT AS d
        FROM fp WINDOW w AS (PARTITION BY id ORDER BY pos)""",
}
