"""Streams, the status machine, errors of single items, stored streams, recompute of what changed."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from refrain.operators import catalog, incremental, sequences
from refrain.session import exists
from refrain.sources import feeds, files, streams
from refrain.streaming import ingest, isolation, status

LOG = "id long, at timestamp, seq long, kind string, n long, item long"


def log(spark, *events):
    """events: id, second, seq, kind, n or item."""
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), q, k, x if k == "found" else None, x if k != "found" else None) for i, s, q, k, x in events]
    return spark.createDataFrame([(a, b.to_pydatetime(), *c) for a, b, *c in rows], LOG)


def shown(df):
    return {r["id"]: (r["status"], r["current"], r["processed"], r["total"]) for r in df.collect()}


WORK = [
    (1, 0, 0, "found", 4), (1, 1, 1, "started", 11), (1, 5, 2, "done", 11), (1, 6, 3, "started", 12), (1, 7, 4, "failed", 12), (1, 8, 5, "started", 13),
    (1, 9, 6, "done", 13), (2, 0, 7, "found", 2), (3, 0, 8, "found", 1), (3, 1, 9, "started", 31), (3, 2, 10, "done", 31), (3, 3, 11, "finished", None),
    (4, 0, 12, "started", 41), (5, 3, 13, "failed", 5),
]
AFTER = [(1, 20, 20, "finished", None), (2, 20, 21, "started", 21), (2, 20, 22, "done", 21), (3, 30, 23, "found", 7)]
WANT = {1: ("processing", 13, 3, 4), 2: ("downloading", None, 0, 2), 3: ("idle", None, 1, 1), 4: ("processing", 41, 0, 0), 5: ("idle", None, 0, 0)}
THEN = WANT | {1: ("idle", None, 3, 4), 2: ("processing", 21, 1, 2), 3: ("downloading", None, 0, 7)}


def test_status_machine_goes_on_after_a_restart(spark, tmp_path):
    """A done item counts those that were started before it, failed ones too; a batch that comes twice changes nothing."""
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def run():
        status.keep(status.track(spark.readStream.schema(LOG).parquet(src)), out, cp).awaitTermination()
        return shown(status.current(spark.read.parquet(out)))

    log(spark, *WORK).repartition(3).write.parquet(src)
    assert run() == WANT == shown(status.statuses(log(spark, *WORK)))
    log(spark, *WORK[:6]).write.mode("append").parquet(src)
    assert run() == WANT
    log(spark, *AFTER).write.mode("append").parquet(src)
    assert run() == THEN == shown(status.statuses(log(spark, *WORK, *AFTER)))


def test_machine_by_log_and_by_event(spark):
    """Any log gives the same by grouping and event by event."""
    r = random.Random(9)
    events = [(r.randrange(6), r.randrange(40), q, r.choice(["found", "started", "done", "failed", "finished"]), r.randrange(9)) for q in range(200)]
    want = {}
    for i in {e[0] for e in events}:
        m = status._Machine(None)
        for _, s, q, k, x in sorted((e for e in events if e[0] == i), key=lambda e: e[1:3]):
            m.apply(s, q, k, x if k == "found" else None, x if k != "found" else None)
        want[i] = (m.status, m.current, m.processed, m.total)
    assert shown(status.statuses(log(spark, *events))) == want


def test_times_left(spark):
    s = status.with_eta(status.statuses(log(spark, *WORK)), F.lit("2024-01-01 00:01:30"), F.lit(40))
    got = {r["id"]: (r["eta_s"], r["eta_min"], r["item_eta_s"]) for r in s.collect()}
    # 90 s for 3 of 4; 60 percent of one left. Nothing is done of item 41: its group never found anything, so no time is known.
    assert got == {1: (30, 0.5, 18), 2: (None, None, None), 3: (None, None, None), 4: (None, None, 27), 5: (None, None, None)}


def test_served_items_have_a_file(spark, tmp_path):
    """Processed, with a path, and the file is there; two items may share a file, and a folder that is not there holds none."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.mp3").write_bytes(b"x")
    (tmp_path / "2 é.mp3").write_bytes(b"xy")
    found = files.files_below(spark, f"file://{tmp_path}")
    assert {(r["name"], r["length"]) for r in found.collect()} == {("a/1.mp3", 1), ("2 é.mp3", 2)}
    rows = [(1, "F", "a/1.mp3"), (2, "F", "2 é.mp3"), (3, "P", "2 é.mp3"), (4, "F", None), (5, "F", "gone.mp3"), (6, "F", "2 é.mp3"), (7, None, "a/1.mp3")]
    items = spark.createDataFrame(rows, "id long, status string, path string")
    out = catalog.served(items, F.col("status") == "F", "path", found)
    assert out.columns == items.columns and {r["id"] for r in out.collect()} == {1, 2, 6}
    none = files.files_below(spark, str(tmp_path / "none"))
    assert none.count() == 0 and catalog.served(items, F.col("status") == "F", "path", none).count() == 0


def test_ingest_once_reads_no_target(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def run(*names):
        spark.createDataFrame([(n, d) for n, d in names], "g string, d string").coalesce(1).write.mode("append").parquet(src)
        q = ingest.ingest_once(spark.readStream.schema("g string, d string").parquet(src), out, cp, ["g"], late=F.col("d") < "2023", broken=F.col("g").isNull())
        q.awaitTermination()
        return q

    run(("a", "2024"), ("b", None), ("a", "2025"), ("old", "2020"), (None, "2024"))
    q = run(("b", "2024"), ("c", "2024"), ("old", "2021"))
    # A second run of the same checkpoint: keys of the first are known, though no plan scans what it wrote.
    assert not [x for x in q._jsq.explainInternal(True).splitlines() if "Scan" in x and out in x]
    assert [s["description"] for s in q.lastProgress["sources"]] == [f"FileStreamSource[file:{src}]"]
    assert Counter(r["g"] for r in ingest.added(spark, out).collect()) == Counter("abc")
    assert [tuple(r) for r in ingest.added(spark, out, broken=True).collect()] == [(None, "2024")]


def test_ingest_forgets_behind_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for rows in ([("a", "2024-01-01"), ("b", "2024-01-02")], [("a", "2024-01-05"), ("c", "2024-03-01")], [("d", "2024-01-06"), ("e", "2024-03-02"), ("c", "2024-03-03")]):
        df = spark.createDataFrame(rows, "g string, d string").select("g", F.col("d").cast("timestamp").alias("d"))
        df.coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_once(spark.readStream.schema("g string, d timestamp").parquet(src), out, cp, ["g"], forget=("d", "14 days")).awaitTermination()
    # d comes over two weeks behind what was seen and is dropped; c is known.
    assert Counter(r["g"] for r in spark.read.parquet(out).collect()) == Counter("abce")


FEED = (
    '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>P</title>{}</channel></rss>'
)


def item(n):
    return f'<item><title>E{n}</title><guid>g{n}</guid><enclosure url="http://h/{n}.mp3" type="audio/mpeg"/></item>'


def test_a_feed_is_polled_until_it_is_stopped(spark, tmp_path):
    """With a trigger by time: new files are found, a stop ends it, and a restart adds only what came since."""
    src, out, cp = (tmp_path / x for x in ("src", "out", "cp"))
    src.mkdir()

    def start():
        return ingest.ingest_once(feeds.stream_feed(spark, str(src)), str(out), str(cp), ["guid"], processingTime="500 milliseconds")

    def held():
        return Counter(r["guid"] for r in spark.read.parquet(str(out)).collect())

    (src / "a.xml").write_text(FEED.format(item(1) + item(2)))
    q = start()
    q.processAllAvailable()
    assert held() == Counter(["g1", "g2"])
    (src / "b.xml").write_text(FEED.format(item(2) + item(3)))
    q.processAllAvailable()
    assert held() == Counter(["g1", "g2", "g3"])
    q.stop()
    assert not q.isActive
    (src / "c.xml").write_text(FEED.format(item(1) + item(4)))
    q = start()
    q.processAllAvailable()
    q.stop()
    assert held() == Counter(["g1", "g2", "g3", "g4"])


def test_written_feeds_are_read_again(spark, tmp_path):
    groups = spark.range(5).select(F.col("id").alias("group"), F.lit("N").alias("name"))
    items = spark.range(40).select((F.col("id") % 4).alias("group"), F.col("id").cast("string").alias("guid"), F.lit("T & t").alias("title"), F.lit("http://h").alias("audio_url"), F.lit(5).alias("duration_s"), F.lit(None).cast("timestamp").alias("pub_date"))
    feeds.write_feeds(feeds.feeds(groups, items), str(tmp_path / "f"))
    got = feeds.read_feed(spark, str(tmp_path / "f")).collect()
    assert {(r["guid"], r["title"]) for r in got} == {(str(i), "T & t") for i in range(40)} and len(got) == 40


def test_transcripts_missing_and_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"transcription":[{"offsets":{"from":0,"to":1500},"text":" hi "},{"offsets":{"from":1500,"to":2000},"text":" "}]}')
    (tmp_path / "b.json").write_text('{"transcription":[]}')
    (tmp_path / "c.json").write_text('{"transcription":[{"offsets":{"from":0,"to":9},"text":" "}]}')
    got = {r["file"].rsplit("/", 1)[1]: r["n_segments"] for r in feeds.transcript_files(spark, str(tmp_path)).collect()}
    assert got == {"a.json": 1, "b.json": 0, "c.json": 0}


def test_an_item_s_error_costs_that_item(spark):
    def each(rows):
        if (rows["v"] < 0).any():
            raise ValueError(f"bad {rows['v'].min()}")
        return pd.DataFrame({"id": rows["id"], "w": rows["v"] * 2})

    df = spark.createDataFrame([(1, 5), (1, 6), (2, 1), (2, -7), (3, 4)], "id long, v long")
    rows, failed = isolation.isolated(df, "id", each, "id long, w long")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 10), (1, 12), (3, 8)]
    assert [tuple(r) for r in failed.collect()] == [(2, "ValueError: bad -7")]


def test_streams_are_computed_once(spark, tmp_path):
    store = str(tmp_path / "store")
    asked = spark.sparkContext.accumulator(0)

    def compute(items):
        asked.add(items.count())
        return items.select("id", F.array(F.col("id") * 2, F.col("id")).alias("fp"))

    def ids(df):
        return sorted((r["id"], tuple(r["fp"])) for r in df.collect())

    items = spark.range(6)
    assert ids(streams.stored(items.where("id < 4"), store, compute)) == [(i, (2 * i, i)) for i in range(4)] and asked.value == 4
    files = spark.read.parquet(store).inputFiles()
    assert ids(streams.stored(items.where("id < 3"), store, compute)) == [(i, (2 * i, i)) for i in range(3)]
    assert asked.value == 4 and sorted(spark.read.parquet(store).inputFiles()) == sorted(files)
    assert len(ids(streams.stored(items, store, compute))) == 6 and asked.value == 6
    assert exists(spark, store) and not exists(spark, store + "x")
    flat = streams.unfolded(streams.stored(items.where("id = 5"), store, compute), spark.createDataFrame([(5, 1)], "id long, grp int"))
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 5, 0, 10), (1, 5, 1, 5)]


@pytest.fixture
def marks(spark):
    r = random.Random(3)
    rows = [(g, g * 100 + i, p, r.randrange(40) + 1000 * (i % 3)) for g in range(3) for i in range(8) for p in range(30)]
    return spark.createDataFrame(rows, "grp int, id long, pos int, h long").cache()


def votes(m):
    return sequences.votes(m).select("a", "b", "off", "votes")


def test_only_what_changed_is_computed_again(spark, marks):
    """New items and those that share a mark with one: the results are those of all, and fewer marks are read."""
    fresh = spark.createDataFrame([(1,), (104,)], "id long")
    stored = votes(marks.join(fresh, "id", "left_anti"))
    read = []

    def compute(m):
        read.append(m.count())
        return votes(m)

    want = Counter(tuple(x) for x in votes(marks).collect())
    assert Counter(tuple(x) for x in incremental.updated_pairs(stored, marks, fresh, compute).collect()) == want
    # Items of a group share marks in classes of three: the others' are not read.
    assert 0 < read[0] < marks.count() / 3
    near = {r["id"] for r in incremental.frontier(marks, fresh).collect()}
    assert {1, 104} <= near and all(i // 100 in (0, 1) for i in near) and {i % 100 % 3 for i in near} == {1}


def test_only_changed_items_are_replaced(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old"), (2, "older"), (3, "old")], "id long, x string")
    got = incremental.updated_items(stored, spark.createDataFrame([(2,), (4,)], "id long"), lambda ids: ids.withColumn("x", F.lit("new")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "old"), (2, "new"), (3, "old"), (4, "new")]
    # An item for which nothing is found any more has no rows left.
    got = incremental.updated_items(stored, spark.createDataFrame([(2,)], "id long"), lambda ids: ids.withColumn("x", F.lit("new")).limit(0))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "old"), (3, "old")]
