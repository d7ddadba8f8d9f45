"""Hand-derived cases of the engine's operators."""

from pyspark.sql import functions as F

from refrain.functions import lexicon, scalar
from refrain.operators import catalog, detection, intervals, sequences
from refrain.sources import feeds
from refrain.streaming.ingest import ingest


def spans(spark, *xs):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in xs], "id long, start double, end double")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_union_and_complement(spark):
    u = intervals.union(spans(spark, (0, 5), (7, 8), (10.1, 12), (11, 11.5)), ["id"], 2.0)
    assert pairs(u, "start", "end") == [(0, 8), (10.1, 12)]
    assert pairs(intervals.union(spans(spark, (0, 10), (2, 3), (12, 13)), ["id"], 2.0), "start", "end") == [(0, 13)]
    c = intervals.complement(spans(spark, (10, 20), (50, 55)).withColumn("whole", F.lit(60.0)), ["id"], "whole")
    assert pairs(c, "start", "end") == [(0, 10), (20, 50), (55, 60)]


def test_splices(spark):
    assert pairs(intervals.splices(spans(spark, (10, 20), (50, 55), (60, 70)), ["id"]), "start", "splice") == [(10, 10), (50, 40), (60, 45)]
    assert pairs(intervals.splices(spans(spark, (0, 10), (5, 15)), ["id"]), "splice") == [(0,), (0,)]


def test_greedy(spark):
    runs = spark.createDataFrame([(1, 0.0, 10.0, 0.05), (1, 9.0, 15.0, 0.08), (1, 9.6, 20.0, 0.1), (1, 30.0, 35.0, 0.2)], "id long, start double, end double, ber double")
    assert pairs(intervals.greedy(runs, ["id"]), "start") == [(0,), (9.6,), (30,)]


def test_text_between(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 5.0, "a"), (1, 1, 5.0, 10.0, "b"), (1, 2, 10.0, 15.0, "c")], "id long, idx int, start double, end double, text string")
    out = intervals.text_between(spans(spark, (5, 10), (4.9, 10.1)), seg, ["id"])
    assert pairs(out, "text") == [("a b c",), ("b",)]


def test_offsets(spark):
    v = spark.createDataFrame([(1, 2, o, n) for o, n in {-3: 1, 10: 5, 12: 4, 15: 8, 100: 7}.items()], "a long, b long, off int, votes long")
    assert pairs(sequences.offsets(v), "off", "votes") == [(10, 9), (15, 8)]


def test_error_runs(spark):
    import random

    r = random.Random(1)
    block = [r.getrandbits(32) for _ in range(100)]
    own = {i: [r.getrandbits(32) for _ in range(300 + 10 * i)] for i in (1, 2)}
    fp = {1: own[1][:50] + block + own[1][50:], 2: own[2][:80] + block + own[2][80:]}
    df = spark.createDataFrame([(0, i, p, h) for i, hs in fp.items() for p, h in enumerate(hs)], "grp int, id long, pos int, h long")
    out = sequences.error_runs(sequences.offsets(sequences.votes(df)), df).where("a = 1").collect()
    assert len(out) == 1 and abs(out[0]["start"] - 50 / 8.06) < 1.2 and abs(out[0]["end"] - 150 / 8.06) < 1.2


def test_durations_and_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("1:02:03", "62:03", "45", "abc", "1:2:3:4", "", "12.5")], "t string")
    assert [r[0] for r in df.select(scalar.duration_seconds(F.col("t"))).collect()] == [3723, 3723, 45, None, None, None, None]
    d = spark.createDataFrame([("Mon, 1 Jan 2024 10:00:00 +0200",), ("x",)], "t string").select(scalar.feed_date(F.col("t")).cast("string"))
    assert [r[0] for r in d.collect()] == ["2024-01-01 08:00:00", None]


def test_lexicon(spark):
    df = spark.createDataFrame([("Use promo code SAVE at example.com",), ("go to our site dot com",), ("(upbeat music)",), ("welcome back everyone",)], "t string")
    t = F.col("t")
    got = df.select(lexicon.strong_hits(t), lexicon.weak_hits(t), lexicon.word_count(t), lexicon.is_ad(t), lexicon.is_strong_ad(t), lexicon.is_annotation(t), lexicon.is_break(t)).collect()
    assert tuple(got[0])[:5] == (2, 1, 6, True, True) and tuple(got[1])[:5] == (1, 1, 6, True, False)
    assert got[2][5] and not got[3][5] and got[3][6]


def test_detection(spark):
    ev = spark.createDataFrame([(1, o, 10.0, 22.0) for o in (2, 3, 4, 5)] + [(1, 2, 60.0, 70.0), (1, 6, 0.0, 200.0)], "id long, other long, start double, end double")
    lengths = spark.createDataFrame([(i, 500.0) for i in range(1, 7)], "id long, length double")
    seg = spark.createDataFrame([(1, 0, 60.0, 70.0, "use promo code now")], "id long, idx int, start double, end double, text string")
    out = detection.detect(ev, seg, lengths).collect()
    assert [(r["start"], r["end"], r["n_matches"], r["method"], r["confidence"]) for r in out] == [(10.0, 70.0, 4, "audio_repeat+bridge+transcript", 0.9)]


def test_excerpt_is_the_final_cut_s(spark):
    regs = spark.createDataFrame([(1, 10.0, 30.004, 4, "audio_repeat", 0.9, "old"), (2, 0.0, 9.0, 2, "audio_repeat", 0.8, "old"), (2, 20.0, 24.0, 2, "short", 0.8, "old")], "id long, start double, end double, n_matches int, method string, confidence double, excerpt string")
    seg = spark.createDataFrame([(1, 0, 5.0, 12.0, "one"), (1, 1, 12.0, 30.0, "two"), (1, 2, 40.0, 50.0, "three")], "id long, idx int, start double, end double, text string")
    got = {r["id"]: (r["end"], r["excerpt"]) for r in detection.emitted(regs, seg).collect()}
    assert got == {1: (30.0, "one two"), 2: (9.0, "")}


def test_new_items(spark):
    feed = spark.createDataFrame([(1, "a", "2024-01-02"), (1, "a", "2024-01-02"), (1, "b", None), (1, "c", "2020-01-01"), (1, "d", "2024-01-01")], "p int, g string, d string")
    held = spark.createDataFrame([(1, "d")], "p int, g string")
    assert pairs(catalog.new_items(feed, held, ["p", "g"], "d", F.lit("2023-01-01")), "g") == [("a",), ("b",)]


def test_feed_and_ingest(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>P</title>'
        '<item><title>E1</title><guid isPermaLink="false">g1</guid><pubDate>Mon, 1 Jan 2024 10:00:00 +0200</pubDate>'
        '<enclosure url="http://h/a.mp3" length="1" type="audio/mpeg"/><itunes:duration>1:02:03</itunes:duration></item>'
        '<item><title>E2</title><guid>g2</guid><enclosure url="http://h/b.mp4" length="1" type="video/mp4"/></item></channel></rss>'
    )
    r = feeds.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(x["guid"], str(x["pub_date"]), x["duration_s"]) for x in r] == [("g1", "2024-01-01 08:00:00", 3723)]
    (tmp_path / "t.json").write_text('{"transcription":[{"offsets":{"from":0,"to":1500},"text":" hi "},{"offsets":{"from":1500,"to":2000},"text":" "}]}')
    assert pairs(feeds.read_transcripts(spark, str(tmp_path / "t.json")), "idx", "start", "end", "text") == [(0, 0.0, 1.5, "hi")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for n in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(x,) for x in n], "g string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark.readStream.schema("g string").parquet(src), out, str(tmp_path / "cp"), ["g"]).awaitTermination()
    assert pairs(spark.read.parquet(out), "g") == [("a",), ("b",), ("c",)]
    # A new checkpoint on a filled target: nothing that is held is lost or comes again.
    ingest(spark.readStream.schema("g string").parquet(src), out, str(tmp_path / "new"), ["g"]).awaitTermination()
    assert pairs(spark.read.parquet(out), "g") == [("a",), ("b",), ("c",)]


def test_ingest_leaves_late_and_broken_rows_out(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a", "2024-01-02"), ("b", "2020-01-01"), ("c", None), (None, "2024-01-03")], "g string, d string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("g string, d string").parquet(src)
    ingest(stream, out, str(tmp_path / "cp"), ["g"], late=F.col("d") < "2023-01-01", broken=F.col("g").isNull()).awaitTermination()
    assert pairs(spark.read.parquet(out), "g") == [("a",), ("c",)]
    assert pairs(spark.read.parquet(f"{out}_broken"), "d") == [("2024-01-03",)]


def test_shown_texts(spark):
    df = spark.createDataFrame([(0.0, "abc", 5, 7), (0.4, "abcdef", 5, None), (2.5, None, 0, 0)], "m double, t string, a long, b long")
    got = df.select(scalar.eta_text(F.col("m")), scalar.excerpt(F.col("t"), 3), scalar.hamming(F.col("a"), F.col("b")), scalar.whole_minutes(F.col("m") * 100), scalar.capitalised(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("", "abc", 1, 0, "Abc"), ("ETA: <1 min", "abc...", 32, 0, "Abcdef"), ("ETA: ~3 min", None, 0, 4, None)]


def test_feed_links_and_entries(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>P</title>'
        '<item><title>E1</title><link>http://h/1</link><atom:link href="http://h/1.mp3" type="audio/mpeg"/></item>'
        '<item><title>E2</title><guid>g2</guid><link>http://h/2</link><enclosure url="http://h/2.mp3" type="audio/mpeg"/></item>'
        "<item><title>E3</title><link>http://h/3</link></item></channel></rss>"
    )
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>P</title><entry><title>A1</title><id>i1</id><summary>S</summary>'
        '<published>2024-01-01T10:00:00+02:00</published><link href="http://h/p"/><link rel="enclosure" type="audio/mpeg" href="http://h/a.mp3"/></entry>'
        '<entry><title>A2</title><id>i2</id><link href="http://h/q"/></entry></feed>'
    )
    assert pairs(feeds.read_feed(spark, str(tmp_path / "r.xml")), "guid", "audio_url") == [("g2", "http://h/2.mp3"), ("http://h/1", "http://h/1.mp3")]
    got = [(x["guid"], x["audio_url"], x["description"], str(x["pub_date"])) for x in feeds.read_feed(spark, str(tmp_path / "a.xml")).collect()]
    assert got == [("i1", "http://h/a.mp3", "S", "2024-01-01 08:00:00")]


def test_channels(spark, tmp_path):
    itunes = 'xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"'
    (tmp_path / "r.xml").write_text(
        f'<rss version="2.0" {itunes}><channel><title>P</title><description>D</description><itunes:author>A</itunes:author>'
        "<image><url>http://h/i.png</url><title>I</title></image><item><title>E1</title></item><item><title>E2</title></item></channel></rss>"
    )
    (tmp_path / "s.xml").write_text(f'<rss version="2.0" {itunes}><channel><itunes:image href="http://h/j.png"/></channel></rss>')
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>Q</title><subtitle>S</subtitle><author><name>N</name></author><logo>http://h/l.png</logo>'
        "<entry><title>A1</title></entry></feed>"
    )
    got = pairs(feeds.read_channel(spark, str(tmp_path)), "title", "description", "image_url", "author", "n_entries")
    assert got == [("P", "D", "http://h/i.png", "A", 2), ("Q", "S", "http://h/l.png", "N", 1), ("Unknown Podcast", "", "http://h/j.png", "", 0)]


def test_feed_sink_writes_what_is_there(spark):
    groups = spark.createDataFrame([(1, "A & B", None, "http://h/f"), (2, "C", "", None)], "group int, name string, description string, link string")
    items = spark.createDataFrame(
        [(1, "g1", "T", "<b>", "http://h/1", 5, 7, "2024-01-02 03:04:05"), (1, "g2", "U", None, "http://h/2", None, None, None)],
        "group int, guid string, title string, description string, audio_url string, duration_s int, length long, pub_date string",
    )
    got = dict(pairs(feeds.feeds(groups, items, dated=True), "group", "xml"))
    assert got[2] == '<rss version="2.0"><channel><title>C</title></channel></rss>'
    assert got[1] == (
        '<rss version="2.0"><channel><title>A &amp; B</title><link>http://h/f</link>'
        "<item><title>T</title><description>&lt;b&gt;</description><guid>g1</guid><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate>"
        '<itunes:duration>5</itunes:duration><enclosure url="http://h/1" length="7" type="audio/mpeg"/></item>'
        '<item><title>U</title><guid>g2</guid><itunes:duration>0</itunes:duration><enclosure url="http://h/2" type="audio/mpeg"/></item></channel></rss>'
    )
