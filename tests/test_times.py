"""Word times, overlap by bins, and bridges that read their gap."""

import random
from collections import Counter

from pyspark.sql import functions as F

from refrain.operators import detection, edges, intervals, sequences
from refrain.plans import registry

AD = "use promo code now"


def segs(spark, *xs):
    return spark.createDataFrame([(i, k, float(a), float(b), t) for i, k, a, b, t in xs], "id long, idx int, start double, end double, text string")


def test_times_at(spark):
    s = segs(spark, (1, 0, 0, 10, "one two"), (1, 1, 10, 12, "(...)"), (1, 2, 12, 15, "three four five"), (2, 0, 3, 4, "six"))
    asked = spark.createDataFrame([(1, i) for i in (-1, 0, 1, 2, 4, 5)] + [(2, 0), (3, 0)], "id long, i long")
    got = sorted(tuple(r) for r in sequences.times_at(asked, s).collect())
    assert got == [(1, 0, 0.0), (1, 1, 5.0), (1, 2, 12.0), (1, 4, 14.0), (2, 0, 3.0)]
    assert sorted(tuple(r) for r in sequences.last_word(s).collect()) == [(1, 14.0), (2, 3.0)]
    # The same as the unfolded words have.
    every = sequences.word_times(s).orderBy("id", "idx", "pos").collect()
    by = {}
    for r in every:
        by.setdefault(r["id"], []).append(r["at"])
    assert {(r["id"], r["i"]): r["at"] for r in sequences.times_at(asked, s).collect()} == {(i, p): by[i][p] for i, p in [(1, 0), (1, 1), (1, 2), (1, 4), (2, 0)]}


def test_script_evidence_ends_where_the_last_word_begins(spark):
    s = segs(spark, (1, 0, 0, 100, "a b c d e f g h i j"), (1, 1, 100, 110, AD), (1, 2, 110, 1000, "z " * 90), (2, 0, 0, 8, AD), (2, 1, 8, 900, "y " * 90))
    runs = spark.createDataFrame([(1, 2, 10, 4), (2, 1, 0, 4), (1, 2, 0, 3)], "id long, other long, i int, words long")
    timed = detection.timed_runs(runs, s)
    assert sorted(tuple(r) for r in timed.collect()) == [(1, 2, 0.0, 20.0), (1, 2, 100.0, 107.5), (2, 1, 0.0, 6.0)]
    assert sorted(tuple(r) for r in detection.script_evidence(timed, s).collect()) == [(1, 2, 100.0, 107.5), (2, 1, 0.0, 6.0)]
    # The last words are at 12 and 14: a run of 6 seconds is too much of the shorter item.
    short = segs(spark, (1, 0, 0, 8, AD), (1, 1, 8, 16, "x y"), (2, 0, 0, 8, AD), (2, 1, 8, 20, "x y"))
    assert detection.script_evidence(spark.createDataFrame([(1, 2, 0.0, 6.0)], "id long, other long, start double, end double"), short).count() == 0


def test_overlap_by_bins(spark):
    """The same pairs as every with every, once each: long, empty and backward intervals, and those on borders of bins."""
    r = random.Random(4)

    def some(n):
        out = []
        for k in range(n):
            a = r.choice([r.uniform(-50, 300), float(r.randrange(0, 5) * 64)])
            out.append((r.randrange(3), k, a, a + r.choice([0.0, 0.5, 64.0, 200.0, -3.0, r.uniform(0, 90)])))
        return out

    left, right = some(60), some(60)
    l = spark.createDataFrame([*left, (1, 99, None, 5.0)], "id int, n int, start double, end double")
    rr = spark.createDataFrame([*right, (1, 98, 0.0, None)], "id int, m int, __s double, __e double")
    got = Counter((x["n"], x["m"]) for x in intervals.overlapping(l, rr, ["id"]).collect())
    assert got == Counter((a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[3] > a[2] and b[2] < a[3])


def test_a_full_item_does_not_meet_itself(spark):
    """Of an item of many spans only neighbours meet: no step makes pairs of all of them."""
    n = 20_000
    spans = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 5).alias("end"))
    seg = spans.select("id", F.col("start").alias("__s"), (F.col("start") + 12).alias("__e"))
    met = intervals.overlapping(spans, seg, ["id"])
    plan = met._jdf.queryExecution()
    assert met.count() == 2 * n - 1
    assert "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()
    both = intervals._binned(spans, F.col("start"), F.col("end"), 64.0, "l").groupBy("l_bin").count().agg(F.max("count")).first()[0]
    assert both <= 9


def test_regions_count_their_sources(spark):
    ev = [(1, 2, 0.0, 5.0), (1, 3, 5.0, 5.0), (1, 4, 2.0, 2.0), (1, 2, 6.0, 9.0), (1, 5, 20.0, 20.0), (2, 7, 1.0, 2.0)]
    got = detection.regions(spark.createDataFrame(ev, "id long, other long, start double, end double"))
    assert sorted((r["id"], r["start"], r["end"], r["n_matches"], r["srcs"]) for r in got.collect()) == [(1, 0.0, 9.0, 3, [2, 3, 4]), (2, 1.0, 2.0, 1, [7])]


def test_bridge_reads_its_gap(spark):
    def regs(*xs):
        return spark.createDataFrame([(i, float(a), float(b), 2, [2, 3], m, 0.9, "") for i, a, b, m in xs], edges.REGION)

    r = regs((1, 0, 10, "audio_repeat"), (1, 100, 110, "audio_repeat+transcript"), (1, 200, 210, "audio_repeat"), (2, 0, 10, "audio_repeat"), (2, 11, 300, "x"), (2, 310, 320, "y"))
    s = segs(spark, (1, 0, 20, 90, AD), (1, 1, 120, 190, "nothing to sell"), (2, 0, 300, 310, "quiet"))

    def got(df):
        return sorted((x["id"], x["start"], x["end"], x["method"]) for x in df.collect())

    assert got(detection.bridged(r, 5.0, 120.0, s)) == [(1, 0, 110, "audio_repeat+bridge+transcript"), (1, 200, 210, "audio_repeat"), (2, 0, 300, "audio_repeat+bridge+x"), (2, 310, 320, "y")]
    # No transcript, or a reach no longer than the free one: gaps are judged by their length.
    assert got(detection.bridged(r, 5.0, 120.0, s.limit(0))) == got(detection.bridged(r, 5.0)) == got(detection.bridged(r, 5.0, 5.0, s))
    assert len(got(detection.bridged(r, 5.0))) == 5


def test_walks_move_edges_of_given_tables(spark, sf):
    out = registry.walk_extend(spark, sf)
    assert out.where(F.col("method").contains("extend")).count() > 0
