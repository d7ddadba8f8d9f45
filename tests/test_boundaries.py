"""Common runs are met where they begin and end only: the same results as by every place, and far fewer pairs."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from refrain.functions.scalar import tokens
from refrain.operators import detection, incremental, sequences


def texts():
    """Texts of few words, with copies, near copies and repeats inside one text."""
    r = random.Random(11)
    long = [r.choice("abcdefgh") for _ in range(300)]
    out = [long, list(long), long[:120] + ["x"] + long[121:], long[150:] + long[:150], long[:40] * 3, ["a"] * 60, ["a"] * 50, [], ["b", "c"]]
    return out + [[r.choice("ab") for _ in range(r.randrange(60))] for _ in range(6)]


def quads(spark):
    rows = [(i % 2, i, " ".join(w)) for k, w in enumerate(texts()) for i in (2 * k, 2 * k + 1)]
    docs = spark.createDataFrame(rows, "grp int, id long, text string")
    keys = sequences.linked(sequences.shingle_keys(tokens(F.col("text")), 4))
    marks = docs.select("grp", "id", F.posexplode(keys).alias("pos", "x")).select("grp", "id", "pos", F.col("x.k.k1").alias("h"), "x.prev", "x.next")
    return docs, marks


def test_votes_of_a_run_come_from_its_ends(spark):
    _, marks = quads(spark)
    plain = marks.drop("prev", "next")
    want = Counter(tuple(x) for x in sequences.votes(plain).collect())
    assert want and Counter(tuple(x) for x in sequences.votes(marks).collect()) == want
    most, few = (sequences._pairs(sequences._postings(m, ["h"]), ["h"], "pos").count() for m in (plain, marks))
    assert few < most / 2
    # Chains found once and mirrored are those of both ways.
    both = Counter(tuple(x) for x in sequences.offsets(sequences.votes(plain)).collect())
    assert both and Counter(tuple(x) for x in sequences.offsets(sequences.votes_once(marks), once=True).collect()) == both


def test_word_runs_by_brute_force(spark):
    docs, _ = quads(spark)
    words = {(r["grp"], r["id"]): r["text"].split() for r in docs.collect()}
    want = Counter()
    for (g, a), x in words.items():
        for (h, b), y in words.items():
            if g == h and a < b:
                for i in range(len(x)):
                    for j in range(len(y)):
                        if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                            n = 1
                            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                                n += 1
                            if n >= 18:
                                want[a, b, i, j, n] += 1
    assert want and Counter(tuple(x) for x in sequences.word_runs(docs).collect()) == want


def test_recompute_makes_no_pair_of_old_items(spark):
    _, marks = quads(spark)
    fresh = spark.createDataFrame([(0,), (7,)], "id long")
    again = sequences.votes_once(incremental.touched(marks, fresh))
    assert again.count() and not again.where("a not in (0, 7) and b not in (0, 7)").count()
    stored = sequences.votes_once(marks.join(fresh, "id", "left_anti"))
    got = Counter(tuple(x) for x in incremental.updated_pairs(stored, marks, fresh, sequences.votes_once).collect())
    assert got == Counter(tuple(x) for x in sequences.votes_once(marks).collect())


def test_a_stream_is_shipped_for_blocks_not_for_partners(spark):
    """All pairs of 60 items: the same runs as pair by pair, and no more rows than pairs and items by blocks."""
    r = random.Random(4)
    block = [r.getrandbits(32) for _ in range(80)]
    fp = {i: [r.getrandbits(32) for _ in range(i)] + block for i in range(60)}
    arrays = spark.createDataFrame(list(fp.items()), "id long, fp array<bigint>")
    offs = spark.createDataFrame([(a, b, a - b) for a in fp for b in fp if a != b], "a long, b long, off int")
    runs = sequences.error_runs(offs, arrays)
    want = {(a, b, a - b, p, n) for a in fp for b in fp if a != b for p, n, _ in sequences.diagonal(np.array(fp[a]), np.array(fp[b]), a - b, 0.3) if n / sequences.RATE >= 5}
    got = {(x["a"], x["b"], x["off"], round(x["start"] * sequences.RATE), round((x["end"] - x["start"]) * sequences.RATE)) for x in runs.collect()}
    assert want and got == want
    # The rows that meet: a stream for each block that its item has partners in, and the pairs, with no stream in them.
    assert "FlatMap" not in (plan := runs._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1


def test_shares_shuffle_no_texts(spark):
    """N-grams are shuffled once, as hashes; the shares are those of brute force."""
    docs, _ = quads(spark)
    shares = sequences.repeated_share(docs)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(k1" in line]
    assert len(moved) == 1 and "hashpartitioning(grp" not in plan
    grams = {(r["grp"], r["id"]): [tuple(w[i : i + 4]) for i in range(len(w) - 3)] for r in docs.collect() for w in [r["text"].split()]}
    want = {}
    for (g, a), x in grams.items():
        others = {k for (h, b), y in grams.items() if h == g and b != a for k in y}
        if x:
            want[a] = sum(k in others for k in x) / len(x)
    assert {r["id"]: r["share"] for r in shares.collect()} == want


def test_regions_are_made_once(spark, monkeypatch):
    """Judging reads regions twice: they are a written table, not a plan that is run for each."""
    seen, judge = [], detection.classified
    monkeypatch.setattr(detection, "classified", lambda regs, *rest: seen.append(regs) or judge(regs, *rest))
    ev = spark.createDataFrame([(1, o, 10.0, 22.0) for o in (2, 3, 4, 5)], "id long, other long, start double, end double")
    lengths = spark.createDataFrame([(i, 500.0) for i in range(1, 6)], "id long, length double")
    seg = spark.createDataFrame([(1, 0, 60.0, 70.0, "so much for that")], "id long, idx int, start double, end double, text string")
    cuts = detection.detect(ev, seg, lengths).collect()
    assert [(r["start"], r["end"], r["n_matches"]) for r in cuts] == [(10.0, 22.0, 4)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan
