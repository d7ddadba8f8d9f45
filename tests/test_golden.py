"""The whole detection on items with planted blocks: what must be found, and what must not."""

import random

import pytest

from refrain.operators import detection, intervals, sequences

RATE = sequences.RATE
PLAIN = "the river runs slowly past the old stone bridge today"
AD = "use promo code river today and go to example.com for the offer"


def stream(r, n, block=(), at=0):
    own = [r.getrandbits(32) for _ in range(n)]
    own[at : at + len(block)] = block
    return own


def items():
    """(group, id, stream, place and length of the planted block, what is said in it; None: no transcript)."""
    r = random.Random(17)
    out = []

    def plant(grp, ids, n, size, said):
        block = [r.getrandbits(32) for _ in range(size)]
        for k, i in enumerate(ids):
            at = 500 + 137 * k
            out.append((grp, i, stream(r, n, block, at), at, size, said))

    plant(1, range(1, 6), 4_000, 100, PLAIN)
    plant(2, (11, 12), 4_000, 100, AD)
    plant(3, (21, 22), 4_000, 100, PLAIN)
    plant(4, (31, 32), 4_000, 1_500, PLAIN)
    plant(5, (41, 42), 10_000, 2_500, AD)
    plant(6, (51, 52, 53), 4_000, 100, None)
    return out


@pytest.fixture(scope="module")
def world(spark):
    made = items()
    fp = spark.createDataFrame([(g, i, p, h) for g, i, s, *_ in made for p, h in enumerate(s)], "grp int, id long, pos int, h long").cache()
    segs = []
    for _, i, s, at, size, said in made:
        if said is not None:
            a, b, end = at / RATE, (at + size) / RATE, len(s) / RATE
            times = [(t, t + 10.0) for t in (0.0, a - 25, b + 10, b + 30)] + [(a, b)]
            segs += [(i, k, x, y, said if (x, y) == (a, b) else f"{PLAIN} {i} {k}") for k, (x, y) in enumerate(sorted(times)) if y <= end]
    segments = spark.createDataFrame(segs, "id long, idx int, start double, end double, text string")
    lengths = spark.createDataFrame([(i, len(s) / RATE) for _, i, s, *_ in made], "id long, length double")
    runs = intervals.greedy(sequences.error_runs(sequences.offsets(sequences.votes(fp)), fp.select("id", "pos", "h")), ["a", "b"])
    heard = runs.selectExpr("a AS id", "b AS other", "start", "end").cache()
    return made, heard, segments, lengths


def test_planted_blocks_are_found(world):
    made, heard, segments, lengths = world
    cuts = {}
    for c in detection.detect(heard, segments, lengths).collect():
        cuts.setdefault(c["id"], []).append(c)
    place = {i: (at / RATE, (at + size) / RATE) for _, i, _, at, size, _ in made}
    want = {**dict.fromkeys(range(1, 6), (4, "audio_repeat", 0.9)), 11: (1, "audio_repeat+transcript", 0.8), 12: (1, "audio_repeat+transcript", 0.8), **dict.fromkeys((51, 52, 53), (2, "audio_repeat", 0.8))}
    assert set(cuts) == set(want)
    for i, (n, method, sure) in want.items():
        (c,) = cuts[i]
        # Half a second, and a place of the hash stream at most: the smoothed error rate reaches over a block by 4 places.
        assert abs(c["start"] - place[i][0]) <= 0.55 and abs(c["end"] - place[i][1]) <= 0.55, (i, c, place[i])
        assert (c["n_matches"], c["method"], c["confidence"]) == (n, method, sure), (i, c)


def test_shared_items_are_excluded_and_long_runs_dropped(world):
    _, heard, _, lengths = world
    bad = {(r["id"], r["other"]): r["shared"] for r in detection.excluded_pairs(heard, lengths).collect()}
    assert set(bad) == {(31, 32), (32, 31)} and all(abs(s - 1_500 / RATE) < 2 for s in bad.values())
    left = {r["id"] for r in detection.without_compilations(heard, lengths).collect()}
    assert left.isdisjoint({31, 32, 41, 42}) and {1, 11, 21, 51} <= left
