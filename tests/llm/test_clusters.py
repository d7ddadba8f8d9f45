"""MinHash groups, centroid clusters and vector codes against brute force, on small tables with hard rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from refrain.llm import centroids, integers, minhash, queries, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, band int, n int"
VECTORS = "vec_id long, embedding array<float>, label int, code string, cluster int, e int"


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def documents():
    """Copies, near copies on both sides of the threshold, chains, short and blank texts, a long one, null ids."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return [r.choice(vocabulary) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for at in r.sample(range(len(words)), n):
            words[at] = f"x{r.random()}"
        return words

    out = []
    for size in (12, 60, 150, 400):
        base = text(size)
        out += [(base, 1), (base, 3), *[(edited(base, n), 1) for n in (1, 1, 2, 2, 3, 4, 6, 9)]]
        chain = base
        for _ in range(6):
            chain = edited(chain, max(1, size // 120))
            out.append((chain, 1))
    out += [(text(3), 2), (text(5), 1), (text(4), 1), (["one"], 2), (text(20_000), 2)]
    docs, at = [], 0
    for words, times in out:
        for i in range(times):
            sep = (" ", "\n", "\t  ")[i % 3]
            docs.append((at * 7919 % 1009, sep.join(words).upper() if i % 2 else sep.join(words)))
            at += 1
    docs += [(2001, None), (2002, ""), (2003, " \n\t"), (None, " ".join(out[0][0])), (None, "only here"), (docs[3][0], docs[3][1]), (2004, "ÄÖ ä ö " * 9), (2005, "äö ä ö " * 9)]
    return [(d, t, "en", "a", 1, "k", 1, 2) for d, t in docs]


def brute_groups(docs):
    sets = []
    for _, t, *_ in docs:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    least = {}
    for i, d in enumerate(docs):
        ids = least.setdefault(top(i), [])
        if d[0] is not None:
            ids.append(d[0])
    want = Counter()
    for i, d in enumerate(docs):
        c = min(least[top(i)], default=None)
        want[d[0], len(sets[i]), c, d[0] == c] += 1
    return want


@pytest.mark.parametrize("members", [256, 2])
def test_minhash(spark, monkeypatch, members):
    """With blocks of two members, clusters take several blocks, and those that are left apart meet again."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    docs = documents()
    found = minhash.minhash_dedup(spark.createDataFrame(docs, DOCS).repartition(3))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(docs)


def test_minhash_without_rows_or_words(spark):
    assert minhash.minhash_dedup(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " "), (None, "")], "doc_id long, text string")
    assert rows(minhash.minhash_dedup(blank), "doc_id", "n_shingles", "component_id", "kept") == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (None, 0, None, True): 1})


def test_circulant_signatures():
    """The share of equal coordinates is the similarity, also where a set lies across two computed blocks."""
    r = np.random.default_rng(4)
    circle = minhash.Circulant()
    for like in (0.3, 0.6, 0.9):
        got = []
        for n in (40, 700):
            both = round(2 * n * like / (1 + like))
            for _ in range(40):
                x = r.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
                a, b = circle.signatures([x[:n], x[n - both :]])
                got.append((a == b).mean())
                assert (circle.signatures([x[n - both :]])[0] == b).all()
        assert abs(np.mean(got) - like) < 0.02
        assert np.std(got) < 1.5 * math.sqrt(like * (1 - like) / (minhash.ROWS * minhash.BANDS))


def test_forest():
    r = random.Random(6)
    for _ in range(40):
        base = [frozenset(r.sample(range(300), r.choice([20, 40]))) for _ in range(3)]
        sets = [np.array(sorted({*r.choice(base), *r.sample(range(300, 330), r.randrange(5))}), np.uint64) for _ in range(30)]
        link = {(i, j) for i in range(30) for j in range(30) if i != j and 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})}
        group = list(range(30))
        edges = minhash.forest(sets)
        assert {*edges} <= link
        for a, b in edges:
            group = [group[b] if g == group[a] else g for g in group]
        assert len(edges) == 30 - len(set(group))
        assert all(group[a] == group[b] for a, b in link)


def vectors():
    """Clusters, many copies of one vector, ties, null ids and labels, and rows to drop."""
    r = random.Random(12)
    middles = [[r.gauss(0, 0.3) for _ in range(64)] for _ in range(8)]
    out = [(i, [x + r.gauss(0, 0.05) for x in r.choice(middles)], r.choice([1, 2, None])) for i in range(300)]
    out += [(i, out[7][1], 3) for i in range(300, 500)] + [(i, [0.0] * 64, 1) for i in range(500, 520)]
    out += [(None, out[9][1], 1), (None, out[11][1], None), (7, out[7][1], None), (7, out[7][1], None)]
    out += [(900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1), (904, [float("nan")] + [0.0] * 63, 1), (905, [0.0] * 63 + [float("-inf")], 1)]
    return [(i, v, label, "c", 1, 1) for i, v, label in out]


def usable(data):
    f = lambda x: math.floor(256 * float(np.float32(x)))
    return [(i, [f(x) for x in v], label) for i, v, label, *_ in data if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(v, books):
    return min((square(v, c), k) for k, c in enumerate(books))


def brute_clusters(data, k=40, rounds=5):
    own = usable(data)
    order = sorted((x for x in own if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    c = [v for _, v, _ in order[:k]]
    for _ in range(rounds):
        held = {}
        for _, v, _ in own:
            held.setdefault(closest(v, c)[1], []).append(v)
        c = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c[j] for j in range(len(c))]
    found = [(i, *closest(v, c)) for i, v, _ in own]
    of = Counter()
    for _, d, j in found:
        of[j] += d
    return Counter((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_centroid_clusters(spark):
    data = vectors()
    found = centroids.centroid_clusters(spark.createDataFrame(data, VECTORS).repartition(3))
    assert rows(found, *CLUSTER) == brute_clusters(data)
    few = data[:5]
    assert rows(centroids.centroid_clusters(spark.createDataFrame(few, VECTORS)), *CLUSTER) == brute_clusters(few)
    assert centroids.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_ball_trees_assign_as_brute_force():
    """Far clusters go as whole balls, close and equal centroids vector by vector; sums are those of the vectors."""
    r = np.random.default_rng(2)
    whole = 0
    for spread in (1, 40, 4000):
        middles = r.integers(-2000, 2000, (6, 64))
        v = middles[r.integers(0, 6, 700)] + r.integers(-spread, spread + 1, (700, 64))
        v[:100] = v[0]
        order, radius, sums = centroids.grown(v)
        tree = centroids.Tree(v[order], radius, sums)
        c = np.concatenate([middles, middles[:1], v[:5]])
        to, balls = tree.assigned(c)
        d = ((v[order][:, None] - c[None]) ** 2).sum(2)
        assert (to == d.argmin(1)).all()
        got = tree.contributions(c)
        for k in range(len(c)):
            assert (got[k, :64] == v[order][to == k].sum(0)).all() and got[k, 64] == (to == k).sum()
        whole += len(balls)
    assert whole > 0


def test_exact_squares():
    r = np.random.default_rng(3)
    for most in (1000, integers.MOST):
        v, c = r.integers(-most, most, (20, 64)), r.integers(-most, most, (5, 64))
        assert integers.squares(v, c).tolist() == [[square(a, b) for b in c.tolist()] for a in v.tolist()]


def brute_codes(data):
    own = usable(data)
    first = sorted((x for x in own if x[0] is not None), key=lambda x: (x[0], x[1]))[:64]
    books = [[v[4 * p : 4 * p + 4] for _, v, _ in first] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            held = {}
            for _, v, _ in own:
                held.setdefault(closest(v[4 * p : 4 * p + 4], books[p])[1], []).append(v[4 * p : 4 * p + 4])
            books[p] = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(books[p])]
    out, of = [], Counter()
    for i, v, label in own:
        near = [closest(v[4 * p : 4 * p + 4], books[p]) for p in range(16)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near), label))
        of[label] += out[-1][2]
    name = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return Counter((i, code, error, of[label], name) for i, code, error, label in out)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_vector_codes(spark):
    data = vectors()
    found = vector_codes.vector_codes(spark.createDataFrame(data, VECTORS).repartition(3))
    assert rows(found, *CODES) == brute_codes(data)
    few = data[:5]
    assert rows(vector_codes.vector_codes(spark.createDataFrame(few, VECTORS)), *CODES) == brute_codes(few)
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    plain = spark.createDataFrame([(i, v) for i, v, *_ in few], "vec_id long, embedding array<float>")
    assert len({r["label_error"] for r in vector_codes.vector_codes(plain).collect()}) == 1


def test_only_changed_parts_give_differences():
    """What a round's differences add to the sums of the last makes the sums of the new assignment."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    v = r.integers(-300, 300, (50, 64))
    was, now = r.integers(0, 64, (50, 16)).astype(np.uint8), None
    now = np.where(r.random((50, 16)) < 0.2, r.integers(0, 64, (50, 16)), was).astype(np.uint8)

    def sums(codes, before):
        b = pa.RecordBatch.from_arrays([pa.array(integers.packed(v)), pa.array([x.tobytes() for x in codes]), pa.array(before, pa.binary())], ["v", "codes", "was"])
        (out,) = vector_codes._differences(iter([b]))
        return Counter(dict(zip(*(c.to_pylist() for c in out.columns), strict=True)))

    first, step, direct = sums(was, [None] * 50), sums(now, [x.tobytes() for x in was]), sums(now, [None] * 50)
    first.update(step)
    assert {k: n for k, n in first.items() if n} == dict(direct)
    assert len(step) <= 5 * 2 * (was != now).sum()


def test_registered(spark, sf):
    for name in ("op11_minhash", "op12_centroids", "op13_vector_codes"):
        assert name in queries.QUERIES and name in queries.SQL


def test_components_end_when_all_hang_on_their_smallest(spark, monkeypatch):
    from refrain.llm.common import components
    from refrain.session import Scratch

    saved = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, f=Scratch.save: saved.append(name) or f(self, df, name))
    edges = [(3, 1), (1, 2), (9, 7), (1, 3), (5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "stars"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    # Stars are done as they are given, with no round to confirm it.
    assert saved == ["e0", "roots"]
    chain = [(k, k + 1) for k in range(40)]
    found = components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "chain"))
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)]
    assert not components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "none")).head(1)
