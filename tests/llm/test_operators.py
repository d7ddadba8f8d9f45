"""Each operator against a brute-force version, on a small table with hard rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from refrain.llm import html_extract, language_id, line_dedup, mixing, sentencepiece_fst, simhash, suffix_dedup, token_counts, topk
from refrain.llm.exact_dedup import exact_dedup
from refrain.session import Scratch, exists, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc int, h string"


def small():
    """Nulls, blanks, ties, copies, a very long text and columns with clashing names."""
    r = random.Random(5)

    def text(n):
        return " ".join(r.choice("alpha beta gamma delta épsilon zeta eta theta".split()) + str(r.randint(0, 99)) for _ in range(n))

    passage = text(120)
    rows = [(i, f"{text(30)} {passage if i % 3 == 0 else ''} {text(40)}", "en", "abc"[i % 3], 1) for i in range(12)]
    rows += [(20, rows[0][1].upper(), "en", "a", 1), (21, rows[0][1], None, None, 1), (22, rows[1][1] + " more", "en", "z", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), (32, " \n\t ", "en", "a", 3), (None, text(9), "en", "b", 1)]
    rows += [(33, "12 34 !!", "de", "b", 1), (34, ("one line that is long enough\n" * 3) + "x", "en", "a", 1)]
    rows += [(i, "  One Line that is long enough \nown " + text(3), "en", "a", 1) for i in (35, 36)]
    rows += [(37, text(30_000), "en", "c", 1), (38, "ab" * 700, "en", "c", 1), (40, "twice", "en", "a", 1), (40, "twice", "en", "a", 1)]
    return [(*r_, 1, "h") for r_ in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(small(), SCHEMA).repartition(3).cache()


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_exact_dedup(docs):
    def norm(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)})

    group = {}
    for d, t, *_ in small():
        group.setdefault(norm(t), []).append(d)
    want = Counter()
    for d, t, *_ in small():
        g = group[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[d, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    out = exact_dedup(docs)
    assert rows(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert out.where("kept").count() == len(group)


def test_suffix_dedup(docs):
    texts = [((d), (t or "").encode()) for d, t, *_ in small()]
    n = Counter(b[i : i + 400] for _, b in texts for i in range(len(b) - 399))
    want = Counter()
    for d, b in texts:
        on = np.zeros(len(b) + 2, int)
        for i in range(len(b) - 399):
            if n[b[i : i + 400]] > 1:
                on[i + 1 : i + 401] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[on[1:-1] == 0])
        want[d, len(b), int(on.sum()), int((np.diff(on) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_hot_key(docs, monkeypatch):
    cold = rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed", "n_spans")
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    assert rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_removed", "n_spans") == cold


def test_suffix_dedup_lone_runs(docs, monkeypatch):
    """Only runs of keys that may repeat become classes, and the runs themselves are gone by then."""
    found = [run for _, t, *_ in small() for run in suffix_dedup.runs_of((t or "").encode())]
    n, inner = Counter(run[0] for run in found), {run[0] for run in found if run[4]}
    want = {run[:2] for run in found if n[run[0]] > 1 or run[0] in inner}
    saved = {}

    class Seen(Scratch):
        def save(self, df, name):
            if name == "classes":
                saved["runs"] = exists(self.spark, self.path("runs"))
            saved[name] = super().save(df, name)
            return saved[name]

        def drop(self, *names):
            if "classes" in names:
                saved["classes"] = {(r["key"], bytes(r["content"])) for r in saved["classes"].collect()}
            super().drop(*names)

    monkeypatch.setattr(suffix_dedup, "Scratch", Seen)
    suffix_dedup.suffix_dedup(docs)
    assert saved["classes"] == want and len(want) < len({run[:2] for run in found})
    assert not saved["runs"]


def test_covered_by_brute_force():
    """The bytes that go, and the maximal repeats with all their occurrences, of texts that stand for several."""
    r = random.Random(3)
    for _ in range(60):
        least = r.choice([8, 12, 20])
        base = [bytes(r.choice(b"ab\0") for _ in range(40)) for _ in range(3)]
        own = [b"".join(r.choice(base)[r.randrange(20) : r.randrange(20, 40)] for _ in range(r.randrange(5))) for _ in range(5)]
        own = list(dict.fromkeys(own))
        times = [r.choice([1, 1, 2]) for _ in own]
        n = Counter()
        for x, t in zip(own, times, strict=True):
            for i in range(len(x) - least + 1):
                n[x[i : i + least]] += t
        for x, spans in zip(own, suffix_dedup.covered(own, times, least), strict=True):
            on = {k for i in range(len(x) - least + 1) if n[x[i : i + least]] > 1 for k in range(i, i + least)}
            assert {k for a, b in spans for k in range(a, b)} == on
        places = {}
        for k, x in enumerate(own):
            for a in range(len(x)):
                for b in range(a + least, len(x) + 1):
                    places.setdefault(x[a:b], []).append((k, a))
        want = set()
        for string, at in places.items():
            # What stands before and behind; the edge of a text equals nothing, nor does it equal its copies' edges.
            before = {own[k][a - 1] if a else ("edge", k, c) for k, a in at for c in range(times[k])}
            behind = {own[k][a + len(string)] if a + len(string) < len(own[k]) else ("edge", k, c) for k, a in at for c in range(times[k])}
            if len(before) > 1 and len(behind) > 1:
                want |= {(k, a, a + len(string), xxhash.xxh3_128_digest(string)) for k, a in at}
        got = [(k, *s) for k, spans in enumerate(suffix_dedup.occurrences(own, times, least)) for s in spans]
        assert len(got) == len(set(got)) and set(got) == want


def starts(data, string):
    at = data.find(string)
    while at >= 0:
        yield at
        at = data.find(string, at + 1)


@pytest.mark.parametrize("hot", [512, 0])
def test_repeat_groups(docs, monkeypatch, hot):
    """Every group names all the places where its string starts, and the groups cover what the operator removes."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = Counter((d, (t or "").encode()) for d, t, *_ in small())
    groups = {}
    for g in suffix_dedup.repeat_groups(docs).collect():
        groups.setdefault((bytes(g["repeat"]), g["size"]), Counter())[g["doc_id"], g["at"]] += 1
    own = {d: b for d, b in texts}
    removed = {d: set() for d in own}
    assert groups
    for (digest, size), at in groups.items():
        d, a = next(iter(at))
        string = own[d][a : a + size]
        assert size >= 400 and xxhash.xxh3_128_digest(string) == digest
        want = Counter((d, i) for d, b in own.items() for i in starts(b, string))
        assert at == want and len(at) > 1
        for d, a in at:
            removed[d] |= set(range(a, a + size))
    out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert {d: len(x) for d, x in removed.items()} == out


def test_runs_go_on_over_blocks(monkeypatch):
    r = random.Random(8)
    data = bytes(r.choice(b"abcdefgh") for _ in range(5000))
    whole = [x[:4] for x in suffix_dedup.runs_of(data)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert [x[:4] for x in suffix_dedup.runs_of(data)] == whole


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(fps):
    """Smallest member reachable, by brute force; fps: {id: fingerprint}."""
    label = {i: i for i in fps}
    while True:
        new = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
        if new == label:
            return label
        label = new


def test_simhash(spark, docs):
    ids = {d: plain_fingerprint(t) for d, t, *_ in small() if d is not None}
    label = linked(ids)
    got = {r["doc_id"]: r for r in simhash.simhash_dedup(docs).where("doc_id is not null").collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in ids.items()}
    assert {d: r["component_id"] for d, r in got.items()} == label


def test_anchor_covering_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(30)}
    fps = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from refrain.llm.common import components
    from refrain.session import Scratch

    scratch = Scratch(spark, "test")
    got = {x["node"]: x["root"] for x in components(scratch.save(simhash.links(df, scratch), "e"), scratch).collect()}
    label = linked(fps)
    assert {f: got.get(f, f) for f in fps} == label


def test_mixing(docs):
    out = mixing.mix_sources(docs).collect()
    size = Counter()
    for _, t, _, s, *_ in small():
        size[s] += len((t or "").encode().split())
    target = {r["source"]: r["target"] for r in out}
    assert {r["source"]: r["source_size"] for r in out} == dict(size)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_ = [s for s in names if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 6) for s in open_}) == 1
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_language_id(spark, docs, sf):
    big = table(spark, sf, "documents")
    out = language_id.language_id(big).join(big.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out and lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.9
    own = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert all(own[i]["lang_pred"] == "und" and own[i]["rejected"] for i in (30, 31, 32, 33))
    assert all(0 <= r["score"] <= 1 for r in own.values())


def test_language_id_above_the_basic_plane(spark):
    rows_ = [(i, f"some plain words of text number {i}", "en") for i in range(1, 30)] + [(101, "\U0001f600\U0001f680\U0001f389", None), (102, "\U00010400\U00020000", None)]
    own = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).collect()}
    assert (own[101]["lang_pred"], own[101]["score"], own[101]["rejected"]) == ("und", 0.0, True)
    assert own[102]["lang_pred"] == "en"
    assert (language_id.ngram_counts("ab \U0001f600 cd") == language_id.ngram_counts("ab ! cd")).all()


def test_line_dedup(docs):
    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    holds = {}
    for d, t, *_ in small():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holds.setdefault(key(line), set()).add((d, t))
    want = Counter()
    for d, t, *_ in small():
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            held = holds.get(key(line), ())
            top = max((x for x, _ in held if x is not None), default=None)
            if len(held) < 3 or d == top:
                stay.append(line)
        want[d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    for batches in (1, 5):
        assert rows(line_dedup.line_dedup(docs, batches), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_token_counts(docs):
    t = token_counts.tokenizer(token_counts.vocabulary_path(token_counts.VOCABULARY))
    want = Counter()
    for d, x, *_ in small():
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[d, len((x or "").encode()), n, n > 1024] += 1
    assert rows(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    hard = "word <|endoftext|> don't  stop\n\n now " * 40 + "y" * 500 + " 1 22 333 你好 é" * 50
    assert token_counts.count_long(t, hard, 100, 3) == len(t.encode(hard, add_special_tokens=False).ids)


def test_sentencepiece(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(sentencepiece_fst.MODEL))
    want = Counter((d, tuple(sp.encode(t or "")), True) for d, t, *_ in small())
    out = sentencepiece_fst.encoded(docs).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in out) == want


def test_topk(spark):
    r = random.Random(2)
    vecs = [(i, [r.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(70)]
    vecs += [(100 + i, vecs[0][1]) for i in range(15)] + [(200, None), (None, vecs[1][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    held = [(i, v) for i, v in vecs if i is not None and v]
    want = Counter()
    for q, v in held:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q)[:10]
            want.update((q, k + 1, i, d) for k, (d, i) in enumerate(near))
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "distance") == want


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li>"
        "<li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Big  news &amp; more</h1>"
        "<p><b>First words.<br><p>A para<b>graph</b> of\n text, with some words in it.</p><p>Be.</p></article>"
        "<div class='comments'><p>I like it a lot.</p></div><footer>&copy; site</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", page, 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract_html(df).collect()}
    text = "Big news & more First words. A paragraph of text, with some words in it. Be."
    assert got[1]["text"] == got[None]["text"] == text and got[1]["n_chars"] == len(text)
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0


def test_html_with_tags_left_out(spark):
    article = "<article><h1>Big news</h1><p>A paragraph of text, with some words in it, and more of them.</p><p>Another one, which says more.</p></article>"
    text = "Big news A paragraph of text, with some words in it, and more of them. Another one, which says more."
    body = "<html><head><title>T</title></head><body>"
    pages = {
        f"<html><head><title>T</title><body>{article}": text,
        f"<head><meta charset=x><title>T</title>{article}": text,
        f"<html><head><noscript><link rel=x><body>{article}</body></html>": text,
        f"{body}<div class='search'><form action=x><input name=q><label>Find</label></div>{article}</body></html>": text,
        f"{body}<form action=x><input name=q><label>Find</label>{article}</body></html>": text,
        f"{body}<nav><button>Menu</nav>{article}</body></html>": text,
        f"{body}<select><option>a<option>b{article}</body></html>": text,
        f"{body}<noscript><img src=x>{article}</body></html>": text,
        f"{body}<form><div><p>Gone</p></div></form>{article}</body></html>": text,
        f"Some words first. {article}": f"Some words first. {text}",
        f"{body}{article}</body></html> Trailing words.": f"{text} Trailing words.",
        "Hello <b>world</b>": "Hello world",
        "just text": "just text",
    }
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_html(df).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup, suffix_dedup.suffix_dedup, simhash.simhash_dedup, mixing.mix_sources, language_id.language_id, line_dedup.line_dedup, token_counts.token_counts, sentencepiece_fst.encoded):
        assert f(none).count() == 0, f
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extract_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, docs):
    """Each stage on the small table: columns as they came, and the rows a brute-force version keeps."""
    kept = dict(corpus_pipeline.STAGES)
    ids = {d for d, *_ in small()}
    first = kept["language"](spark, docs, "")
    assert first.columns == docs.columns
    assert {30, 31, 32, 33}.isdisjoint(x := {r["doc_id"] for r in first.collect()}) and ids - x <= {30, 31, 32, 33}
    exact = kept["exact_dedup"](spark, docs, "")
    assert exact.columns == docs.columns and exact.count() == len({(t or "").encode().lower() for _, t, *_ in small()})
    near = kept["simhash"](spark, docs, "")
    label = linked({d: plain_fingerprint(t) for d, t, *_ in small() if d is not None})
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == set(label.values())
    taken = mixing.mix_sources(docs).where("doc_id is not null").dropDuplicates(["doc_id", "size"]).collect()
    mixed = Counter(r["doc_id"] for r in kept["mix"](spark, docs, "").collect() if r["doc_id"] is not None)
    for r in taken:
        if r["doc_id"] != 40:
            assert mixed[r["doc_id"]] == (1 if not r["size"] else -(-r["taken"] // r["size"])), r


def test_pipeline_on_clashing_names_and_empty_tables(spark):
    """Columns that are called as helpers might be come through untouched, and empty tables stay empty."""
    names = ["keep_id", "own_digest", "__own", "__id", "mix_id", "mix_time", "taken", "size", "stay_id", "component_id"]
    texts = ["the quick brown fox jumps over the dog", "a wholly other line of plain words here", None, ""]
    made = [(i, t, "en", "ab"[i % 2], 1, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts * 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    df = spark.createDataFrame(made, schema)
    held = {r["doc_id"]: tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and all(tuple(r) == held[r["doc_id"]] for r in got), name
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name


def test_pipeline_run(spark, sf):
    """The whole pipeline: the rows of its stages one after the other, with the library's ids."""
    import sentencepiece

    docs = table(spark, sf, "documents")
    want = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        want = stage(spark, want, sf)
    texts = Counter((r["doc_id"], r["text"]) for r in want.collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(sentencepiece_fst.MODEL))
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter({(d, tuple(sp.encode(t or ""))): n for (d, t), n in texts.items()})


def test_components_of_a_star_and_a_chain(spark):
    from refrain.llm.common import components
    from refrain.session import Scratch

    edges = [(1, i) for i in range(2, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "star")).collect()}
    assert got == {i: 1 for i in range(1, 300)} | {i: 1000 for i in range(1000, 1041)}


def test_exact_dedup_unfolds_many_copies(spark, monkeypatch):
    from refrain.llm import exact_dedup as module

    monkeypatch.setattr(module, "COPIES", 3)
    df = spark.createDataFrame([(1, "same")] * 10 + [(2, "SAME")] * 7, "doc_id long, text string")
    out = exact_dedup(df).collect()
    assert len(out) == 17 and sum(r["kept"] for r in out) == 1 and {r["keep_id"] for r in out} == {2}


def test_topk_with_hard_rows(spark, monkeypatch):
    """Clashing columns, repeated rows, short vectors, very many queries and codes of a block in parts."""
    monkeypatch.setattr(topk, "PART", 7)
    r = random.Random(4)
    base = [r.choice([-1.0, 1.0]) for _ in range(64)]
    near = [[-x if r.random() < 0.08 else x for x in base] for _ in range(150)]
    vecs = [(i * 10, v, 1, 2, 3, 4) for i, v in enumerate(near)] + [(7, base[:40], 0, 0, 0, 0), (20, near[2], 0, 0, 0, 0), (40, near[4], 0, 0, 0, 0)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, q int, code int, rank int, seg int")
    held = [(i, [*v, *[-1.0] * (64 - len(v))]) for i, v, *_ in vecs]
    want = Counter()
    for k, (q, v) in enumerate(held):
        if q % 20 == 0:
            others = sorted((sum((a > 0) != (b > 0) for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(held) if m != k)[:10]
            want.update((q, n + 1, i, d) for n, (d, i) in enumerate(others))
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "distance") == want
    wide = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="more than 64 elements"):
        topk.top_k(wide).count()


def test_token_counts_of_hard_texts():
    """Scripts without spaces, runs without end, special strings and marks: counts as the library's, and no text is encoded over and over."""
    t = token_counts.tokenizer(token_counts.vocabulary_path(token_counts.VOCABULARY))
    r = random.Random(9)
    han = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    kana = "".join(chr(r.randrange(0x3041, 0x3096)) if r.random() < 0.7 else r.choice("一二三、。東京") for _ in range(5_000))
    latin = "".join(r.choice("etaoinshrdlu") for _ in range(5_000))
    marks = "".join(r.choice(["<|endoftext|>", "<|endof", "text|>", "ab", "'s", "'re ", ", ", ". ", "!?", "\n\n ", "  ", "_", "é", "中", "1", " ", "́", "Z'"]) for _ in range(4_000))
    texts = [han, kana, latin, marks, "y" * 3_000, "ab" * 2_000, "'s" * 1_000, "中's" * 500]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [token_counts.count_long(t, x, 200, 16) for x in texts[1:]] == want[1:]
    counter = token_counts.Counter(t)
    assert counter.counts(texts) == want
    for _ in range(300):
        x = "".join(r.choice(["<|endoftext|>", "don't", " the", "word", ",", ".", " ", "  ", "\n", "_", ")", "'", '"', "3", "é", "中文", "<|", "|>", "\x1c", "\x85"]) for _ in range(r.randint(0, 60)))
        assert counter.counts([x]) == [len(t.encode(x, add_special_tokens=False).ids)], repr(x)
    asked = []

    class Spy:
        def encode(self, x, **kw):
            asked.append(len(x))
            return t.encode(x, **kw)

    assert token_counts.count_long(Spy(), han) == want[0]
    assert sum(asked) < 1.6 * len(han) and max(asked) < 2 * token_counts.CHUNK


def test_token_counts_with_short_overlaps():
    """Overlaps shorter than a special string do not cut it; special strings that begin with a letter are counted text by text."""
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    t, r = token_counts.tokenizer(path), random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", "end", "of", "text", "ab", " word", " ", "é", "中"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert token_counts.count_long(t, x, r.randint(20, 60), r.randint(0, 14)) == len(t.encode(x, add_special_tokens=False).ids), x
    own = Tokenizer.from_file(path)
    own.add_special_tokens(["ENDOFALL" * 40])
    assert token_counts.least_overlap(own) == 321
    texts = ["some words " * 3000 + "ENDOFALL" * 40 + "x" * 300, "abENDOFALL" + "ENDOFALL" * 40]
    assert token_counts.Counter(own).counts(texts) == [len(own.encode(x, add_special_tokens=False).ids) for x in texts]


def test_topk_rounds_shrink(spark, monkeypatch, tmp_path):
    """Later rounds plan blocks near the queries that are left only, and no table of a round stays."""
    from refrain.session import Scratch

    r = random.Random(6)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(5)]
    codes = {b ^ (1 << k) for b in base for k in range(0, 60, 2)} | {r.getrandbits(64) - (1 << 63) for _ in range(4000)}
    far = r.getrandbits(64) - (1 << 63)
    index = spark.createDataFrame([(c, 1, i) for i, c in enumerate(sorted(codes))], "code long, n long, least long")
    queries = spark.createDataFrame([(q,) for q in {*base, far}], "q long")
    seen, plan = [], topk._plan

    def planned(spark_, codes_in, queries_in, near, segs):
        seen.append(int(queries_in.sum()) // len(segs))
        return plan(spark_, codes_in, queries_in, near, segs)

    monkeypatch.setattr(topk, "_plan", planned)
    scratch = Scratch(spark, "shrink")
    kept = []
    drop = scratch.drop
    monkeypatch.setattr(scratch, "drop", lambda *names: (kept.extend(names), drop(*names)))
    got = {}
    for x in topk.search(index, queries, 5, scratch).collect():
        got.setdefault(x["q"], []).append(x["distance"])
    for q in {*base, far}:
        want = sorted((q ^ c).bit_count() if (q ^ c) >= 0 else ((q ^ c) & (2**64 - 1)).bit_count() for c in codes)[:5]
        assert sorted(got[q])[:5] == want
    assert seen[0] == 6 and len(seen) > 1 and set(seen[1:]) == {1} and len(kept) == len(seen)


def test_line_levels_settle(spark):
    """A hash that a run has settled adds no row; one that can still change the result does."""
    from refrain.session import Scratch

    def batch(*rows_):
        return spark.createDataFrame([(bytes([h]), n, top) for h, n, top in rows_], "h binary, docs long, top long")

    levels = line_dedup.Levels(Scratch(spark, "levels"), spark)
    levels.add(batch((1, 3, 50), (2, 2, 50), (3, 5, 10), (4, 3, None)))
    added = {r["h"][0]: (r["docs"], r["top"]) for r in levels.add(batch((1, 4, 40), (2, 1, 40), (3, 1, 60), (4, 1, None), (5, 1, 1), (6, 9, 9))).collect()}
    assert added == {2: (1, 40), 3: (1, 60), 5: (1, 1), 6: (9, 9)}
    # By now the runs are compacted, so that 2 is settled too.
    assert levels.add(batch((1, 1, None), (6, 1, 9), (2, 7, 45))).count() == 0
    held = {r["h"][0]: (r["docs"], r["top"]) for r in levels.all().collect()}
    assert held[1] == (3, 50) and held[2] == (3, 50) and held[3] == (6, 60) and held[6] == (9, 9)
    levels.drop()


def test_html_generated_pages(spark):
    """Pages of another seed than the fit's, held to the elements that are marked as their articles."""
    r = random.Random(77)
    pages = [html_extract._page(r) for _ in range(200)]
    want = []
    for p in pages:
        dom = html_extract.parse(p)
        kept = np.array(dom.label)
        for i in range(len(kept) - 1, 0, -1):
            kept[dom.parent[i]] |= kept[i]
        want.append(html_extract._joined(dom, kept))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_html(df).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_html_words_stay_whole_and_pages_may_be_deep(spark):
    article = "<article><h1>Title here</h1><p>A para<wbr>graph with an <b>im</b>age<img src=x>s set<script>1</script>s, and words enough to read.<br>Next line.</p></article>"
    text = "Title here A paragraph with an images sets, and words enough to read. Next line."
    deep = "<html><body>" + "<div>" * 5_000 + "<p>Words at the bottom, and some more of them.</p>" + "</div>" * 5_000 + "</body></html>"
    long = "<html><body><article>" + "<p>Some words of a long page, which go on.</p>" * 20_000 + "</article></body></html>"
    pages = [f"<html><body>{article}</body></html>", deep, long]
    got = list(html_extract.main_texts(pages, html_extract.model()))
    assert got[0] == text
    assert got[1] == "Words at the bottom, and some more of them."
    assert got[2] == " ".join(["Some words of a long page, which go on."] * 20_000)


def test_html_wrappers_that_name_a_state():
    """Whole articles under wrappers that name what the page has, not what the wrapper is; boilerplate beside them goes."""
    said = ["The first paragraph says a few words, and a few more.", "A second one follows it, with other words.", "The third is the last of them, as it seems."]
    for n in (1, 2, 3):
        inner = "<h1>A title of some words</h1>" + "".join(f"<p>{x}</p>" for x in said[:n])
        text = " ".join(["A title of some words", *said[:n]])
        side = '<aside class="sidebar"><h3>More</h3><p>Other things to read.</p></aside>'
        menu = '<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'
        pages = [
            f'<html><body>{menu}<article class="post comments-open">{inner}</article>{side}</body></html>',
            f'<html><body class="comments-open">{menu}<article class="post">{inner}</article>{side}</body></html>',
            f'<html><body class="menu sidebar">{menu}<article>{inner}</article>{side}</body></html>',
            f'<html><body>{menu}<article class="post has-sidebar">{inner}</article>{side}</body></html>',
            f'<html><body>{menu}<article class="story social-share-enabled">{inner}</article>{side}</body></html>',
            f'<html class="no-ads"><body class="menu-open">{menu}<main class="content with-comments">{inner}</main>{side}</body></html>',
        ]
        assert list(html_extract.main_texts(pages, html_extract.model())) == [text] * len(pages)


def test_sentencepiece_unigram(tmp_path):
    """Scores that are weights: the cheapest path is the library's. The model is put together by hand, not trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(6)
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.trainer_spec.unk_surface = " ⁇ "
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = True
    kind = pb.ModelProto.SentencePiece
    for name, type_ in (("<unk>", kind.UNKNOWN), ("<s>", kind.CONTROL), ("</s>", kind.CONTROL)):
        m.pieces.add(piece=name, score=0.0, type=type_)
    held = {sentencepiece_fst.MARK, *"abcde"} | {"".join(r.choice("abcde" + sentencepiece_fst.MARK) for _ in range(r.randint(2, 5))) for _ in range(120)}
    for p in sorted(held):
        m.pieces.add(piece=p, score=-r.uniform(1, 9) * (1 + len(p) / 3), type=kind.NORMAL)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    t = sentencepiece_fst.Transducer(str(path))
    for _ in range(400):
        x = "".join(r.choice("abcde  ") for _ in range(r.randint(0, 60)))
        ids = t.encode(x)
        assert ids == sp.encode(x), x
        assert t.decode(ids) == sp.decode(ids)


def test_sentencepiece_shortest_path_is_the_merges():
    """The registered model: every piece by itself, strings of pieces, of marks and spaces, of rare characters and of one character."""
    import sentencepiece

    path = token_counts.vocabulary_path(sentencepiece_fst.MODEL)
    sp, t, r = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path), random.Random(5)
    pieces = list(t.pieces)
    hard = [p.replace(sentencepiece_fst.MARK, " ") for p in pieces]
    for _ in range(700):
        hard.append("".join(r.choice(pieces).replace(sentencepiece_fst.MARK, r.choice([" ", "▁", ""])) for _ in range(r.randint(0, 12))))
        hard.append("".join(r.choice("aeinst  \n\t▁éñ你好🙂\x00") for _ in range(r.randint(0, 40))))
        hard.append(r.choice(["a", "ab", " ", "▁", "=-", "0"]) * r.randint(1, 200))
    assert [x for x in hard if t.encode(x) != sp.encode(x)] == []
    assert [x for x in hard if t.decode(t.encode(x)) != sp.decode(sp.encode(x))] == []


@pytest.mark.parametrize(("rule", "squeeze", "prefix"), [("nmt_nfkc", True, True), ("nmt_nfkc_cf", True, False), ("nfkc", False, True), ("identity", True, True), ("nmt_nfkc", False, False)])
def test_sentencepiece_normaliser(rule, squeeze, prefix):
    """Compiled character maps, squeezing and the mark in front, as the library normalises."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    m = pb.ModelProto()
    m.ParseFromString(made.serialized_model_proto())
    m.normalizer_spec.escape_whitespaces, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, prefix, squeeze
    m.pieces.add(piece="<unk>", type=pb.ModelProto.SentencePiece.UNKNOWN)
    m.pieces.add(piece="a", score=-1.0, type=pb.ModelProto.SentencePiece.NORMAL)
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    own, r = sentencepiece_fst.Normaliser(m.normalizer_spec), random.Random(8)
    for _ in range(1500):
        x = "".join(r.choice("abAB  \t\n\u3000▁ﬁ½Ǻéｱﾞ㎏\x00\x07\u200b\u0301가") for _ in range(r.randint(0, 30)))
        assert own.run(x) == library.normalize(x), x


def test_op3_acceptor_judges_by_borders_as_merging_does_and_meets_units_once(monkeypatch):
    from refrain.llm import sentencepiece_fst as fst

    t = fst.Transducer(fst.vocabulary_path(fst.MODEL))
    some = sorted(t.pieces)[::97]
    for a in some:
        for b in (*some[::9], *(a[k:] for k in range(1, len(a)) if a[k:] in t.pieces)):
            assert t._follows(a, b) == (t._merged(a + b) == [a, b])
    composed = []
    monkeypatch.setattr(fst.Transducer, "_paths", lambda self, texts, *a, f=fst.Transducer._paths: composed.extend(texts) or f(self, texts, *a))
    texts = ["one two \U0001f600 two  \x00 three", "", "two three", "x" * 300 + " two"]
    found = t.encode_all(texts)
    # A unit that several texts hold is composed once.
    assert composed.count("▁two") == 1
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=fst.vocabulary_path(fst.MODEL))
    assert [ids.tolist() for ids in found] == [lib.encode(x) for x in texts]
