"""The detection over line items as evidence and dressed conversations as transcripts, step by step and whole, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.functions import lexicon
from refrain.operators import detection, sequences
from refrain.plans import registry
from refrain.session import Scratch


def _world(spark, sf_dir):
    """Evidence, segments and lengths: a line item is a span that its order shares with its supplier's number."""
    scratch = Scratch(spark, "world")
    segs = scratch.save(registry._aired(spark, sf_dir), "segments")
    said = segs.groupBy("id").agg(F.max("end").alias("said"))
    spans = registry._spans(spark, sf_dir)
    lengths = spans.groupBy("id").agg(F.max("end").alias("length")).join(said, "id", "left")
    return spans, segs, scratch.save(lengths.select("id", F.greatest("length", "said").alias("length")), "lengths")


def region_judged(spark, sf_dir):
    """Regions by the number of their sources and what is said in them; all four kinds occur."""
    ev, segs, _ = _world(spark, sf_dir)
    return detection.classified(detection.regions(ev), segs).select("id", "start", "end", "n_matches", "method", "confidence", "excerpt")


def bridged_methods(spark, sf_dir):
    """Judged regions bridged: the labels of those that become one, in order of place."""
    ev, segs, _ = _world(spark, sf_dir)
    return detection.bridged(detection.classified(detection.regions(ev), segs), 90.0).select("id", "start", "end", "n_matches", "method", "confidence")


def planted_cuts(spark, sf_dir):
    """The plain detection from evidence to cuts."""
    ev, segs, lengths = _world(spark, sf_dir)
    return detection.detect(ev, segs, lengths)


def planted_report(spark, sf_dir):
    """What was cut of every item, how much longer it is than its feed says, and which pairs were excluded."""
    ev, segs, lengths = _world(spark, sf_dir)
    cuts = Scratch(spark, "planted").save(detection.detect(ev, segs, lengths).select("id", "start", "end"), "cuts")
    feed = lengths.select("id", (F.col("length") - (F.col("id") % 5 - 2)).alias("said"))
    r = detection.report(cuts, lengths, feed, detection.excluded_pairs(ev, lengths))
    pairs = F.array_join(F.transform("excluded_pairs", lambda x: F.concat_ws(":", x["other"].cast("string"), x["shared"].cast("decimal(20,1)").cast("string"))), ",")
    return r.select("id", "n_regions", "total_cut", "expected", pairs.alias("excluded"))


def planted_refined(spark, sf_dir):
    """The full detection: script evidence, blocks of the transcript alone and work on the edges too."""
    ev, segs, lengths = _world(spark, sf_dir)
    scratch = Scratch(spark, "planted-refined")
    said = segs.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    docs = said.select(F.lit(1).alias("grp"), "id", "text")
    runs = scratch.save(detection.timed_runs(registry._both_ways(sequences.word_runs(docs)), segs), "runs")
    return detection.detect_refined(scratch.save(ev, "evidence"), runs, segs, lengths, lengths.select("id", F.lit(1).alias("grp")))


def _said_lines(spark, sf_dir):
    """The lines of documents with the times of their hashes; lines of even length are adverts, as these texts hold none."""
    phrase = F.element_at(F.array(*map(F.lit, lexicon.STRONG)), F.length("text") % len(lexicon.STRONG) + 1)
    dressed = F.when(F.length("text") % 2 == 0, F.concat(phrase, F.lit(" "), "text")).otherwise(F.col("text"))
    return registry._lines(spark, sf_dir).withColumn("text", dressed)


def heard_cuts(spark, sf_dir):
    """Flagship: hash streams matched inside groups, judged by what is said, bridged and cut, for all items at once."""
    scratch = Scratch(spark, "heard")
    segs = scratch.save(_said_lines(spark, sf_dir), "segments")
    return detection.detect(registry._heard(spark, sf_dir), segs, scratch.save(registry._lengths(spark, sf_dir), "lengths"))


QUERIES = {f.__name__: f for f in (region_judged, bridged_methods, planted_cuts, planted_report, planted_refined, heard_cuts)}

_STRONG, _READS = registry._strong_sql(), registry._reads_sql()


def _judged_sql(evidence: str) -> str:
    """rj: regions of ``evidence`` (a query of id, s, e, other) that something confirms, with method and confidence."""
    return f"""ev AS MATERIALIZED ({evidence}),
    m1 AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
    m2 AS (SELECT *, sum(CASE WHEN s > reach + 2 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e, reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS part FROM m1),
    m3 AS (SELECT id, part, min(s) AS s, max(e) AS e FROM m2 GROUP BY id, part),
    rg AS (SELECT m3.id, m3.s, m3.e, count(DISTINCT other)::INT AS n FROM m3 JOIN ev ON ev.id = m3.id AND ev.e > m3.s AND ev.s < m3.e GROUP BY ALL),
    rt AS (SELECT rg.id, rg.s, rg.e, n, rg.id IN (SELECT id FROM seg) AS has, coalesce(string_agg(t, ' ' ORDER BY idx), '') AS txt, lower(coalesce(string_agg(t, ' ' ORDER BY idx), '')) AS low
        FROM rg LEFT JOIN seg ON seg.id = rg.id AND seg.e > rg.s AND seg.s < rg.e GROUP BY ALL),
    rm AS (SELECT id, s, e, n, left(txt, 300) AS excerpt, CASE WHEN n >= 4 THEN 'audio_repeat' WHEN NOT has THEN CASE WHEN n >= 2 THEN 'audio_repeat' END
        WHEN trim(txt) = '' THEN CASE WHEN n >= 2 THEN 'audio_repeat_music' END WHEN {_READS} THEN 'audio_repeat+transcript' END AS method FROM rt),
    rj AS MATERIALIZED (SELECT *, CASE WHEN n >= 4 THEN 0.9 WHEN method = 'audio_repeat_music' THEN 0.85 ELSE 0.8 END::DOUBLE AS sure FROM rm WHERE method IS NOT NULL)"""


#: Judged regions up to 90 apart as one, each label once in order of place.
_BRIDGED = """b1 AS (SELECT *, s - max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM rj),
    b2 AS MATERIALIZED (SELECT *, sum(CASE WHEN apart <= 90 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM b1),
    b3 AS (SELECT id, part, s, CASE WHEN apart > 0.5 AND apart <= 90 THEN ['bridge'] ELSE [] END || string_split(method, '+') AS ls FROM b2),
    b4 AS (SELECT id, part, l, min({'s': s, 'k': k}) AS place FROM (SELECT id, part, s, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM b3) GROUP BY id, part, l),
    b5 AS (SELECT id, part, string_agg(l, '+' ORDER BY place) AS method FROM b4 GROUP BY id, part),
    bj AS MATERIALIZED (SELECT id, min(s) AS s, max(e) AS e, max(n)::INT AS n, any_value(b5.method) AS method, max(sure) AS sure FROM b2 JOIN b5 USING (id, part) GROUP BY id, part)"""
_SPAN = f"sp AS MATERIALIZED ({registry._SPANS})"
_LENGTHS = "ln AS MATERIALIZED (SELECT id, greatest(max(sp.e), max(said)) AS length FROM sp LEFT JOIN (SELECT id, max(e) AS said FROM seg GROUP BY id) USING (id) GROUP BY id)"
_BAD = """bad AS MATERIALIZED (SELECT sp.id, other, sum(e - s) AS shared FROM sp JOIN ln a ON a.id = sp.id JOIN ln b ON b.id = sp.other
    GROUP BY sp.id, other HAVING sum(e - s) > least(any_value(a.length), any_value(b.length)) * 0.35::DOUBLE)"""
#: From sp (id, s, e, other), seg and ln to cuts.
_CHAIN = f"""{_BAD}, {_judged_sql("SELECT * FROM sp WHERE e - s <= 300 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.id = sp.id AND bad.other = sp.other)")}, {_BRIDGED},
    f1 AS (SELECT bj.*, length, bj.e = max(bj.e) OVER (PARTITION BY id) AND length - bj.e > 0.5 AND length - bj.e <= 25 AND id IN (SELECT id FROM seg) AS near FROM bj JOIN ln USING (id)),
    f2 AS (SELECT f1.id, f1.s, f1.e, lower(coalesce(string_agg(t, ' ' ORDER BY idx), '')) AS low FROM f1 LEFT JOIN seg ON seg.id = f1.id AND seg.e > f1.e AND seg.s < f1.length WHERE near GROUP BY ALL),
    f3 AS (SELECT id, s, e, trim(low) = '' OR {_STRONG} > 0 AS tail FROM f2),
    f4 AS (SELECT id, greatest(s, 0) AS s, CASE WHEN tail THEN length ELSE least(e, length) END AS e, n, CASE WHEN tail THEN method || '+eof_tail' ELSE method END AS method, sure FROM f1 LEFT JOIN f3 USING (id, s, e)),
    cuts AS MATERIALIZED (SELECT f4.id, round(f4.s, 2) AS "start", round(f4.e, 2) AS "end", n AS n_matches, method, sure AS confidence, left(coalesce(string_agg(t, ' ' ORDER BY idx), ''), 300) AS excerpt
        FROM f4 LEFT JOIN seg ON seg.id = f4.id AND seg.e > f4.s AND seg.s < f4.e WHERE f4.e - f4.s >= 5 GROUP BY f4.id, f4.s, f4.e, n, method, sure)"""
_CUTS = f"{registry._AIRED}, {_SPAN}, {_LENGTHS}, {_CHAIN}"
#: Of a pair's runs, those that the greedy choice keeps; the lines of documents, dressed, with the times of their hashes.
_HEARD = f"""er AS MATERIALIZED ({registry.SQL["error_runs"]}),
    ro AS (SELECT a, b, ber, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY a, b ORDER BY ber, "start", "end") AS k FROM er),
    gc AS (SELECT a, b, 1::BIGINT AS k, [{{'s': s, 'e': e}}] AS kept FROM ro WHERE k = 1
        UNION ALL SELECT ro.a, ro.b, gc.k + 1, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(kept) AS x) WHERE ro.s < x.e - 0.5 AND ro.e > x.s + 0.5)
        THEN kept ELSE list_append(kept, {{'s': ro.s, 'e': ro.e}}) END FROM gc JOIN ro ON ro.a = gc.a AND ro.b = gc.b AND ro.k = gc.k + 1),
    gk AS (SELECT a, b, unnest(arg_max(kept, k)) AS x FROM gc GROUP BY a, b),
    sp AS MATERIALIZED (SELECT a AS id, x.s AS s, x.e AS e, b AS other FROM gk),
    d1 AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents),
    d2 AS (SELECT *, len({registry._TOK.replace("text", "x")}) AS n FROM d1),
    d3 AS (SELECT id, idx, x, sum(n) OVER (PARTITION BY id ORDER BY idx ROWS UNBOUNDED PRECEDING) / 8.06::DOUBLE AS e, n / 8.06::DOUBLE AS long FROM d2),
    seg AS MATERIALIZED (SELECT id, idx, CASE WHEN length(x) % 2 = 0 THEN {registry._STRONG_LIST}[length(x) % {len(lexicon.STRONG)} + 1] || ' ' || x ELSE x END AS t, e - long AS s, e FROM d3 WHERE trim(x) <> ''),
    ln AS MATERIALIZED (SELECT doc_id AS id, len({registry._TOK.replace("text", "coalesce(text, '')")}) / 8.06::DOUBLE AS length FROM documents)"""

SQL = {
    "region_judged": f"""WITH {registry._AIRED}, {_judged_sql(registry._SPANS)} SELECT id, s AS "start", e AS "end", n AS n_matches, method, sure AS confidence, excerpt FROM rj""",
    "bridged_methods": f"""WITH {registry._AIRED}, {_judged_sql(registry._SPANS)}, {_BRIDGED} SELECT id, s AS "start", e AS "end", n AS n_matches, method, sure AS confidence FROM bj""",
    "planted_cuts": f"WITH {_CUTS} SELECT * FROM cuts",
    "planted_report": f"""WITH {_CUTS}, c AS (SELECT id, count(*)::BIGINT AS n, round(sum("end" - "start"), 1) AS total FROM cuts GROUP BY id),
        x AS (SELECT id, string_agg(other || ':' || round(shared, 1)::DECIMAL(20,1), ',' ORDER BY other) AS ex FROM bad GROUP BY id)
        SELECT id, coalesce(n, 0)::BIGINT AS n_regions, coalesce(total, 0.0)::DOUBLE AS total_cut, CASE WHEN id % 5 > 2 THEN round((id % 5 - 2)::DOUBLE, 1) END AS expected, coalesce(ex, '') AS excluded
        FROM ln LEFT JOIN c USING (id) LEFT JOIN x USING (id)""",
    "heard_cuts": f"WITH RECURSIVE {_HEARD}, {_CHAIN} SELECT * FROM cuts",
    #: Of the registry's queries: turns that are spoken in their conversation only.
    "live_turns": f"""WITH t AS (SELECT conv_id AS id, turn AS idx, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, {registry._TOK.replace("text", "coalesce(text, '')")} AS w FROM conversations),
        g AS (SELECT id, idx, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 4)),
        h AS (SELECT g, min(id) <> max(id) AS shared FROM g GROUP BY g), s AS (SELECT id, idx, avg(shared::INT) AS share FROM g JOIN h USING (g) GROUP BY id, idx)
        SELECT id, idx, CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '(?s)^[\\(\\[♪].*[\\)\\]♪]$') OR {_STRONG} > 0 THEN false
        WHEN greatest(len(regexp_extract_all(text, '\\S+')), 1) <= 20 AND regexp_matches(low, {registry._quoted(lexicon.BREAK)}) THEN true ELSE coalesce(share < 0.5, false) END AS live
        FROM t LEFT JOIN s USING (id, idx)""",
}
