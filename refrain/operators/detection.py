"""From evidence to cuts: regions, how they are judged, bridging, the tail and the last filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import lexicon
from refrain.operators import intervals, sequences
from refrain.session import Scratch


@dataclass(frozen=True)
class Params:
    max_run: float = 300.0
    max_pair_fraction: float = 0.35
    min_match: int = 2
    confirm_below: int = 4
    bridge_free: float = 90.0
    bridge_max: float = 90.0
    tail_eof_snap: float = 25.0
    min_cut: float = 5.0


def excluded_pairs(evidence: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """id, other, shared: pairs whose evidence (id, other, start, end) makes up too much of the shorter item."""
    total = evidence.groupBy("id", "other").agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
    own = lengths.select("id", F.col("length").alias("la"))
    other = lengths.select(F.col("id").alias("other"), F.col("length").alias("lb"))
    bad = total.join(own, "id").join(other, "other").where(F.col("shared") > F.least("la", "lb") * p.max_pair_fraction)
    return bad.select("id", "other", "shared")


def _fair(evidence: DataFrame, excluded: DataFrame, p: Params) -> DataFrame:
    kept = evidence.join(excluded.select("id", "other"), ["id", "other"], "left_anti")
    return kept.where(F.col("end") - F.col("start") <= p.max_run)


def without_compilations(evidence: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """Evidence (id, other, start, end) without pairs that share too much and without overlong runs."""
    return _fair(evidence, excluded_pairs(evidence, lengths, p), p)


def regions(evidence: DataFrame, gap: float = 2.0) -> DataFrame:
    """id, start, end, n_matches, srcs: unions of evidence with their distinct sources, in one grouping by id.

    Evidence of no length counts only strictly inside its region, and a region of such alone is none.
    """
    e = intervals.parted(evidence.select("id", "start", "end", "other"), ["id"], gap)
    long = F.col("end") > F.col("start")
    own = e.groupBy("id", "__part").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.collect_set(F.when(long, F.col("other"))).alias("srcs"),
        F.collect_list(F.when(~long, F.struct("start", "end", "other"))).alias("points"),
    )
    inside = F.transform(F.filter("points", lambda x: (x["end"] > F.col("s")) & (x["start"] < F.col("e"))), lambda x: x["other"])
    own = own.withColumn("srcs", F.sort_array(F.array_union("srcs", inside))).where(F.size("srcs") > 0)
    return own.select("id", F.col("s").alias("start"), F.col("e").alias("end"), "srcs", F.size("srcs").alias("n_matches"))


def classified(regs: DataFrame, segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Regions with method and confidence; those that nothing confirms go. segments: id, start, end, idx, text."""
    text = intervals.text_between(regs.select("id", "start", "end"), segments, ["id"])
    has = segments.select("id").distinct().withColumn("has_tx", F.lit(True))
    r = regs.join(text, ["id", "start", "end"], "left").join(has, "id", "left")
    n, t = F.col("n_matches"), F.coalesce("text", F.lit(""))
    sure = max(p.min_match, p.confirm_below)
    method = (
        F.when(n >= sure, "audio_repeat")
        .when(F.col("has_tx").isNull(), F.when(n >= p.min_match, "audio_repeat"))
        .when(F.trim(t) == "", F.when(n >= p.min_match, "audio_repeat_music"))
        .when(lexicon.is_ad(t), "audio_repeat+transcript")
    )
    sureness = F.when(n >= sure, 0.9).when(F.col("method") == "audio_repeat_music", 0.85).otherwise(0.8)
    r = r.withColumn("method", method).where("method is not null")
    return r.select("id", "start", "end", "n_matches", "srcs", "method", sureness.alias("confidence"), F.substring(t, 1, 300).alias("excerpt"))


def bridged(regs: DataFrame, gap: float, most: float = 0.0, segments: DataFrame | None = None) -> DataFrame:
    """Regions up to ``gap`` apart become one, and those up to ``most`` apart if what is said between them reads as an advert.

    The method says so if the gap was over half a second. A gap lies between a region's start and the furthest end
    before it, whatever was merged: parts that stay apart end before all that follows. So all gaps are judged at once.
    """
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    m = regs.withColumns({"reach": reach, "apart": F.col("start") - reach})
    closes = F.col("apart") <= gap
    if segments is not None and most > gap:
        open_ = m.where((F.col("apart") > gap) & (F.col("apart") <= most)).select("id", F.col("reach").alias("start"), F.col("start").alias("end")).distinct()
        said = intervals.text_between(open_, segments, ["id"]).where((F.col("text") != "") & lexicon.is_ad(F.col("text")))
        said = said.select("id", F.col("start").alias("reach"), F.col("end").alias("start"), F.lit(True).alias("told"))
        m = m.join(said, ["id", "reach", "start"], "left")
        closes |= F.coalesce("told", F.lit(False))
    m = m.withColumn("closes", F.coalesce(closes, F.lit(False)))
    m = m.withColumn("part", F.sum((~F.col("closes")).cast("int")).over(order))
    m = m.withColumn("apart", F.when(F.col("closes"), F.col("apart")))
    # In order of place: what was there, "bridge" where a wide gap is bridged, what comes behind it; each label once.
    none = F.array().cast("array<string>")
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "apart", "method")))
    labels = F.flatten(F.transform(parts, lambda x: F.concat(F.when(x["apart"] > 0.5, F.array(F.lit("bridge"))).otherwise(none), F.split(x["method"], "[+]"))))
    return m.groupBy("id", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_matches").alias("n_matches"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("srcs")))).alias("srcs"),
        F.array_join(F.array_distinct(labels), "+").alias("method"),
        F.max("confidence").alias("confidence"), F.min_by("excerpt", "start").alias("excerpt"),
    ).drop("part")


def file_tails(regs: DataFrame, segments: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """The last region runs to the item's near end if nothing or something marked is said there. Items without segments stay."""
    last = F.col("end") == F.max("end").over(Window.partitionBy("id"))
    left = F.col("length") - F.col("end")
    near = regs.join(lengths.select("id", "length"), "id").withColumn("near", last & (left > 0.5) & (left <= p.tail_eof_snap))
    ends = near.where("near").select("id", F.col("end").alias("start"), F.col("length").alias("end")).distinct()
    said = intervals.text_between(ends, segments, ["id"]).select("id", F.col("text").alias("__said"))
    told = segments.select("id").distinct().withColumn("__told", F.lit(True))
    r = near.join(said, "id", "left").join(told, "id", "left")
    quiet = F.coalesce(F.trim("__said"), F.lit("")) == ""
    tail = F.col("near") & F.coalesce("__told", F.lit(False)) & (quiet | (lexicon.strong_hits(F.col("__said")) > 0))
    r = r.withColumn("method", F.when(tail, F.concat("method", F.lit("+eof_tail"))).otherwise(F.col("method")))
    return r.withColumn("end", F.when(tail, F.col("length")).otherwise(F.col("end"))).select(*regs.columns)


def clamped(regs: DataFrame, lengths: DataFrame) -> DataFrame:
    r = regs.join(lengths.select("id", "length"), "id")
    return r.withColumns({"start": F.greatest("start", F.lit(0.0)), "end": F.least("end", "length")}).select(*regs.columns)


def emitted(regs: DataFrame, segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Without the shortest, times to 2 places, with what is said in the cut as it is in the end."""
    r = regs.where(F.col("end") - F.col("start") >= p.min_cut).drop("excerpt")
    said = intervals.text_between(r.select("id", "start", "end").distinct(), segments, ["id"]).select("id", "start", "end", F.substring("text", 1, 300).alias("excerpt"))
    r = r.join(said, ["id", "start", "end"], "left")
    return r.select("id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "n_matches", "method", "confidence", F.coalesce("excerpt", F.lit("")).alias("excerpt"))


def timed_runs(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """id, other, start, end: common runs of words by the times of their first and last words.

    runs: id, other, i (position of the first word in the item), words. A run ends where its last word begins.
    """
    ends = runs.select("id", "other", F.col("i").cast("long").alias("a"), (F.col("i") + F.col("words") - 1).cast("long").alias("z"))
    at = sequences.times_at(ends.select("id", F.col("a").alias("i")).union(ends.select("id", F.col("z").alias("i"))).distinct(), segments)
    first, last = at.select("id", F.col("i").alias("a"), F.col("at").alias("start")), at.select("id", F.col("i").alias("z"), F.col("at").alias("end"))
    return ends.join(first, ["id", "a"]).join(last, ["id", "z"]).select("id", "other", "start", "end")


def script_intervals(runs: DataFrame) -> DataFrame:
    """id, other, start, end: unions of the timed runs of a pair."""
    return intervals.union(runs.select("id", "other", "start", "end"), ["id", "other"], 2.0).drop("n")


def script_evidence(runs: DataFrame, segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Repeated words as evidence. runs: id, other, start, end; unions of them that read as adverts and are not overlong."""
    return fair_adverts(script_intervals(runs), segments, p)


def fair_adverts(u: DataFrame, segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Those of the unions (id, other, start, end) that read as adverts and are not overlong.

    A pair whose unions make up too much of the time to the last word of either item gives none. Items without words
    take no part.
    """
    last = sequences.last_word(segments)
    own, other = last.select("id", F.col("at").alias("la")), last.select(F.col("id").alias("other"), F.col("at").alias("lb"))
    total = u.groupBy("id", "other").agg(F.sum(F.col("end") - F.col("start")).alias("shared")).join(own, "id").join(other, "other")
    fair = u.join(total.where(F.col("shared") <= F.least("la", "lb") * p.max_pair_fraction).select("id", "other"), ["id", "other"], "left_semi")
    fair = fair.where(F.col("end") - F.col("start") <= p.max_run)
    text = intervals.text_between(fair.select("id", "start", "end").distinct(), segments, ["id"])
    return fair.join(text.where(lexicon.is_ad(F.col("text"))).select("id", "start", "end"), ["id", "start", "end"], "left_semi").select("id", "other", "start", "end")


def detect(evidence: DataFrame, segments: DataFrame, lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """The plain form: what is found, judged and bridged, without work on the edges.

    Evidence, regions, judged regions and the cuts' bounds are written tables, as the steps behind them read them several times.
    """
    scratch = Scratch(evidence.sparkSession, "detect")
    evidence = scratch.save(evidence.select("id", "other", "start", "end"), "evidence")
    regs = scratch.save(regions(without_compilations(evidence, lengths, p)), "regions")
    found = scratch.save(classified(regs, segments, p), "found")
    ends = file_tails(scratch.save(bridged(found, p.bridge_free, p.bridge_max, segments), "bridged"), segments, lengths, p)
    ends = scratch.save(clamped(ends, lengths), "ends")
    scratch.drop("evidence", "regions", "found", "bridged")
    return emitted(ends, segments, p)


def detect_refined(evidence: DataFrame, runs: DataFrame, segments: DataFrame, lengths: DataFrame, groups: DataFrame, p: Params = Params()) -> DataFrame:
    """The full form, for all items at once: script evidence and blocks too, edges walked, trimmed, snapped and freed of live talk.

    evidence, runs (``timed_runs``): id, other, start, end. segments: id, idx, start, end, text. lengths: id, length. groups: id, grp.
    Pairs that the evidence excludes as compilations leave the runs and the judgement of live talk too.
    """
    from refrain.operators import edges

    # Each step reads its input several times, so each is a written table: a plan of all of them would grow by powers.
    scratch = Scratch(evidence.sparkSession, "detect")
    excluded = scratch.save(excluded_pairs(evidence, lengths, p), "excluded")
    said = runs.join(excluded.select("id", "other"), ["id", "other"], "left_anti")
    every = scratch.save(_fair(evidence, excluded, p).unionByName(script_evidence(said, segments, p)), "evidence")
    found = scratch.save(classified(scratch.save(regions(every), "regions"), segments, p), "found")
    found = scratch.save(found.unionByName(edges.standalone(found, segments)), "blocks")
    r = scratch.save(edges.extended(bridged(found, p.bridge_free, p.bridge_max, segments), segments, lengths), "extended")
    r = scratch.save(edges.outro_tails(r, segments, lengths), "outro")
    r = scratch.save(bridged(clamped(file_tails(r, segments, lengths, p), lengths), 0.5), "merged")
    r = scratch.save(edges.without_weak_edges(r, segments, every, lengths), "trimmed")
    r = scratch.save(edges.snapped(r, segments, lengths), "snapped")
    return emitted(edges.without_live_talk(r, edges.live(segments, groups, excluded)), segments, p)


def report(cuts: DataFrame, lengths: DataFrame, feed: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, n_regions, total_cut, expected, excluded_pairs: every item, with the excess of its length over the feed's (id, said) if there is one.

    excluded: from ``excluded_pairs``; an item's are listed as (other, shared).
    """
    n = cuts.groupBy("id").agg(F.count(F.lit(1)).alias("n_regions"), F.round(F.sum(F.col("end") - F.col("start")), 1).alias("total_cut"))
    left_out = excluded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("other", F.round("shared", 1).alias("shared")))).alias("excluded_pairs"))
    over = F.col("length") - F.col("said")
    r = lengths.join(n, "id", "left").join(feed, "id", "left").join(left_out, "id", "left")
    return r.select(
        "id", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("total_cut", F.lit(0.0)).alias("total_cut"), F.when(over > 0, F.round(over, 1)).alias("expected"),
        F.coalesce("excluded_pairs", F.array().cast(left_out.schema["excluded_pairs"].dataType)).alias("excluded_pairs"),
    )
