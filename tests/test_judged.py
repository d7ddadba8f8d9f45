"""The whole detection on the given tables: what it finds, and that all its ways of judging occur."""

from refrain.plans import judged


def test_all_kinds_of_regions_and_labels_occur(spark, sf):
    kinds = {(r["method"], r["confidence"]) for r in judged.region_judged(spark, sf).select("method", "confidence").distinct().collect()}
    assert {("audio_repeat", 0.9), ("audio_repeat", 0.8), ("audio_repeat_music", 0.85), ("audio_repeat+transcript", 0.8)} >= kinds
    assert {("audio_repeat", 0.9), ("audio_repeat", 0.8), ("audio_repeat+transcript", 0.8)} <= kinds
    labels = {r["method"] for r in judged.bridged_methods(spark, sf).select("method").distinct().collect()}
    assert any(m.count("+") > 1 for m in labels)


def test_the_full_detection_finds_cuts(spark, sf):
    """Cuts are long enough, lie in their item, and come from evidence as well as from the transcript alone."""
    _, _, lengths = judged._world(spark, sf)
    length = {r["id"]: r["length"] for r in lengths.collect()}
    cuts = judged.planted_refined(spark, sf).collect()
    assert cuts and all(0 <= c["start"] and c["end"] - c["start"] >= 4.99 and c["end"] <= length[c["id"]] + 0.01 for c in cuts)
    labels = {x for c in cuts for x in c["method"].split("+")}
    assert {"audio_repeat", "transcript", "transcript_only", "bridge", "extend"} <= labels
