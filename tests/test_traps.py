"""Cases whose answers are known by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions import numbers as N
from voxtable.functions import text as T
from voxtable.operators import similarity
from voxtable.operators import aggregates as A
from voxtable.operators import decode, folds
from voxtable.operators import intervals as J
from voxtable.operators import sequences as W

SEG = "session long, seg_idx long, speaker string, t0 double, t1 double"


def segments(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEG)


def test_chain_of_islands_becomes_one_speaker(spark):
    s = segments(spark, *[(x, float(i), i + 1.0) for i, x in enumerate("ABABA")])
    assert [r.speaker for r in folds.smoothed_segments(s).collect()] == ["A"]
    sure = s.withColumn("confidence", F.lit(None).cast("double"))
    assert [r.speaker for r in folds.smoothed_by_confidence(sure).collect()] == ["A"]


def test_confident_island_stays(spark):
    s = segments(spark, ("A", 0.0, 5.0), ("B", 5.0, 6.0), ("A", 6.0, 9.0)).withColumn("confidence", F.lit(0.9))
    assert sorted(r.speaker for r in folds.smoothed_by_confidence(s).collect()) == ["A", "A", "B"]


def test_frame_islands_look_at_original_runs(spark):
    f = spark.createDataFrame([(1, i, i / 2, x) for i, x in enumerate("AABBAABBAA")], "session long, i long, t double, path string")
    out = [r.smoothed for r in W.smoothed_islands(f, "path", 1.0).orderBy("i").collect()]
    assert "".join(out) == "AAAABBAAAA"


def test_overlaps_merge_in_turns_but_not_in_timelines(spark):
    s = segments(spark, ("A", 0.0, 1.0), ("A", 0.5, 2.0))
    assert W.merged_timeline(s).count() == 2
    assert [(r.t0, r.t1) for r in W.merged_turns(s, least=0.0).collect()] == [(0.0, 2.0)]


def test_word_between_two_segments_goes_to_the_earliest_around_its_middle(spark):
    s = segments(spark, ("X", 0.0, 1.0), ("Y", 1.0, 2.0))
    w = spark.createDataFrame([(1, 0, 0.9, 1.1), (1, 1, 5.0, 6.0), (1, 2, 0.95, 1.9)], "session long, word_idx long, t0 double, t1 double")
    out = {r.word_idx: r.assigned for r in J.assign_by_overlap(w, s).collect()}
    assert out == {0: "X", 1: None, 2: "Y"}


def test_as_of_labels(spark):
    known = spark.createDataFrame([(1, 2.0, 0, "a"), (1, 2.0, 1, "b")], "session long, t double, idx long, label string")
    points = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 9.0)], "session long, i long, t double")
    out = {r.i: r.label for r in J.as_of(points, known, "label", "UNKNOWN").collect()}
    assert out == {0: "UNKNOWN", 1: "b", 2: "b"}


def test_error_run_at_the_end_lasts_one_step_more(spark):
    g = spark.createDataFrame([(1, i, i / 10, "G", "H" if i > 6 else "G") for i in range(10)], "session long, i long, t double, gold string, pred string")
    (r,) = W.error_intervals(g, "gold", "pred", ("G", "H"), 0.1, least=0.2).collect()
    assert (round(r.t0, 6), round(r.t1, 6)) == (0.7, 1.0)


def test_open_silence_does_not_count(spark):
    v = [1, 0, 0, 0, 1, 0, 0, 0]
    f = spark.createDataFrame([(1, i, float(i), float(x)) for i, x in enumerate(v)], "session long, i long, t double, vad double")
    assert [(r.t0, r.t1) for r in W.silences(f).collect()] == [(1.0, 4.0)]


def test_mapping_of_one_label(spark):
    p = spark.createDataFrame([("x", 1, 5.0), ("x", 0, 1.0)], "label string, gold int, seconds double")
    (r,) = A.best_mapping(p).collect()
    assert (r.mask, r.accuracy) == (0, 0.0)


@pytest.mark.parametrize("seconds", [[(3, 1), (1, 3)] * 8, [(1, 2), (2, 2), (0, 1)], [(2, 1), (3, 1), (2, 1)], [(1, 1), (1, 1)], [(0, 0)] * 3, [(5, 5 + i % 3) for i in range(11)]])
def test_mapping_of_labels_by_brute_force(spark, seconds):
    rows = [(f"l{i:02d}", g, float(x)) for i, pair in enumerate(seconds) for g, x in zip((1, 0), pair, strict=True)]
    (r,) = A.best_mapping(spark.createDataFrame(rows, "label string, gold int, seconds double")).collect()
    total = sum(map(sum, seconds)) or 1
    n = len(seconds)
    scores = {m: sum(x[0] if m >> i & 1 else x[1] for i, x in enumerate(seconds)) / total for m in range(1, 2**n - 1)}
    best = max(scores.values())
    assert r.mask == min(m for m, s in scores.items() if abs(s - best) < 1e-12) and abs(r.accuracy - best) < 1e-9
    assert r.labels == [f"l{i:02d}" for i in range(n) if r.mask >> i & 1]


def test_speaker_mapping_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        refs, hyps = "ABCD"[: rng.randrange(1, 5)], "wxyz"[: rng.randrange(1, 5)]
        counts = {(r, h): rng.randrange(4) for r in refs for h in hyps}
        if len(hyps) <= len(refs):
            options = [dict(zip(hyps, order, strict=True)) for order in itertools.permutations(refs, len(hyps))]
        else:
            options = [dict(zip(hyps, order, strict=True)) for order in itertools.product(refs, repeat=len(hyps))]
        wanted = max(options, key=lambda m: sum(counts[r, h] for h, r in m.items()))
        assert decode.best_speaker_mapping(counts) == (wanted, sum(counts[r, h] for h, r in wanted.items()))
    assert decode.best_speaker_mapping({(f"r{i}", f"h{i}"): 1 for i in range(14)})[1] == 14


def test_sessions_decode_alike_alone_and_together():
    rng = np.random.default_rng(5)
    parts = [(rng.dirichlet(np.ones(3), n), rng.random(n)) for n in (40, 1, 7, 0, 90, 40)]
    together = decode.resegment_many([p for p, _ in parts], [v for _, v in parts], 2.0)
    for (p, v), (mixed, path) in zip(parts, together, strict=True):
        alone = decode.resegment(p, v, 2.0)
        assert np.array_equal(alone[0], mixed) and np.array_equal(alone[1], path)


def test_scores_of_empty_masks(spark):
    m = spark.createDataFrame([(False, False)], "a boolean, b boolean")
    (r,) = A.mask_scores(m, "a", "b").collect()
    assert (r.iou, r.precision, r.recall, r.f1) == (0.0, 1.0, 1.0, 1.0)


def test_histogram_edges(spark):
    d = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 1.0, 1.01, 0.5)], "x double")
    out = {r.bin: r.n for r in A.histogram(d, "x", 0.5, 2).collect()}
    assert out == {-1: 1, 0: 1, 1: 2, 2: 1}


def test_lenient_casts(spark):
    d = spark.createDataFrame([('{"k": %s}' % x,) for x in ("3.5", '"3"', "true", '"x"', "null")], "j string")
    out = d.select(N.lenient_double(F.col("j"), "$.k"), N.lenient_int(F.col("j"), "$.k")).collect()
    assert [tuple(r) for r in out] == [(3.5, None), (3.0, 3), (1.0, None), (None, None), (None, None)]


def test_marks_are_cleaned(spark):
    cases = {"どう? 。": "どう？", "終わり。 ？": "終わり？", "。。 テスト??": " テスト？", "  a": "  a", "　、b": "b", "えっ！ ！": "えっ！", "x.．?": "x.？", None: None, "": ""}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", T.clean_punctuation(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [r.b for r in rows]


def test_spaces_between_wide_letters(spark):
    cases = {"Ａ Ｂ": "Ａ Ｂ", "㐀  豈 あ x": "㐀豈あ x", "。 「": "。「"}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", T.drop_cjk_spaces(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [r.b for r in rows]


def test_timecode_past_a_day(spark):
    d = spark.createDataFrame([(90061.0009,), (-3.0,)], "x double").select(T.timecode(F.col("x")).alias("c"))
    assert [r.c for r in d.collect()] == ["25:01:01,000", "00:00:00,000"]


def test_interpolation_is_constant_beyond_the_ends(spark):
    known = spark.createDataFrame([(1, 1.0, 0, 10.0), (1, 3.0, 1, 30.0)], "session long, t double, idx long, v double")
    points = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "session long, i long, t double")
    assert [r.v for r in J.interpolated(points, known, "v").orderBy("i").collect()] == [10, 10, 20, 30, 30]


def test_short_segments_join_their_neighbours(spark):
    s = segments(spark, ("A", 0.0, 1.0), ("B", 1.0, 5.0), ("A", 5.0, 5.5))
    assert [(r.t0, r.t1, r.speaker) for r in folds.merged_short(s).orderBy("t0").collect()] == [(0.0, 5.5, "B")]


def test_outside_speech_is_infinite(spark):
    f = spark.createDataFrame([(1, i, i / 2, float(x)) for i, x in enumerate([0, 1, 1, 0])], "session long, i long, t double, vad double")
    out = [(r.since, r.until) for r in W.onset_distances(f, F.col("vad") > 0.5).orderBy("i").collect()]
    assert out[1:3] == [(0.0, 0.5), (0.5, 0.0)] and math.isinf(out[0][0])


def test_empty_tables(spark):
    s = spark.createDataFrame([], SEG)
    w = spark.createDataFrame([], "session long, word_idx long, word string, t0 double, t1 double")
    for out in (W.merged_timeline(s), W.merged_turns(s), folds.smoothed_segments(s), A.speaker_stats(s), J.assign_by_overlap(w, s), folds.merged_short(s)):
        assert out.count() == 0


def test_centres_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i % 90, [float(x) for x in rng.normal(size=3)]) for i in range(100)] + [(5, [1.0, 0.0, 0.0])] * 3, "id long, v array<double>")
    centres = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=3)]) for k in range(40)] + [(k, [0.5, 0.5, 0.5]) for k in (40, 41)], "label long, c array<double>")
    whole = similarity.assigned(vectors, centres, "label").collect()
    cut = similarity.assigned(vectors, centres, "label", few=4).collect()
    assert len(whole) == 103 and sorted(map(str, whole)) == sorted(map(str, cut))
