"""Decoders and clustering against plain, slow models written from their definitions."""

import itertools

import numpy as np
import pytest

from voxtable.config import AlignSettings, ClusterSettings
from voxtable.operators import clustering as C
from voxtable.operators import decode as D


def posteriors(rng, n, k):
    p = rng.random((n, k)) + 0.05
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(5))
def test_resegment_finds_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    p, vad = posteriors(rng, 6, 3), rng.random(6)
    _, path = D.resegment(p, vad, 1.0, stay_speech=0.8, stay_silence=0.9, least_run=0)

    def score(q):
        total = np.log(p[0, q[0]] / 3)
        for t in range(1, 6):
            stay = 0.9 if vad[t] < 0.35 else 0.8
            total += np.log(stay if q[t] == q[t - 1] else (1 - stay) / 2) + np.log(p[t, q[t]])
        return total

    best = max(itertools.product(range(3), repeat=6), key=score)
    assert score(path) == pytest.approx(score(best))


def frames_by_the_book(p, vad, t, cost, cp, lex, s):
    """The recursion term by term."""
    n, k = p.shape
    emit, top = np.log(np.clip(p, 1e-12, 1)), np.sort(p, axis=1)[:, ::-1]
    ent = -(p * np.log(p)).sum(axis=1) / np.log(k)
    dt = [t[1] - t[0], *np.diff(t)]
    score = np.zeros((n, k))
    run = np.full((n, k), dt[0])
    back = np.zeros((n, k), int)
    for j in range(k):
        score[0, j] = -(s.alpha * vad[0] + s.beta * emit[0, j] - s.gamma * cost[0])
    quiet, fired = 0.0, False
    for f in range(1, n):
        before = run[f - 1].copy()
        if vad[f] >= s.silence_vad:
            quiet, fired = 0.0, False
        else:
            quiet += dt[f]
        if quiet >= s.silence_reset_sec and not fired:
            before[:], fired = 0, True
        gap = top[f, 0] - top[f, 1]
        for to in range(k):
            options = []
            for frm in range(k):
                price = s.delta * lex[f] * max(max(0, 1 - s.cp_k * cp[f]), s.cp_floor * (1 - gap) ** 2)
                price *= 1 + s.run_scale * min(max(before[frm] - s.run_threshold, 0), s.run_cap)
                price *= s.uncertain_mult if ent[f] >= s.uncertain_entropy and gap <= s.uncertain_margin else 1
                price *= s.hysteresis_mult if before[frm] < s.hysteresis_sec else 1
                if to == p[f].argmax():
                    price *= max(0, 1 - s.post_k * min(1, max(0, (gap - s.post_margin) / (1 - s.post_margin))))
                options.append(score[f - 1, frm] - (price if frm != to else 0))
            b = int(np.argmax(options))
            back[f, to] = b
            score[f, to] = options[b] + s.alpha * vad[f] + s.beta * emit[f, to] - s.gamma * cost[f]
            run[f, to] = before[to] + dt[f] if b == to else dt[f]
    path = [int(score[-1].argmax())]
    for f in range(n - 1, 0, -1):
        path.append(int(back[f, path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("seed", range(8))
def test_frames_decode_as_defined(seed):
    rng = np.random.default_rng(seed)
    n, k = 60, 2 + seed % 3
    p = posteriors(rng, n, k) ** 3
    p = p / p.sum(axis=1, keepdims=True)
    vad, cost, cp, t = rng.random(n), rng.random(n), rng.random(n), np.arange(n) * 0.1
    lex = rng.choice([1.0, 0.5], n)
    s = AlignSettings(hysteresis_sec=0.5, delta=0.3)
    assert D.decode_frames(p, vad, t, cost, cp, lex, s=s).tolist() == frames_by_the_book(p, vad, t, cost, cp, lex, s)


def test_sessions_decode_together_as_alone(spark):
    from voxtable.plans import model_queries as M

    scored = M.scored(spark, "/root/testdata/sf0.001").persist()
    together = {(r.session, r.i): r.path for r in D.decoded(scored, M.ALIGN).collect()}
    for session, pdf in scored.toPandas().groupby("session"):
        pdf = pdf.sort_values("i")
        col = lambda c: pdf[c].to_numpy(float)  # noqa: B023, E731
        p = D.matrix(pdf["p"])
        alone = D.roll_back(D.decode_frames(p, col("vad"), col("t"), col("cost"), col("cp"), col("scale"), s=M.ALIGN), p, M.ALIGN.hz, M.ALIGN)
        assert alone.tolist() == [together[session, i] for i in pdf["i"]]


def test_one_speaker_needs_no_decision():
    p, x = np.ones((5, 1)), np.ones(5)
    assert D.decode_frames(p, x, np.arange(5.0), x).tolist() == [0] * 5
    assert D.resegment(p, x, 1.0)[1].tolist() == [0] * 5
    assert D.decode_words(np.zeros(5, int), p, np.arange(5.0), np.array([0.0]), np.array([2.0])).tolist() == [0] * 5


def test_short_runs_are_absorbed_from_the_left():
    emit = np.log(np.array([[0.9, 0.05, 0.05]] * 3 + [[0.1, 0.8, 0.1]] + [[0.1, 0.2, 0.7]] * 3))
    assert D.absorb_short_runs(np.array([0, 0, 0, 1, 2, 2, 2]), emit, 2).tolist() == [0, 0, 0, 0, 2, 2, 2]


@pytest.mark.parametrize("seed", range(40))
def test_absorbing_in_one_pass_is_absorbing_again_and_again(seed):
    rng = np.random.default_rng(seed)
    n, least = int(rng.integers(1, 40)), int(rng.integers(1, 6))
    path, emit = rng.integers(0, 3, n), np.log(rng.random((n, 3)))
    slow = path.copy()
    while True:
        edges = [0, *(np.flatnonzero(slow[1:] != slow[:-1]) + 1), n]
        short = [k for k in range(len(edges) - 1) if edges[k + 1] - edges[k] < least]
        if least <= 1 or len(edges) <= 2 or not short:
            break
        a, b = edges[short[0]], edges[short[0] + 1]
        options = ([slow[a - 1]] if a else []) + ([slow[b]] if b < n else [])
        slow[a:b] = max(options, key=lambda x: emit[a:b, x].mean())
    assert D.absorb_short_runs(path, emit, least).tolist() == slow.tolist()


def test_roll_back_stops_at_the_run():
    p = np.array([[0.1, 0.9], [0.8, 0.2], [0.4, 0.6], [0.7, 0.3], [0.1, 0.9], [0.1, 0.9]])
    s = AlignSettings(rollback_sec=9, rollback_run_sec=1)
    assert D.roll_back(np.array([0, 0, 0, 0, 1, 1]), p, 1.0, s).tolist() == [1, 1, 1, 1, 1, 1]
    assert D.roll_back(np.array([1, 0, 0, 0, 1, 1]), p, 1.0, s).tolist() == [1, 0, 1, 1, 1, 1]


def test_segments_split_at_changes_and_length():
    t = np.arange(80.0)
    path = np.array([0] * 10 + [1] * 70)
    out = D.to_segments(path, np.ones(80), t, np.array([0.2, 0.8]))
    assert out == [(0.0, 10.0, 0), (10.0, 40.0, 1), (40.0, 70.0, 1), (70.0, 79.0, 1)]
    assert D.to_segments(np.zeros(25, int), np.ones(25), np.arange(25.0), np.array([1.0])) == [(0.0, 20.0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_alignment_score_is_the_best(seed):
    rng = np.random.default_rng(seed)
    a, b = ("".join(rng.choice(list("abc"), n)) for n in (6, 5))
    from functools import cache

    @cache
    def best(i, j):
        if not i or not j:
            return -(i + j)
        return max(best(i - 1, j - 1) + (2 if a[i - 1] == b[j - 1] else -1), best(i - 1, j) - 1, best(i, j - 1) - 1)

    pairs = D.align_tokens(list(a), list(b))
    got = sum(-1 if None in x else (2 if a[x[0]] == b[x[1]] else -1) for x in pairs)
    assert got == best(len(a), len(b))
    assert [i for i, _ in pairs if i is not None] == list(range(len(a)))


def test_speaker_mapping():
    assert D.best_speaker_mapping({("r1", "a"): 5, ("r2", "a"): 9, ("r2", "b"): 8}) == ({"a": "r1", "b": "r2"}, 13)
    assert D.best_speaker_mapping({("r1", "a"): 5, ("r1", "b"): 2}) == ({"a": "r1", "b": "r1"}, 7)


def test_clusters_of_separate_clouds():
    rng = np.random.default_rng(0)
    centres = C.unit(np.eye(3, 16))
    true = rng.integers(0, 3, 90)
    x = C.unit(centres[true] + 0.05 * rng.standard_normal((90, 16)))
    _, labels = C.cluster(x, ClusterSettings(target_speakers=3, em_schedule=(0.3, 0.1)))
    assert len({(a, b) for a, b in zip(true, labels, strict=True)}) == 3


def test_similar_clusters_merge_down_to_the_least_number():
    x = C.unit(np.ones((20, 4)) + 0.001 * np.random.default_rng(1).standard_normal((20, 4)))
    centres, labels = C.cluster(x, ClusterSettings(min_speakers=1, max_speakers=4))
    assert len(centres) == 1 and set(labels) == {0}


def test_posteriors_of_few_chunks():
    centres, grid = np.eye(2), np.arange(4.0)
    none = C.posteriors(np.eye(2), np.array([0.0, 1]), np.array([False, False]), centres, grid)
    assert np.allclose(none, 0.5)
    one = C.posteriors(np.eye(2), np.array([0.0, 1]), np.array([True, False]), centres, grid)
    assert (one[:, 0] > 0.9).all() and np.allclose(one.sum(axis=1), 1)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        AlignSettings(hz=0)
    assert ClusterSettings(target_speakers=3).normalised().min_speakers == 3


def test_local_refinement_keeps_the_ends_of_its_window():
    p = np.array([[0.9, 0.1], [0.1, 0.9], [0.1, 0.9], [0.9, 0.1], [0.9, 0.1]])
    x = np.ones(5)
    s = AlignSettings(delta=0.1)
    assert D.refine_locally(np.zeros(5, int), p, x, x, 0, 3, (0, 0), s=s).tolist() == [0, 1, 1, 0, 0]
    assert D.refine_locally(np.zeros(5, int), p, x, x, 1, 3, (0, 5), s=s).tolist() == [0] * 5


def test_words_vote_for_their_frames():
    p = np.array([[0.9, 0.1]] * 4 + [[0.2, 0.8]] * 4)
    out = D.decode_words(np.zeros(8, int), p, np.arange(8.0), np.array([0.0, 4.0]), np.array([3.0, 6.0]))
    assert out.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]


def test_embedders(spark):
    def good(chunks):
        return [c[:2] for c in chunks], [True]

    def bad(chunks):
        raise ValueError("too short")

    e = D.Embedders("good", good=good, bad=bad)
    df = spark.createDataFrame([([3.0, 4.0, 5.0],)], "x array<double>")
    a, b, c = df.select(e.column("good", "x", 3).alias("a"), e.column("bad", "x", 3).alias("b"), e.column("other", "x", 1).alias("c")).first()
    assert (a.v, a.valid) == ([0.6, 0.8, 0.0], True) and (b.v, b.valid) == ([0.0] * 3, False) and c.v == [1.0]
