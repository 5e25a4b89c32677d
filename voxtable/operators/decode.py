"""Dynamic programs over one session: frame, word and local decoding, resegmentation, token alignment.

Their recursions depend on the path so far, so each session is decoded in one task; sessions are spread over the cluster. The
functions on arrays are pure; per_session() lifts them to DataFrames.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import AlignSettings

SESSION = "session"


def per_session(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str | list[str] = "i", key: str = SESSION) -> DataFrame:
    """``run`` on each session's rows in order; it returns the columns of ``schema`` without the session."""
    names = [part.split()[0] for part in schema.split(", ")]

    def apply(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf.sort_values(order, kind="stable").reset_index(drop=True))
        out.insert(0, key, at[0])
        return out[[key, *names]]

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(apply, f"{key} {kind}, {schema}")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def traced(back: np.ndarray, last: int) -> np.ndarray:
    """The path that ends at ``last``, from each step's best predecessors."""
    path = np.empty(len(back), np.int64)
    path[-1] = last
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def normalised(p: np.ndarray, least: float = 1e-12) -> np.ndarray:
    p = np.clip(p, least, 1.0)
    return p / np.clip(p.sum(axis=1, keepdims=True), least, None)


def certainty(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(likeliest, margin, normalised entropy) of each row."""
    top = np.sort(p, axis=1)[:, ::-1]
    gap = top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0.0)
    entropy = -(p * np.log(np.clip(p, 1e-12, None))).sum(axis=1)
    return p.argmax(axis=1), gap, entropy / np.log(p.shape[1]) if p.shape[1] > 1 else np.zeros(len(p))


def resegment(p: np.ndarray, vad: np.ndarray | None, hz: float, **options) -> tuple[np.ndarray, np.ndarray]:
    """V1 for one session."""
    return resegment_many([p], [vad], hz, **options)[0]


def resegment_many(posteriors: list[np.ndarray], vads: list[np.ndarray | None], hz: float, stay_speech: float = 0.998, stay_silence: float = 0.9995,
                   speech: float = 0.35, hard: float = 0.2, least_run: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """V1: (posterior mixed with the decoded path, path) of a Viterbi search with sticky speakers, for sessions of equally
    many speakers at once: a step takes one frame of every session that still goes on."""
    k = posteriors[0].shape[1]
    order = sorted((m for m, p in enumerate(posteriors) if len(p)), key=lambda m: -len(posteriors[m]))
    out = [(p, np.empty(0, np.int64)) for p in posteriors]
    if not k or not order:
        return out
    sizes = np.array([len(posteriors[m]) for m in order])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    p = normalised(np.concatenate([posteriors[m] for m in order]), 1e-8)
    emit = np.log(p)

    def moves(stay: float) -> np.ndarray:
        if k == 1:
            return np.zeros((1, 1))
        table = np.full((k, k), np.log(max((1 - stay) / (k - 1), 1e-8)))
        np.fill_diagonal(table, np.log(max(stay, 1e-8)))
        return table

    by_kind = np.stack((moves(stay_speech), moves(stay_silence)))
    known = [vads[m] is not None and len(vads[m]) == n for m, n in zip(order, sizes, strict=True)]
    quiet = np.concatenate([(vads[m] < speech).astype(int) if ok else np.zeros(n, int) for m, n, ok in zip(order, sizes, known, strict=True)])
    score, back = emit[first] - np.log(k), np.zeros((len(p), k), np.int64)
    going = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # sessions longer than t come first
    for t in range(1, int(sizes[0])):
        n = int(going[t])
        at = first[:n] + t
        reach = score[:n, :, None] + by_kind[quiet[at]]
        back[at] = reach.argmax(axis=1)
        score[:n] = reach.max(axis=1) + emit[at]
    for m, low, n, last in zip(order, first, sizes, score.argmax(axis=1), strict=True):
        part = slice(low, low + n)
        path = absorb_short_runs(traced(back[part], int(last)), emit[part], int(round(least_run * hz)))
        mixed = (1 - hard) * p[part] + hard * np.eye(k)[path]
        out[m] = mixed / mixed.sum(axis=1, keepdims=True), path
    return out


def run_bounds(path: np.ndarray) -> np.ndarray:
    """Starts of the runs, and the length at the end."""
    return np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))


def absorb_short_runs(path: np.ndarray, emit: np.ndarray, least: int) -> np.ndarray:
    """While there is a run under ``least`` frames, the leftmost goes to the neighbour with the higher mean emission over
    it, the left one of equals. One pass: what lies left of the leftmost short run is long and stays so."""
    if least <= 1 or len(path) < 2:
        return path.copy()
    bounds = run_bounds(path).tolist()
    ahead = deque([a, b, int(path[a])] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    settled: list[list[int]] = []
    while ahead:
        run = ahead.popleft()
        if settled and settled[-1][2] == run[2]:
            run[0] = settled.pop()[0]
        a, b, _ = run
        if b - a >= least or not (settled or ahead):
            settled.append(run)
            continue
        left, right = (float(emit[a:b, r[2]].mean()) if r else None for r in (settled and settled[-1], ahead and ahead[0]))
        if right is None or (left is not None and left >= right):
            settled[-1][1] = b
        else:
            ahead[0][0] = a
    return np.concatenate([np.full(b - a, x) for a, b, x in settled])


def silence_resets(vad: np.ndarray, step: np.ndarray, below: float, least: float) -> np.ndarray:
    """Frames at which a silence has first lasted ``least`` seconds, one a silence."""
    out, quiet, fired = np.zeros(len(vad), bool), 0.0, False
    for f, (v, dt) in enumerate(zip(vad.tolist(), step.tolist(), strict=True)):
        if v >= below:
            quiet, fired = 0.0, False
        elif f:
            quiet += dt
        if f and quiet >= least and not fired:
            out[f] = fired = True
    return out


def frame_terms(p: np.ndarray, vad: np.ndarray, t: np.ndarray, cost: np.ndarray, cp: np.ndarray | None, lexical: np.ndarray | None,
                beta: np.ndarray | None, ten: np.ndarray | None, s: AlignSettings) -> dict[str, np.ndarray]:
    """What the frame decoder needs of a session and what does not depend on the path."""
    n, k = p.shape
    emit = np.log(np.clip(p, 1e-12, 1.0)) if s.log_emissions else p
    beta = np.full(n, s.beta) if beta is None else beta
    step = np.diff(t, prepend=t[0]) if n > 1 else np.array([0.02])
    if n > 1:
        step[0] = step[1]
    best, gap, entropy = certainty(normalised(p))
    scale = np.full(n, s.delta)
    if ten is not None and s.ten_weight:
        scale *= np.clip(1 + s.ten_weight * ten, 0.2, 3.0)
    if lexical is not None:
        scale *= lexical
    if cp is not None:
        scale *= np.maximum(np.maximum(0, 1 - s.cp_k * cp), s.cp_floor * (1 - np.clip(gap, 0, 1)) ** 2 if s.cp_floor > 0 else 0)
    if s.uncertain_mult > 1:
        scale *= np.where((entropy >= s.uncertain_entropy) & (gap <= s.uncertain_margin), s.uncertain_mult, 1.0)
    into = np.ones((n, k))
    if s.post_k > 0:
        sure = np.clip((gap - s.post_margin) / max(1e-6, 1 - s.post_margin), 0, 1)
        into[np.arange(n), best] = np.maximum(0, 1 - s.post_k * sure)
    use_reset = s.silence_reset and s.silence_reset_sec > 0
    return {
        "local": s.alpha * vad[:, None] + beta[:, None] * emit - s.gamma * cost[:, None],
        "step": step,
        "scale": scale,
        "into": into,
        "reset": silence_resets(vad, step, s.silence_vad, s.silence_reset_sec) if use_reset else np.zeros(n, bool),
    }


def decode_many(terms: list[dict[str, np.ndarray]], s: AlignSettings) -> list[np.ndarray]:
    """The frame decoder on many sessions of as many speakers, one step of time for all of them at once."""
    order = sorted(range(len(terms)), key=lambda m: -len(terms[m]["step"]))
    sizes = np.array([len(terms[m]["step"]) for m in order])
    width, k = int(sizes[0]), terms[0]["local"].shape[1]

    def stacked(name: str) -> np.ndarray:
        """By time, then session; the longer sessions come first, so that those still running are a prefix."""
        first = terms[0][name]
        out = np.zeros((width, len(order), *first.shape[1:]), first.dtype)
        for n, m in enumerate(order):
            out[: sizes[n], n] = terms[m][name]
        return out

    local, step, scale, into, reset = map(stacked, ("local", "step", "scale", "into", "reset"))
    running = np.searchsorted(-sizes, -np.arange(width), "left")
    back = np.zeros((width, len(order), k), np.int8 if k < 128 else np.int32)
    score = -local[0] if s.negated_start else local[0].copy()
    lasted = np.repeat(step[0][:, None], k, axis=1)
    other, own = 1.0 - np.eye(k), np.arange(k)
    for f in range(1, width):
        n = running[f]
        before = np.where(reset[f, :n, None], 0.0, lasted[:n])
        leave = scale[f, :n, None] * (1 + s.run_scale * np.clip(before - s.run_threshold, 0, s.run_cap))
        if s.hysteresis_mult > 1:
            leave = leave * np.where(before < s.hysteresis_sec, s.hysteresis_mult, 1.0)
        reach = score[:n, :, None] - other * (leave[:, :, None] * into[f, :n, None, :])
        best = reach.argmax(axis=1)
        back[f, :n] = best
        score[:n] = np.take_along_axis(reach, best[:, None, :], axis=1)[:, 0] + local[f, :n]
        lasted[:n] = np.where(best == own, before, 0.0) + step[f, :n, None]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(terms)
    for n, m in enumerate(order):
        out[m] = traced(back[: sizes[n], n].astype(np.int64), int(score[n].argmax()))
    return out


def decode_frames(p: np.ndarray, vad: np.ndarray, t: np.ndarray, cost: np.ndarray, cp: np.ndarray | None = None, lexical: np.ndarray | None = None,
                  beta: np.ndarray | None = None, ten: np.ndarray | None = None, s: AlignSettings | None = None) -> np.ndarray:
    """V2: the speaker of each frame by the best score alpha vad + beta emission - gamma cost - switches.

    A switch away from a speaker costs more the longer its run has lasted, shortly after its last switch
    (hysteresis) and at uncertain frames, less at change points and sentence ends and into a speaker who is clearly likeliest. The
    run length follows the best predecessor, so the search is no plain Viterbi. The first frame's score enters negated
    unless ``negated_start`` is off.
    """
    s = s or AlignSettings()
    if not len(p):
        return np.empty(0, np.int64)
    return decode_many([frame_terms(p, vad, t, cost, cp, lexical, beta, ten, s)], s)[0]


def decode_words(path: np.ndarray, p: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray, lexical: np.ndarray | None = None,
                 beta: np.ndarray | None = None, s: AlignSettings | None = None, least_frames: int = 1) -> np.ndarray:
    """V3: one speaker a word by Viterbi over words, painted over the frame path in order of start."""
    s = s or AlignSettings()
    n, k = p.shape
    real = end > start
    if not n or k <= 1 or not real.any():
        return path
    start, end = start[real], end[real]
    first = np.clip(np.searchsorted(t, start, "left"), 0, n - 1)
    stop = np.maximum(first + 1, np.minimum(np.searchsorted(t, end, "right"), n))
    long = stop - first >= least_frames
    order = np.argsort(first[long], kind="stable")
    start, end, first, stop = (x[long][order] for x in (start, end, first, stop))
    if not len(first):
        return path
    beta = np.full(n, s.beta) if beta is None else beta
    logs = np.vstack((np.zeros(k), np.cumsum(np.log(np.clip(normalised(p, 1e-8), 1e-6, 1.0)), axis=0)))
    weights = np.concatenate(([0.0], np.cumsum(beta)))
    width = (stop - first)[:, None]
    emit = (logs[stop] - logs[first]) / width * ((weights[stop] - weights[first])[:, None] / width)
    price = np.full(len(first), s.delta * s.word_switch_scale)
    if lexical is not None:
        price *= lexical[first]
    if s.word_gap_sec > 0:
        price[1:] *= np.where(start[1:] - end[:-1] >= s.word_gap_sec, s.word_gap_scale, 1.0)
    score, back = emit[0], np.zeros((len(first), k), np.int64)
    for w in range(1, len(first)):
        reach = score[:, None] - np.where(np.eye(k, dtype=bool), 0.0, max(price[w], 0.0))
        back[w] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emit[w]
    out = path.copy()
    for a, b, speaker in zip(first, stop, traced(back, int(score.argmax())), strict=True):
        out[a:b] = speaker
    return out


def refine_locally(path: np.ndarray, p: np.ndarray, vad: np.ndarray, cost: np.ndarray, first: int, last: int, ends: tuple[int, int],
                   lexical: np.ndarray | None = None, scale: float = 1.0, s: AlignSettings | None = None) -> np.ndarray:
    """V4: the path anew within [first, last] between two given speakers, with a constant price of switching."""
    s = s or AlignSettings()
    n, k = p.shape
    first, last = max(0, min(first, n - 1)), max(0, min(last, n - 1))
    if last < first or not all(0 <= e < k for e in ends):
        return path
    w = slice(first, last + 1)
    emit = np.log(np.clip(p[w], 1e-12, 1.0)) if s.log_emissions else p[w]
    local = s.alpha * vad[w][:, None] + s.beta * emit - s.gamma * cost[w][:, None]
    price = s.delta * scale * (np.ones(last + 1 - first) if lexical is None else lexical[w])
    score, back = np.full(k, -1e30), np.zeros((last + 1 - first, k), np.int64)
    score[ends[0]] = -local[0, ends[0]]
    for f in range(1, len(local)):
        reach = score[:, None] - np.where(np.eye(k, dtype=bool), 0.0, price[f])
        back[f] = reach.argmax(axis=0)
        score = reach.max(axis=0) + local[f]
    out = path.copy()
    out[w] = traced(back, ends[1])
    return out


def roll_back(path: np.ndarray, p: np.ndarray, hz: float, s: AlignSettings | None = None) -> np.ndarray:
    """Where a long enough run of B follows A, it begins at the earliest frame of A within reach at which B is likelier
    by more than the margin."""
    s = s or AlignSettings()
    reach, least = (max(1, int(x * hz + 0.5)) for x in (s.rollback_sec, s.rollback_run_sec))
    path = path.copy()
    t = 1
    while t < len(path):
        a, b = path[t - 1], path[t]
        if a == b:
            t += 1
            continue
        after = np.flatnonzero(path[t:] != b)
        length = int(after[0]) if len(after) else len(path) - t
        if length >= least:
            low = max(0, t - reach)
            others = np.flatnonzero(path[low:t] != a)
            low = low + int(others[-1]) + 1 if len(others) else low
            better = np.flatnonzero(p[low:t, b] - p[low:t, a] > s.rollback_margin)
            if len(better):
                path[low + int(better[0]) : t] = b
        t += length
    return path


def to_segments(path: np.ndarray, vad: np.ndarray, t: np.ndarray, mean: np.ndarray, quiet: float = 0.3, least_quiet: float = 1.0,
                longest: float = 30.0, split_after: float = 5.0, block: float = 20.0) -> list[tuple[float, float, int]]:
    """(start, end, speaker): a new segment at each change, within long silences once five seconds have passed, and after
    thirty. A path that gives one segment at most is cut into blocks of twenty seconds with their median label."""
    n = len(path)
    if not n:
        return []
    bounds = run_bounds((vad < quiet).astype(int))
    silent = np.zeros(n, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b < n and vad[a] < quiet and t[b] - t[a] >= least_quiet:
            silent[a : b + 1] = True
    out, begun, speaker = [], t[0], path[0]
    for f in range(1, n):
        lasted = t[f] - begun
        if path[f] != speaker or (silent[f] and lasted > split_after) or lasted >= longest:
            out.append((float(begun), float(t[f]), int(speaker)))
            begun, speaker = t[f], path[f]
    out.append((float(begun), float(t[-1]), int(speaker)))
    if len(out) > 1:
        return out
    starts = t[0] + block * np.arange(max(1, int((t[-1] - t[0]) / block)))
    ends = np.minimum(t[-1], starts + block)
    spans = zip(starts, ends, np.searchsorted(t, starts), np.searchsorted(t, ends), strict=True)
    return [(float(a), float(b), int(np.median(path[i:j])) if j > i else int(mean.argmax())) for a, b, i, j in spans]


def align_tokens(a: list[str], b: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> list[tuple[int | None, int | None]]:
    """Index pairs of a global alignment; of equal scores the diagonal goes before a's gap, that before b's."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int64)
    table[:, 0], table[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    other = np.array(b, object)
    for i in range(1, n + 1):
        diagonal = table[i - 1, :-1] + (np.where(other == a[i - 1], match, mismatch) if m else 0)
        up = table[i - 1, 1:] + gap
        reach = np.concatenate(([table[i, 0]], np.maximum(diagonal, up))) - gap * np.arange(m + 1)
        table[i] = np.maximum.accumulate(reach) + gap * np.arange(m + 1)
    out, i, j = [], n, m
    while i or j:
        same = i and j and table[i, j] == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)
        if same:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i, j] == table[i - 1, j] + gap:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row, all different, with the greatest sum; rows are no more than columns. Shortest augmenting
    paths with potentials, cubic."""
    n, m = gain.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j, least, way, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            reduced = -gain[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            after = int(free.argmin())
            step = free[after]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = after
            if not owner[j]:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    return [int(np.flatnonzero(owner[1:] == i)[0]) for i in range(1, n + 1)]


def best_speaker_mapping(counts: dict[tuple[str, str], int]) -> tuple[dict[str, str], int]:
    """The mapping of hypothesis speakers to reference speakers with the most equal-word tokens, one to one if there are
    no more of the former, else each to its best; of equal mappings the first in order. counts[(reference, hypothesis)]."""
    refs, hyps = sorted({r for r, _ in counts}), sorted({h for _, h in counts})
    best: dict[str, str] = {}
    if len(hyps) <= len(refs):
        gain = np.array([[counts.get((r, h), 0) for r in refs] for h in hyps], float).reshape(len(hyps), len(refs))
        total = lambda g: sum(g[i, j] for i, j in enumerate(assignment(g)))
        most, left = total(gain), list(range(len(refs)))
        for i, h in enumerate(hyps):
            for j in left:  # the first reference that still reaches the most
                others = [x for x in left if x != j]
                rest = gain[i + 1 :][:, others]
                if abs(gain[i, j] + (total(rest) if len(rest) else 0) - most) < 1e-9:
                    break
            best[h], left, most = refs[j], others, most - gain[i, j]
    else:  # without the one-to-one rule each speaker is mapped on its own
        best = {h: max(refs, key=lambda r: counts.get((r, h), 0)) for h in hyps}
    return best, sum(counts.get((r, h), 0) for h, r in best.items())


def resegmented(frames: DataFrame, hz: float) -> DataFrame:
    """frames (session, i, vad, p) -> session, i, path, p of V1."""

    def run(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        speakers = [matrix(pdf["p"]) for pdf in parts]
        out: list[pd.DataFrame] = [pd.DataFrame()] * len(parts)
        for k in {p.shape[1] for p in speakers}:
            same = [m for m, p in enumerate(speakers) if p.shape[1] == k]
            made = resegment_many([speakers[m] for m in same], [parts[m]["vad"].to_numpy(float) for m in same], hz)
            for m, (mixed, path) in zip(same, made, strict=True):
                out[m] = pd.DataFrame({"i": parts[m]["i"], "path": path.astype("int32"), "p": list(mixed)})
        return out

    return by_batches(frames.select(SESSION, "i", "vad", "p"), run, "i long, path int, p array<double>")


def by_batches(df: DataFrame, run: Callable[[list[pd.DataFrame]], list[pd.DataFrame]], schema: str, order: str = "i", rows: int = 100_000) -> DataFrame:
    """As per_session(), for functions that take many whole sessions at once: about ``rows`` rows, or one session."""
    names = [SESSION, *(part.split()[0] for part in schema.split(", "))]

    def apply(frames):
        held: pd.DataFrame | None = None  # whole sessions but for the last, which may go on

        def done(whole: pd.DataFrame) -> pd.DataFrame:
            parts = [g.reset_index(drop=True) for _, g in whole.groupby(SESSION, sort=False, dropna=False)]
            made = run(parts)
            for part, out in zip(parts, made, strict=True):
                out.insert(0, SESSION, part[SESSION].iloc[0])
            return pd.concat(made)[names]

        for frame in frames:
            held = frame if held is None else pd.concat((held, frame), ignore_index=True)
            if len(held) >= rows:
                last = held[SESSION].iloc[-1]
                whole = held[held[SESSION] != last]
                if len(whole):
                    yield done(whole)
                    held = held[held[SESSION] == last]
        if held is not None and len(held):
            yield done(held)

    kind = df.schema[SESSION].dataType.simpleString()
    return df.repartition(SESSION).sortWithinPartitions(SESSION, order).mapInPandas(apply, f"{SESSION} {kind}, {schema}")


def decoded(frames: DataFrame, s: AlignSettings | None = None) -> DataFrame:
    """frames (session, i, t, vad, p, cost, cp, scale) -> session, i, t, path of V2 and W19."""
    s = s or AlignSettings()

    def run(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        terms, speakers = [], []
        for pdf in parts:
            col = lambda c: pdf[c].to_numpy(float)  # noqa: B023, E731
            p = matrix(pdf["p"])
            speakers.append(p)
            terms.append(frame_terms(p, col("vad"), col("t"), col("cost"), col("cp"), col("scale"), None, None, s))
        paths: list[np.ndarray] = [np.empty(0)] * len(parts)
        for k in {p.shape[1] for p in speakers}:
            same = [m for m, p in enumerate(speakers) if p.shape[1] == k]
            for m, path in zip(same, decode_many([terms[m] for m in same], s), strict=True):
                paths[m] = roll_back(path, speakers[m], s.hz, s)
        return [pd.DataFrame({"i": x["i"], "t": x["t"], "path": y.astype("int32")}) for x, y in zip(parts, paths, strict=True)]

    return by_batches(frames.select(SESSION, "i", "t", "vad", "p", "cost", "cp", "scale"), run, "i long, t double, path int")


def segmented(frames: DataFrame) -> DataFrame:
    """frames (session, i, t, vad, p, path) -> session, seg_idx, t0, t1, k of W18."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = matrix(pdf["p"])
        found = to_segments(pdf["path"].to_numpy(int), pdf["vad"].to_numpy(float), pdf["t"].to_numpy(float), p.mean(axis=0))
        return pd.DataFrame([(n, *x) for n, x in enumerate(found)], columns=["seg_idx", "t0", "t1", "k"])

    return per_session(frames.select(SESSION, "i", "t", "vad", "p", "path"), run, "seg_idx long, t0 double, t1 double, k int")


def with_word_path(frames: DataFrame, words: DataFrame, s: AlignSettings | None = None) -> DataFrame:
    """frames (session, i, t, p, path) and words (session, t0, t1) -> session, i, path of V3, by cogrouping."""
    s = s or AlignSettings()
    kind = frames.schema[SESSION].dataType.simpleString()

    def run(at: tuple, f: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        f, w = f.sort_values("i"), w.sort_values("word_idx")
        if not len(f):
            return pd.DataFrame({SESSION: [], "i": [], "path": []})
        path = decode_words(f["path"].to_numpy(int), matrix(f["p"]), f["t"].to_numpy(float), w["t0"].to_numpy(float), w["t1"].to_numpy(float), s=s)
        return pd.DataFrame({SESSION: at[0], "i": f["i"].to_numpy(), "path": path.astype("int32")})

    left = frames.select(SESSION, "i", "t", "p", "path").groupBy(SESSION)
    return left.cogroup(words.select(SESSION, "word_idx", "t0", "t1").groupBy(SESSION)).applyInPandas(run, f"{SESSION} {kind}, i long, path int")


def aligned(tokens: DataFrame) -> DataFrame:
    """Tokens (doc, side 'ref' or 'hyp', pos, word, speaker) -> doc, n, ref_word, hyp_word, ref_speaker, hyp_speaker."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ref, hyp = (pdf[pdf["side"] == x].sort_values("pos") for x in ("ref", "hyp"))
        pairs = align_tokens(ref["word"].tolist(), hyp["word"].tolist())
        pick = lambda d, c, i: None if i is None else d[c].iloc[i]
        rows = [(n, pick(ref, "word", i), pick(hyp, "word", j), pick(ref, "speaker", i), pick(hyp, "speaker", j)) for n, (i, j) in enumerate(pairs)]
        return pd.DataFrame(rows, columns=["n", "ref_word", "hyp_word", "ref_speaker", "hyp_speaker"])

    schema = "n long, ref_word string, hyp_word string, ref_speaker string, hyp_speaker string"
    return per_session(tokens, run, schema, "pos", "doc")


def refined(frames: DataFrame, candidates: DataFrame, s: AlignSettings | None = None, scale: float = 1.0) -> DataFrame:
    """V5: frames (session, i, t, vad, p, q, cost, path), q being local posteriors or null, with the path anew within each
    candidate (session, n, a, b), one after the other; the speakers at the window's ends stay."""
    s = s or AlignSettings()
    kind = frames.schema[SESSION].dataType.simpleString()

    def run(at: tuple, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({SESSION: [], "i": [], "path": []})
        f = f.sort_values("i")
        p = matrix(f["p"])
        local = p.copy()
        for n, q in enumerate(f["q"]):
            if q is not None:
                local[n] = q
        t, vad, cost, path = f["t"].to_numpy(float), f["vad"].to_numpy(float), f["cost"].to_numpy(float), f["path"].to_numpy(int)
        for a, b in c.sort_values("n")[["a", "b"]].itertuples(index=False):
            first, last = int(np.searchsorted(t, a, "left")), int(np.searchsorted(t, b, "right")) - 1
            if 0 <= first <= last:
                path = refine_locally(path, local, vad, cost, first, last, (int(path[first]), int(path[last])), scale=scale, s=s)
        return pd.DataFrame({SESSION: at[0], "i": f["i"].to_numpy(), "path": path.astype("int32")})

    left = frames.select(SESSION, "i", "t", "vad", "p", "q", "cost", "path").groupBy(SESSION)
    return left.cogroup(candidates.select(SESSION, "n", "a", "b").groupBy(SESSION)).applyInPandas(run, f"{SESSION} {kind}, i long, path int")


def speaker_scores(pairs: DataFrame) -> DataFrame:
    """token_accuracy() counts (doc, ref_speaker, hyp_speaker, n) -> doc, hyp_speaker, ref_speaker, right: the best mapping."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {(r, h): int(n) for r, h, n in zip(pdf["ref_speaker"], pdf["hyp_speaker"], pdf["n"], strict=True)}
        mapping, right = best_speaker_mapping(counts)
        return pd.DataFrame([(h, r, right) for h, r in sorted(mapping.items())], columns=["hyp_speaker", "mapped_to", "right"])

    return per_session(pairs, run, "hyp_speaker string, mapped_to string, right long", "hyp_speaker", "doc")


class Embedders:
    """Embedding functions by name, each from a list of sample arrays to (vectors, valid); an unknown name gets the default."""

    def __init__(self, default: str, **known: Callable):
        self.default, self.known = default, known

    def get(self, name: str) -> Callable:
        return self.known.get(name, self.known[self.default])

    def column(self, name: str, samples: str, size: int):
        """A column of structs (v, valid) for a column of sample arrays; vectors are cut or filled to ``size`` and normalised, a
        chunk that fails is not valid."""
        from pyspark.sql import functions as F

        embed = self.get(name)

        def run(column: pd.Series) -> pd.DataFrame:
            rows = []
            for x in column:
                try:
                    v, ok = embed([np.asarray(x, float)])
                    v = np.pad(np.asarray(v[0], float)[:size], (0, max(0, size - len(v[0]))))
                    rows.append(((v / max(np.linalg.norm(v), 1e-8)).tolist(), bool(ok[0])))
                except (ValueError, ArithmeticError, IndexError):
                    rows.append(([0.0] * size, False))
            return pd.DataFrame(rows, columns=["v", "valid"])

        run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(run, "v array<double>, valid boolean")(samples)
