"""Operators whose steps see what earlier steps have changed: islands, short segments, reassignment, averages.

Where the fold is short it is a built-in aggregate over a session's ordered array; the others run on one session at
a time. None depends on the order of rows beyond the given columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import per_session
from .sequences import SESSION, by, merged_timeline, so_far


def smoothed_segments(segments: DataFrame, longest: float = 3.0, gap: float = 0.3) -> DataFrame:
    """A segment B of at most ``longest`` seconds between two of A becomes A, from left to right, so that later steps
    see earlier changes; then W6. Sessions in which nothing changes are not merged."""
    relabelled = _relabelled(segments, (F.col("t1") > F.col("t0")) & (F.col("t1") - F.col("t0") <= longest))
    touched = relabelled.groupBy(SESSION).agg(F.max((F.col("speaker") != F.col("_old")).cast("int")).alias("_any"))
    marked = relabelled.join(touched, SESSION)
    changed = merged_timeline(marked.where("_any = 1").drop("_any", "_old"), gap).select(SESSION, "t0", "t1", "speaker")
    return changed.unionByName(marked.where("_any = 0").select(SESSION, "t0", "t1", "speaker"))


def smoothed_by_confidence(segments: DataFrame, longest: float = 3.0, margin: float = 0.05, gap: float = 0.5) -> DataFrame:
    """As W7c, but only where the middle is less sure than both sides by more than ``margin`` (``confidence`` may be
    null); then neighbours of one speaker less than ``gap`` apart merge, the last end counting."""
    w = by("t0", "seg_idx")
    beside = segments.withColumns({"_cb": F.lag("confidence").over(w), "_ca": F.lead("confidence").over(w)})
    known = F.col("_cb").isNotNull() & F.col("_ca").isNotNull() & F.col("confidence").isNotNull()
    unsure = ~known | (F.col("confidence") + margin < F.least("_cb", "_ca"))
    fixed = _relabelled(beside, (F.col("t1") - F.col("t0") <= longest) & unsure)
    near = (F.col("speaker") == F.lag("speaker").over(w)) & (F.col("t0") - F.lag("t1").over(w) < gap)
    marked = fixed.withColumn("_new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(so_far(w)))
    return marked.groupBy(SESSION, "run").agg(F.min("t0").alias("t0"), F.max_by("t1", F.struct("t0", "seg_idx")).alias("t1"), F.first("speaker").alias("speaker"))


def _relabelled(segments: DataFrame, may_change) -> DataFrame:
    """Islands take their neighbours' speaker where ``may_change``; ``_old`` is the speaker before."""
    s = segments.withColumn("_may", F.coalesce(may_change, F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        who, may = pdf["speaker"].tolist(), pdf["_may"].tolist()
        for n in range(1, len(who) - 1):
            if may[n] and who[n - 1] == who[n + 1] != who[n] and None not in (who[n - 1], who[n]):
                who[n] = who[n - 1]
        return pd.DataFrame({"seg_idx": pdf["seg_idx"], "_x": who})

    new = per_session(s.select(SESSION, "seg_idx", "t0", "_may", "speaker"), run, "seg_idx long, _x string", ["t0", "seg_idx"])
    fixed = s.join(new, [SESSION, "seg_idx"])
    return fixed.withColumns({"_old": F.col("speaker"), "speaker": F.col("_x")}).drop("_x", "_may")


def ema(frames: DataFrame, value: str, alpha: float, out: str = "ema") -> DataFrame:
    """y = alpha x + (1 - alpha) y before, beginning with x."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"], out: pdf["x"].ewm(alpha=alpha, adjust=False).mean()})

    return per_session(frames.select(SESSION, "i", F.col(value).cast("double").alias("x")), run, f"i long, {out} double")


def merged_short(segments: DataFrame, least: float = 2.0, near: float = 0.5) -> DataFrame:
    """A segment of the same speaker that ends less than ``near`` after the one before extends it; one shorter than ``least``
    gives its time to the next, the last one to the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        held: list | None = None
        for t0, t1, speaker in zip(pdf["t0"], pdf["t1"], pdf["speaker"], strict=True):
            if held is None:
                held = [t0, t1, speaker]
            elif held[2] == speaker and t1 - held[1] < near:
                held[1] = t1
            else:
                if held[1] - held[0] < least:
                    t0 = min(held[0], t0)
                else:
                    out.append(held)
                held = [t0, t1, speaker]
        if out and held[1] - held[0] < least:
            out[-1][1] = held[1]
        else:
            out.append(held)
        return pd.DataFrame([(n, *x) for n, x in enumerate(out)], columns=["seg_idx", "t0", "t1", "speaker"])

    return per_session(segments.select(SESSION, "seg_idx", "t0", "t1", "speaker"), run, "seg_idx long, t0 double, t1 double, speaker string", "t0")


def reassigned(segments: DataFrame, kept: DataFrame) -> DataFrame:
    """Segments of speakers that are not in kept (session, speaker, rank) go to the kept neighbour with the smaller gap, the one
    before of equals, from left to right; without one to the kept speaker of rank 1."""
    names = kept.groupBy(SESSION).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "speaker"))), lambda x: x["speaker"]).alias("_keep"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t0, t1, who = pdf["t0"].tolist(), pdf["t1"].tolist(), pdf["speaker"].tolist()
        keep = list(pdf["_keep"].iloc[0]) if pdf["_keep"].iloc[0] is not None else []
        for n, speaker in enumerate(who):
            if speaker in keep or not keep:
                continue
            sides = [m for m in (n - 1, n + 1) if 0 <= m < len(who) and who[m] in keep]
            gaps = [max(0.0, max(t0[n] - t1[m], t0[m] - t1[n])) for m in sides]
            who[n] = who[sides[gaps.index(min(gaps))]] if sides else keep[0]
        return pd.DataFrame({"seg_idx": pdf["seg_idx"], "t0": t0, "t1": t1, "speaker": who})

    joined = segments.select(SESSION, "seg_idx", "t0", "t1", "speaker").join(names, SESSION, "left")
    return per_session(joined, run, "seg_idx long, t0 double, t1 double, speaker string", "t0")


def merged_candidates(candidates: DataFrame, gap: float = 0.5, widest: float = 2.0, most: int = 1000) -> DataFrame:
    """Candidates (session, centre, a, b, reason) in order of a: one that begins within ``gap`` of the current window joins it as
    long as both span at most ``widest``; the centre is the mean of the two. The earliest ``most`` stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for centre, a, b, reason in zip(pdf["centre"], pdf["a"], pdf["b"], pdf["reason"], strict=True):
            if out and a <= out[-1][2] + gap and max(b, out[-1][2]) - min(a, out[-1][1]) <= widest:
                c, x, y, r = out[-1]
                out[-1] = [(c + centre) / 2, min(a, x), max(b, y), f"{r}+{reason}"]
            else:
                out.append([centre, a, b, reason])
        return pd.DataFrame([(n, *x) for n, x in enumerate(out[:most])], columns=["n", "centre", "a", "b", "reason"])

    return per_session(candidates.select(SESSION, "centre", "a", "b", "reason"), run, "n long, centre double, a double, b double, reason string", "a")


def snapped(segments: DataFrame, words: DataFrame, reach: float = 0.5, marks: str = "？?。！!") -> DataFrame:
    """Each inner boundary moves to the latest end of a word within ``reach`` before it, of a punctuated word if there is one,
    unless a neighbour would vanish; the left neighbour's start is the one that the snap before has left."""
    from .intervals import touching

    b = segments.select(SESSION, "seg_idx", (F.col("t1") - reach).alias("l0"), F.col("t1").alias("l1"))
    ends = words.select(SESSION, F.col("t1").alias("r0"), F.col("t1").alias("r1"), F.col("word").rlike(f"[{marks}]$").alias("mark"))
    near = touching(b, ends).groupBy(SESSION, "seg_idx").agg(F.max("r0").alias("_e"), F.max(F.when(F.col("mark"), F.col("r0"))).alias("_m"))
    joined = segments.join(near.select(SESSION, "seg_idx", F.coalesce("_m", "_e").alias("to")), [SESSION, "seg_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t0, t1 = pdf["t0"].tolist(), pdf["t1"].tolist()
        for n, to in enumerate(pdf["to"].tolist()[:-1]):
            if to == to and to is not None and t0[n] + 1e-3 < to < t1[n + 1] - 1e-3:
                t1[n] = t0[n + 1] = to
        return pd.DataFrame({"seg_idx": pdf["seg_idx"], "t0": t0, "t1": t1, "speaker": pdf["speaker"]})

    return per_session(joined.select(SESSION, "seg_idx", "t0", "t1", "speaker", "to"), run, "seg_idx long, t0 double, t1 double, speaker string", "t0")
