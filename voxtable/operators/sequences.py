"""Runs, islands, zones, smoothing and peaks along a session's time.

All windows of one operator share one partitioning and order, so that Spark sorts each session once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import by_merge, touching

SESSION = "session"


def by(*order) -> Window:
    return Window.partitionBy(SESSION).orderBy(*order)


def so_far(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def run_ids(df: DataFrame, label: str, *order) -> DataFrame:
    """df with ``run``: the number, from 1, of the stretch of equal labels that a row is in."""
    w = by(*order)
    new = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("run", F.sum(new.cast("int")).over(so_far(w)))


def runs(frames: DataFrame, label: str) -> DataFrame:
    """(session, run, label, first, last, n) of the runs of frames (session, i, label)."""
    return (
        run_ids(frames, label, "i").groupBy(SESSION, "run")
        .agg(F.first(label).alias(label), F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))
    )


def switches(frames: DataFrame, label: str) -> DataFrame:
    """(session, i, t, old, new) at the first frame of each new label."""
    old = F.lag(label).over(by("i"))
    return frames.withColumn("old", old).where(f"old <> {label}").select(SESSION, "i", "t", "old", F.col(label).alias("new"))


def above(points: DataFrame, value: str, threshold: float, least: float = 0.0, strict: bool = False) -> DataFrame:
    """(session, run, t0, t1) of stretches with value >= threshold (> if strict); a stretch ends at the next
    point's time, the last one at the last time; shorter ones than ``least`` go."""
    c = F.col(value)
    hit = (c > threshold) if strict else (c >= threshold)
    marked = points.withColumn("_hit", hit).withColumn("_next", F.coalesce(F.lead("t").over(by("t", "idx")), F.col("t")))
    spans = run_ids(marked, "_hit", "t", "idx").where("_hit").groupBy(SESSION, "run").agg(F.min("t").alias("t0"), F.max("_next").alias("t1"))
    return spans.where(F.col("t1") - F.col("t0") >= least)


def above_index(points: DataFrame, value: str, threshold: float) -> DataFrame:
    """(session, first, stop) of stretches with value > threshold, by index, stop exclusive."""
    marked = points.withColumn("_hit", F.col(value) > threshold)
    return run_ids(marked, "_hit", "idx").where("_hit").groupBy(SESSION, "run").agg(
        F.min("idx").alias("first"), (F.max("idx") + 1).alias("stop")
    ).drop("run")


def error_intervals(grid: DataFrame, gold: str, predicted: str, wanted: tuple[str, str], dt: float, least: float = 0.5) -> DataFrame:
    """(session, t0, t1) where gold is wanted[0] and predicted wanted[1]; up to the next frame, the last frame
    lasting ``dt``; of at least ``least``."""
    hit = (F.col(gold) == wanted[0]) & (F.col(predicted) == wanted[1])
    marked = grid.withColumn("_hit", hit).withColumn("_next", F.coalesce(F.lead("t").over(by("i")), F.col("t") + dt))
    spans = run_ids(marked, "_hit", "i").where("_hit").groupBy(SESSION, "run").agg(F.min("t").alias("t0"), F.max("_next").alias("t1"))
    return spans.where(F.col("t1") - F.col("t0") >= least).drop("run")


def merged(intervals: DataFrame, gap: float = 0.0) -> DataFrame:
    """Overlapping or touching intervals (session, t0, t1) become one."""
    w = by("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("t0") > reach + gap)).cast("int")
    return (
        intervals.where("t1 > t0").withColumn("_new", new).withColumn("_island", F.sum("_new").over(so_far(w)))
        .groupBy(SESSION, "_island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("_island")
    )


def merged_timeline(segments: DataFrame, gap: float = 0.3) -> DataFrame:
    """Neighbours of one speaker with 0 <= gap <= ``gap`` become one segment; overlapping ones stay apart.
    For segments that do not contain one another, as timelines are."""
    w = by("t0", "seg_idx")
    space = F.col("t0") - F.lag("t1").over(w)
    joins = (F.col("speaker") == F.lag("speaker").over(w)) & (space >= 0) & (space <= gap)
    marked = segments.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return (
        marked.withColumn("run", F.sum("_new").over(so_far(w))).groupBy(SESSION, "run")
        .agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("speaker").alias("speaker"), F.count("*").alias("parts"))
    )


def merged_turns(segments: DataFrame, gap: float = 1.5, least: float = 1.5) -> DataFrame:
    """Neighbours of one speaker at most ``gap`` apart, overlaps included, become one; short results then go."""
    w = by("t0", "seg_idx")
    labelled = run_ids(segments, "speaker", "t0", "seg_idx").withColumnRenamed("run", "_turn")
    inner = Window.partitionBy(SESSION, "_turn").orderBy("t0", "seg_idx")
    reach = F.max("t1").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    marked = labelled.withColumn("_new", (reach.isNull() | (F.col("t0") - reach > gap)).cast("int"))
    out = marked.withColumn("run", F.sum("_new").over(so_far(w))).groupBy(SESSION, "run").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("speaker").alias("speaker")
    )
    return out.where(F.col("t1") - F.col("t0") >= least)


def smoothed_islands(frames: DataFrame, label: str, longest: float = 1.0) -> DataFrame:
    """Runs B between two runs of A whose last and first time lie at most ``longest`` apart become A; all
    conditions look at the original runs."""
    marked = run_ids(frames, label, "i")
    spans = marked.groupBy(SESSION, "run").agg(F.first(label).alias("_own"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    w = by("run")
    before, after = F.lag("_own").over(w), F.lead("_own").over(w)
    island = (before == after) & (F.col("_b") - F.col("_a") <= longest)
    fixed = spans.select(SESSION, "run", F.when(island, before).otherwise(F.col("_own")).alias("smoothed"))
    return marked.join(by_merge(fixed), [SESSION, "run"]).drop("run")


def onset_distances(frames: DataFrame, speech: Column) -> DataFrame:
    """``since`` the onset and ``until`` the offset of the speech run that a frame is in, in time steps summed
    over frames, 0 at the ends; infinite outside speech."""
    w = by("i")
    step = F.coalesce(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"), F.lit(0.02))
    marked = run_ids(frames.withColumn("_speech", speech).withColumn("_dt", step), "_speech", "i")
    inner = Window.partitionBy(SESSION, "run").orderBy("i")
    since = F.coalesce(F.sum("_dt").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    until = F.sum("_dt").over(inner.rowsBetween(0, Window.unboundedFollowing)) - F.last("_dt").over(inner.rowsBetween(0, Window.unboundedFollowing))
    far = F.lit(float("inf"))
    return marked.withColumns(
        {"since": F.when(F.col("_speech"), since).otherwise(far), "until": F.when(F.col("_speech"), until).otherwise(far)}
    ).drop("run", "_speech", "_dt")


def moving_average(frames: DataFrame, value: str, width: int, edges: str = "zero", out: str = "smooth") -> DataFrame:
    """Mean over ``width`` (odd) frames around each. edges "zero": what lies beyond counts as 0;
    "repeat": as the first or last value."""
    if width % 2 != 1:
        raise ValueError("width must be odd")
    r = width // 2
    w = by("i")
    sums = F.sum(value).over(w.rowsBetween(-r, r))
    if edges == "zero":
        return frames.withColumn(out, sums / width)
    whole = Window.partitionBy(SESSION)
    ranked = frames.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(whole))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lacking_before = F.greatest(F.lit(0), r + 1 - F.col("_n"))
    lacking_after = F.greatest(F.lit(0), F.col("_n") + r - F.col("_all"))
    return ranked.withColumn(out, (sums + lacking_before * first + lacking_after * last) / width).drop("_n", "_all")


def change_scores(frames: DataFrame, width: int = 25, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``cp``: cosine distance of neighbouring posteriors, averaged with zeros beyond the ends, scaled so that its
    ``low`` and ``high`` quantiles are 0 and 1; 0 where those are equal."""
    from ..functions.vectors import dot, norm

    w = by("i")
    p, q = F.col("p"), F.lag("p").over(w)
    apart = frames.withColumn("_prev", q).withColumn(
        "_d", F.when(F.col("_prev").isNull(), 0.0).otherwise(1 - dot(p, F.col("_prev")) / F.greatest(norm(p) * norm(F.col("_prev")), F.lit(1e-12)))
    )
    smooth = moving_average(apart, "_d", width, "zero", "_s")
    ends = smooth.groupBy(SESSION).agg(F.percentile("_s", F.lit(low)).alias("_lo"), F.percentile("_s", F.lit(high)).alias("_hi"))
    scaled = (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    flat = F.col("_hi") - F.col("_lo") <= 1e-9
    out = smooth.join(ends, SESSION).withColumn("cp", F.when(flat, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))))
    return out.drop("_prev", "_d", "_s", "_lo", "_hi")


def peaks(frames: DataFrame, value: str, least: float, most: int) -> DataFrame:
    """The ``most`` highest frames with value >= least, above the one before and not below the one after."""
    w = by("i")
    c = F.col(value)
    found = frames.withColumn("_b", F.lag(value).over(w)).withColumn("_a", F.lead(value).over(w))
    tops = found.where((c >= least) & (c > F.col("_b")) & (c >= F.col("_a"))).drop("_a", "_b")
    return tops.withColumn("rank", F.row_number().over(by(c.desc(), "i"))).where(F.col("rank") <= most)


def events_with_precedence(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Rows of ``first`` (session, i, kind) and those of ``second`` at other frames; the earliest ``most``."""
    both = first.unionByName(second.join(by_merge(first.select(SESSION, "i")), [SESSION, "i"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(by("i"))).where(F.col("rank") <= most)


def switch_zones(segments: DataFrame, window: float = 30.0, step: float = 10.0, majority: float = 0.8, density: float = 0.2, least: float = 25.0) -> DataFrame:
    """Windows (session, t0, t1, speaker) with one speaker for most of at least ``least`` seconds of speech and
    many switches; overlapping ones of a speaker are merged."""
    end = segments.groupBy(SESSION).agg(F.max("t1").alias("_end"))
    n = F.greatest(F.ceil(F.col("_end") / step), F.lit(1))
    windows = end.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).select(
        SESSION, (F.col("_k") * step).alias("a"), F.least(F.col("_k") * step + window, F.col("_end")).alias("b"), F.col("_k").alias("k")
    )
    firsts = F.greatest(F.floor((F.col("t0") - window) / step), F.lit(0))
    spread = segments.withColumn("k", F.explode(F.sequence(firsts, F.greatest(firsts, F.floor(F.col("t1") / step)))))
    shared = F.least("t1", "b") - F.greatest("t0", "a")
    hit = spread.join(windows, [SESSION, "k"]).withColumn("_d", shared).where("_d > 0")
    w = Window.partitionBy(SESSION, "k").orderBy("t0", "seg_idx")
    hit = hit.withColumn("_s", (F.col("speaker") != F.lag("speaker").over(w)).cast("int"))
    each = hit.groupBy(SESSION, "k", "a", "b", "speaker").agg(F.sum("_d").alias("_d"), F.sum(F.coalesce("_s", F.lit(0))).alias("_s"))
    zone = each.groupBy(SESSION, "k", "a", "b").agg(
        F.sum("_d").alias("total"), F.sum("_s").alias("switched"), F.max(F.struct(F.round("_d", 9).alias("d"), "speaker")).alias("top")
    )
    chosen = zone.where(
        (F.col("total") >= least) & (F.col("top.d") / F.col("total") >= majority) & (F.col("switched") / (F.col("b") - F.col("a")) >= density)
    ).select(SESSION, F.col("a").alias("t0"), F.col("b").alias("t1"), F.col("top.speaker").alias("speaker"))
    o = by("t0")
    apart = (F.col("speaker") == F.lag("speaker").over(o)) & (F.col("t0") <= F.lag("t1").over(o))
    return (
        chosen.withColumn("_new", (~F.coalesce(apart, F.lit(False))).cast("int")).withColumn("zone", F.sum("_new").over(so_far(o)))
        .groupBy(SESSION, "zone").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("speaker").alias("speaker"))
    )


def silences(frames: DataFrame, below: float = 0.3, least: float = 1.0) -> DataFrame:
    """(session, t0, t1) of runs with vad < ``below`` that speech ends, of at least ``least``; an open run at the end
    does not count."""
    marked = run_ids(frames.withColumn("_low", F.col("vad") < below), "_low", "i")
    spans = marked.groupBy(SESSION, "run").agg(F.first("_low").alias("_low"), F.min("t").alias("t0"))
    closed = spans.withColumn("t1", F.lead("t0").over(by("run")))
    return closed.where(F.col("_low") & (F.col("t1") - F.col("t0") >= least)).select(SESSION, "t0", "t1")


def label_grid(segments: DataFrame, tail: DataFrame, hz: float) -> DataFrame:
    """(session, i, t) from the first start up to the last start plus the session's tail, exclusive."""
    span = segments.groupBy(SESSION).agg(F.min("t0").alias("_a"), F.max("t0").alias("_b")).join(tail, SESSION)
    n = F.ceil(F.round((F.col("_b") + F.col("tail") - F.col("_a")) * hz, 9))
    return span.where(n >= 1).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).select(
        SESSION, "i", (F.col("_a") + F.col("i") / hz).alias("t")
    )


def guarded_end(segments: DataFrame, durations: DataFrame, share: float = 0.9) -> DataFrame:
    """A timeline that ends before ``share`` of the duration becomes one segment of SPEAKER_00."""
    late = segments.groupBy(SESSION).agg(F.max("t1").alias("_end")).join(durations, SESSION)
    early = late.where(F.col("_end") < share * F.col("duration"))
    kept = segments.join(early, SESSION, "left_anti").select(SESSION, "t0", "t1", "speaker")
    whole = early.select(SESSION, F.lit(0.0).alias("t0"), F.col("duration").alias("t1"), F.lit("SPEAKER_00").alias("speaker"))
    return kept.unionByName(whole)


def stuck_candidates(switched: DataFrame, frames: DataFrame, lookback: float = 1.0, margin: float = 0.6) -> DataFrame:
    """For each switch (session, i, old, new) the frame of the look-back with the greatest margin that still has the
    old label though the new one is likeliest, and how long before the switch it lies."""
    at = frames.select(SESSION, F.col("i").alias("j"), F.col("t").alias("r0"), F.col("t").alias("r1"), "path", "top", "margin")
    spans = switched.select(SESSION, "i", "old", "new", (F.col("t") - lookback).alias("l0"), F.col("t").alias("l1"))
    joined = touching(spans, at, width=max(lookback, 1.0)).where("r0 < l1").withColumnsRenamed({"l1": "t", "r0": "tj"})
    fits = joined.where((F.col("path") == F.col("old")) & (F.col("top") == F.col("new")) & (F.col("margin") >= margin))
    best = fits.groupBy(SESSION, "i", "t").agg(F.max(F.struct("margin", (-F.col("j")).alias("back"), "tj")).alias("m"))
    return best.select(SESSION, "i", (-F.col("m.back")).alias("j"), F.col("m.margin").alias("margin"), (F.col("t") - F.col("m.tj")).alias("delay"))
