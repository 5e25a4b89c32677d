"""Joins of intervals, points and frames within sessions.

Ranges are joined by equality of session and time bucket, so that Spark plans hash or merge joins and adaptive
execution can split hot sessions; each pair is found in exactly one bucket. On regular grids the
bucket is the frame itself. As-of and interpolating joins are one sort per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = "session"


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for joins by shuffle and sort. Spark's estimate of sizes leaves out what explode adds, so that it would broadcast frames by the million."""
    return df.hint("merge")


def buckets(t0: Column, t1: Column, width: float) -> Column:
    return F.sequence(F.floor(t0 / width), F.floor(t1 / width))


def touching(left: DataFrame, right: DataFrame, width: float = 30.0, how: str = "inner") -> DataFrame:
    """Pairs of left (session, l0, l1, ...) and right (session, r0, r1, ...) that share a point; closed
    ends, so that callers may narrow. Rows with an end before the start match nothing."""
    a = left.where("l1 >= l0").withColumn("_bucket", F.explode(buckets(F.col("l0"), F.col("l1"), width)))
    b = right.where("r1 >= r0").withColumn("_bucket", F.explode(buckets(F.col("r0"), F.col("r1"), width)))
    met = (F.col("l0") <= F.col("r1")) & (F.col("r0") <= F.col("l1"))
    once = F.col("_bucket") == F.greatest(F.floor(F.col("l0") / width), F.floor(F.col("r0") / width))
    return a.join(b, [SESSION, "_bucket"], how).where(met & once).drop("_bucket")


def assign_by_overlap(words: DataFrame, segments: DataFrame, least_share: float = 0.55) -> DataFrame:
    """Words with the speaker of the segment that they overlap most; of equal overlaps the earliest segment. Where
    that covers less than ``least_share`` of the word, the earliest overlapping segment around its middle wins."""
    a = words.select(SESSION, "word_idx", F.col("t0").alias("l0"), F.col("t1").alias("l1"))
    b = segments.select(SESSION, "seg_idx", "speaker", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    shared = F.least("l1", "r1") - F.greatest("l0", "r0")
    pairs = touching(a, b).withColumn("shared", shared).where("shared > 0")
    middle = (F.col("l0") + F.col("l1")) / 2
    best = pairs.groupBy(SESSION, "word_idx").agg(
        F.max(F.struct("shared", (-F.col("seg_idx")).alias("back"), "speaker")).alias("best"),
        F.min(F.when(middle.between(F.col("r0"), F.col("r1")), F.struct("seg_idx", "speaker"))).alias("mid"),
    )
    whole = words.join(best, [SESSION, "word_idx"], "left")
    weak = F.col("best.shared") / (F.col("t1") - F.col("t0")) < least_share
    chosen = F.when(weak & F.col("mid").isNotNull(), F.col("mid.speaker")).otherwise(F.col("best.speaker"))
    index = F.when(weak & F.col("mid").isNotNull(), F.col("mid.seg_idx")).otherwise(-F.col("best.back"))
    return whole.withColumn("assigned", chosen).withColumn("assigned_seg", index).drop("best", "mid")


def frames_within(spans: DataFrame, hz: float, closed: bool = True) -> DataFrame:
    """spans (session, t0, t1, ...) once for each frame i with t0 <= i / hz <= t1 (or < t1)."""
    first = F.greatest(F.ceil(F.col("t0") * hz), F.lit(0))
    last = F.floor(F.col("t1") * hz) if closed else F.ceil(F.col("t1") * hz) - 1
    some = spans.withColumn("_first", first).withColumn("_last", last).where("_last >= _first")
    return some.withColumn("i", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def chunk_means(chunks: DataFrame, frames: DataFrame, hz: float, value: str = "vad") -> DataFrame:
    """Chunks (session, chunk_idx, t0, t1) with the mean of ``value`` over frames in [t0, t1), 0 without any."""
    hit = frames_within(chunks, hz, closed=False).join(by_merge(frames.select(SESSION, "i", value)), [SESSION, "i"])
    mean = hit.groupBy(SESSION, "chunk_idx").agg(F.avg(value).alias("score"))
    return chunks.join(by_merge(mean), [SESSION, "chunk_idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def word_costs(words: DataFrame, frames: DataFrame, hz: float, default: float = 1.0) -> DataFrame:
    """1 - probability of the last word over each frame; 0.8 where the word has none; 1 outside words."""
    p = F.least(F.greatest(F.coalesce("prob", F.lit(0.8)), F.lit(0.0)), F.lit(1.0))
    hit = frames_within(words.withColumn("cost", 1 - p), hz)
    last = hit.groupBy(SESSION, "i").agg(F.max_by("cost", "word_idx").alias("cost"))
    return frames.select(SESSION, "i").join(last, [SESSION, "i"], "left").withColumn("cost", F.coalesce("cost", F.lit(default)))


def lexical_scales(words: DataFrame, frames: DataFrame, hz: float, question: float, full_stop: float, reach: float = 0.3) -> DataFrame:
    """The least scale of the sentence ends whose [end, end + reach] holds the frame, 1 elsewhere."""
    scale = F.when(F.col("word").rlike("[?？]$"), question).when(F.col("word").rlike("[。.]$"), full_stop)
    ends = words.select(SESSION, F.col("t1").alias("t0"), (F.col("t1") + reach).alias("t1"), scale.alias("scale"))
    least = frames_within(ends.where("scale < 1"), hz).groupBy(SESSION, "i").agg(F.min("scale").alias("scale"))
    return frames.select(SESSION, "i").join(least, [SESSION, "i"], "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def _beside(points: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """points (session, t, ...) with structs ``before`` (the last of known at or before t) and ``after``
    (the first after t, or at t)."""
    at = F.struct(*[c for c in points.columns if c != SESSION])
    row = F.struct(*[c for c in known.columns if c != SESSION])
    both = points.select(SESSION, "t", F.lit(1).alias("_kind"), at.alias("_point"), F.lit(None).cast(known.select(row.alias("r")).schema["r"].dataType).alias("_known")).unionByName(
        known.select(SESSION, "t", F.lit(0).alias("_kind"), F.lit(None).cast(points.select(at.alias("p")).schema["p"].dataType).alias("_point"), row.alias("_known"))
    )
    ties = [F.col("_known")[c] for c in order]
    w = Window.partitionBy(SESSION).orderBy("t", "_kind", *ties).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(SESSION).orderBy(F.col("t").desc(), "_kind", *[c.desc() for c in ties]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last("_known", True).over(w)).withColumn("after", F.last("_known", True).over(back))
    return found.where("_kind = 1").select(SESSION, "_point.*", "before", "after")


def as_of(points: DataFrame, known: DataFrame, value: str, default=None, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Points with ``value`` of the latest known row at or before t, of equal times the later row; else default."""
    found = _beside(points, known, list(order)).withColumn(value, F.coalesce(F.col("before")[value], F.lit(default)))
    return found.drop("before", "after")


def interpolated(points: DataFrame, known: DataFrame, value: str, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """``value`` on the line between the known rows around t, constant beyond the ends."""
    a, b = F.col("before"), F.col("after")
    line = a[value] + (b[value] - a[value]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    v = F.when(a.isNull(), b[value]).when(b.isNull() | (a["t"] == b["t"]), a[value]).otherwise(line)
    return _beside(points, known, list(order)).withColumn(value, v).drop("before", "after")


def nearest(points: DataFrame, known: DataFrame, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Points with the idx of the known row nearest in time, the lower of equally near ones. known has idx ascending in t."""
    a, b = F.col("before"), F.col("after")
    closer = F.when(a.isNull(), b["idx"]).when(b.isNull(), a["idx"]).when(b["t"] - F.col("t") < F.col("t") - a["t"], b["idx"]).otherwise(a["idx"])
    return _beside(points, known, list(order)).withColumn("nearest", closer).drop("before", "after")


def last_containing(words: DataFrame, segments: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The speaker of the last-starting segment at or before a word's middle, if it reaches there."""
    points = words.select(SESSION, "word_idx", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    known = segments.select(SESSION, (F.col("t0") - tolerance).alias("t"), F.col("seg_idx").alias("idx"), "t1", "speaker")
    found = _beside(points, known, ["idx"])
    return found.withColumn("speaker", F.when(F.col("t") <= F.col("before.t1") + tolerance, F.col("before.speaker"))).drop("before", "after")


def paint(segments: DataFrame, frames: DataFrame, hz: float) -> DataFrame:
    """The index of the last segment over each frame [floor(t0 hz), ceil(t1 hz)), -1 outside all."""
    some = segments.withColumn("_a", F.greatest(F.floor(F.col("t0") * hz), F.lit(0))).withColumn("_b", F.ceil(F.col("t1") * hz) - 1)
    hit = some.where("_b >= _a").withColumn("i", F.explode(F.sequence("_a", "_b"))).groupBy(SESSION, "i").agg(F.max("seg_idx").alias("painted"))
    return frames.select(SESSION, "i").join(hit, [SESSION, "i"], "left").withColumn("painted", F.coalesce("painted", F.lit(-1)))


def inside(events: DataFrame, intervals: DataFrame, tolerance: float = 0.0, anti: bool = False) -> DataFrame:
    """Events (session, event_id, t, ...) that lie in an interval (session, t0, t1), or in none."""
    a = events.select(SESSION, "event_id", F.col("t").alias("l0"), F.col("t").alias("l1"))
    b = intervals.select(SESSION, (F.col("t0") - tolerance).alias("r0"), (F.col("t1") + tolerance).alias("r1"))
    hit = touching(a, b).select(SESSION, "event_id").distinct()
    return events.join(hit, [SESSION, "event_id"], "left_anti" if anti else "left_semi")


def hit_intervals(intervals: DataFrame, events: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Intervals (session, iv, t0, t1) that hold an event."""
    a = intervals.select(SESSION, "iv", (F.col("t0") - tolerance).alias("l0"), (F.col("t1") + tolerance).alias("l1"))
    b = events.select(SESSION, F.col("t").alias("r0"), F.col("t").alias("r1"))
    return intervals.join(touching(a, b).select(SESSION, "iv").distinct(), [SESSION, "iv"], "left_semi")


def next_within(seeds: DataFrame, targets: DataFrame, delay: float, same: tuple[str, str]) -> DataFrame:
    """For each seed (session, event_id, t, ...) the first target in (t, t + delay] whose ``same[1]`` equals the seed's ``same[0]``."""
    a = seeds.select(SESSION, F.col("event_id").alias("seed"), F.col("t").alias("l0"), (F.col("t") + delay).alias("l1"), F.col(same[0]).alias("_want"))
    b = targets.select(SESSION, F.col("event_id").alias("target"), F.col("t").alias("r0"), F.col("t").alias("r1"), F.col(same[1]).alias("_have"))
    pairs = touching(a, b, width=max(delay, 1.0)).where("r0 > l0 and _want = _have")
    first = pairs.groupBy(SESSION, "seed").agg(F.min(F.struct(F.col("r0").alias("t"), "target")).alias("f"), F.min("l0").alias("l0"))
    return first.select(SESSION, "seed", "f.target", (F.col("f.t") - F.col("l0")).alias("delay"))


def words_near(events: DataFrame, words: DataFrame, reach: float = 1.5, most: int = 20) -> DataFrame:
    """The first ``most`` words that overlap [t - reach, t + reach], in order; all overlaps count."""
    a = events.select(SESSION, "event_id", (F.col("t") - reach).alias("l0"), (F.col("t") + reach).alias("l1"))
    b = words.select(SESSION, "word_idx", "word", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    w = Window.partitionBy(SESSION, "event_id").orderBy("word_idx")
    few = touching(a, b).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    return few.groupBy(SESSION, "event_id").agg(F.array_join(listed, " ").alias("words"))


def text_by_start(segments: DataFrame, words: DataFrame, separator: str = "") -> DataFrame:
    """Segments with the words that start in [t0, t1), joined in order; empty without any."""
    a = segments.select(SESSION, "seg_idx", F.col("t0").alias("l0"), F.col("t1").alias("l1"))
    b = words.select(SESSION, "word_idx", "word", F.col("t0").alias("r0"), F.col("t0").alias("r1"))
    hit = touching(a, b).where("r0 < l1")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    text = hit.groupBy(SESSION, "seg_idx").agg(F.array_join(listed, separator).alias("joined"))
    return segments.join(text, [SESSION, "seg_idx"], "left").withColumn("joined", F.coalesce("joined", F.lit("")))


def text_by_overlap(segments: DataFrame, words: DataFrame, separator: str = " ") -> DataFrame:
    """Segments with all words that overlap them; segments without any go."""
    a = segments.select(SESSION, "seg_idx", F.col("t0").alias("l0"), F.col("t1").alias("l1"))
    b = words.select(SESSION, "word_idx", "word", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    hit = touching(a, b).where("r0 < l1 and l0 < r1")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    text = hit.groupBy(SESSION, "seg_idx").agg(F.array_join(listed, separator).alias("joined"))
    return segments.join(text, [SESSION, "seg_idx"])


def clamp_to_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments cut to the span of their session's words; what is empty then goes."""
    span = words.groupBy(SESSION).agg(F.min("t0").alias("_a"), F.max("t1").alias("_b"))
    cut = segments.join(span, SESSION).withColumns({"t0": F.greatest("t0", "_a"), "t1": F.least("t1", "_b")})
    return cut.where("t1 > t0").drop("_a", "_b")


def chunk_means_or_nearest(chunks: DataFrame, frames: DataFrame, hz: float, value: str = "vad") -> DataFrame:
    """As J3; a chunk without frames takes the value of the frame nearest to its centre."""
    hit = frames_within(chunks, hz, closed=False).join(by_merge(frames.select(SESSION, "i", value)), [SESSION, "i"])
    mean = hit.groupBy(SESSION, "chunk_idx").agg(F.avg(value).alias("score"))
    every = chunks.join(by_merge(mean), [SESSION, "chunk_idx"], "left")
    lone = every.where("score is null").select(SESSION, "chunk_idx", "t0", "t1", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    near = nearest(lone, frames.select(SESSION, "t", F.col("i").alias("idx"))).join(
        by_merge(frames.select(SESSION, F.col("i").alias("nearest"), F.col(value).alias("score"))), [SESSION, "nearest"], "left"
    )
    return every.where("score is not null").select(SESSION, "chunk_idx", "score").unionByName(near.select(SESSION, "chunk_idx", F.coalesce("score", F.lit(0.0)).alias("score")))


def hits_by_flag(events: DataFrame, intervals: DataFrame, flag: str, tolerance: float = 0.0) -> DataFrame:
    """Per session how many events lie in an interval, parted by a flag into yes, no and unknown."""
    own = inside(events, intervals, tolerance)
    count = lambda c: F.sum(c.cast("long"))
    f = F.col(flag)
    return own.groupBy(SESSION).agg(
        F.count("*").alias("hits"), count(F.coalesce(f, F.lit(False))).alias("yes"), count(F.coalesce(~f, F.lit(False))).alias("no"), count(f.isNull()).alias("unknown")
    )
