"""Statistics per session, speaker and event; confusion, mapping and scores of label tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import by_merge

SESSION = "session"
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def speaker_stats(segments: DataFrame) -> DataFrame:
    """A1: seconds and number of segments of each speaker; empty segments and missing speakers do not count."""
    own = segments.where("t1 > t0 and speaker is not null")
    return own.groupBy(SESSION, "speaker").agg(
        F.sum(F.col("t1") - F.col("t0")).alias("seconds"), F.count("*").alias("segments"), F.min("t0").alias("first_seen")
    )


def effective_speakers(stats: DataFrame, coverage: float = 0.97, least: int = 1, most: int = 8) -> DataFrame:
    """A2: the longest speakers that jointly cover the share, at least ``least`` and at most ``most``; of equal ones
    whoever speaks first."""
    w = Window.partitionBy(SESSION).orderBy(F.round("seconds", 9).desc(), "first_seen", "speaker")
    before = F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("seconds").over(Window.partitionBy(SESSION))
    ranked = stats.withColumns({"rank": F.row_number().over(w), "covered_before": before / total})
    return ranked.where((F.col("rank") <= most) & ((F.col("covered_before") < coverage) | (F.col("rank") <= least)))


def coverage(words: DataFrame, durations: DataFrame) -> DataFrame:
    """A3: (last end - first start) / duration; 0 for durations up to 0.1."""
    span = words.groupBy(SESSION).agg((F.max("t1") - F.min("t0")).alias("span"))
    share = F.when(F.col("duration") <= 0.1, 0.0).otherwise(F.coalesce(F.col("span") / F.col("duration"), F.lit(0.0)))
    return durations.join(span, SESSION, "left").select(SESSION, share.alias("coverage"))


def speech_ratio(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    return frames.groupBy(SESSION).agg(F.avg((F.col("vad") > threshold).cast("double")).alias("speech_ratio"))


def posterior_stats(frames: DataFrame) -> DataFrame:
    """A4: means of the greatest probability and of the entropy, and changes of the likeliest speaker."""
    from ..functions.vectors import argmax, entropy

    top = frames.select(SESSION, "i", F.array_max("p").alias("m"), entropy(F.col("p")).alias("e"), argmax(F.col("p")).alias("a"))
    moved = top.withColumn("s", (F.col("a") != F.lag("a").over(Window.partitionBy(SESSION).orderBy("i"))).cast("int"))
    return moved.groupBy(SESSION).agg(F.avg("m").alias("mean_max"), F.avg("e").alias("mean_entropy"), F.coalesce(F.sum("s"), F.lit(0)).alias("switches"))


def mass_fractions(labelled: DataFrame, label: str = "label") -> DataFrame:
    """A5: count and share of each label in its session."""
    counts = labelled.groupBy(SESSION, label).agg(F.count("*").alias("n"))
    return counts.withColumn("mass", F.col("n") / F.sum("n").over(Window.partitionBy(SESSION)))


def segment_confidence(segments: DataFrame, frames: DataFrame, hz: float, index: Column) -> DataFrame:
    """Mean probability of the segment's own speaker over its frames [left(t0), right(t1)), one frame at least."""
    last = frames.groupBy(SESSION).agg(F.max("i").alias("_last"))
    spans = segments.withColumn("_k", index).join(by_merge(last), SESSION)
    first = F.least(F.ceil(F.col("t0") * hz), F.col("_last"))
    stop = F.greatest(F.least(F.ceil(F.col("t1") * hz) - 1, F.col("_last")), first)
    hit = spans.withColumn("i", F.explode(F.sequence(first, stop))).join(by_merge(frames.select(SESSION, "i", "p")), [SESSION, "i"])
    return hit.groupBy(SESSION, "seg_idx").agg(F.avg(F.get("p", F.col("_k"))).alias("confidence"))


def confusion(grid: DataFrame, gold: str, predicted: str, dt: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Seconds (frames times dt) of each pair of labels."""
    return grid.groupBy(*by, gold, predicted).agg((F.count("*") * F.lit(dt)).alias("seconds"))


def best_mapping(pairs: DataFrame) -> DataFrame:
    """Pairs (label, gold 0/1, seconds) -> (mask, labels, accuracy): which labels are role 1, the empty and the full set
    left out, the least mask of equal accuracy. Labels, in order, are bits (the mask is null beyond 62 labels, ``labels`` names them in any
    case); with fewer than two labels accuracy and mask are 0. One row.

    Each label goes where most of its time is; if that makes the empty or the full set, the label that loses least changes sides."""
    per = pairs.groupBy("label").agg(
        F.sum(F.when(F.col("gold") == 1, F.col("seconds")).otherwise(0.0)).alias("one"),
        F.sum(F.when(F.col("gold") == 0, F.col("seconds")).otherwise(0.0)).alias("zero"),
    )
    listed = per.agg(F.sort_array(F.collect_list(F.struct("label", "one", "zero"))).alias("rows"), F.sum(F.col("one") + F.col("zero")).alias("all"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    # rounded, so that ties are ties; the position breaks them in favour of the least mask
    gain = F.transform("rows", lambda r, i: F.struct(F.round(F.coalesce((r["one"] - r["zero"]) / F.nullif("all", F.lit(0.0)), F.lit(0.0)), 12).alias("g"), (-i).alias("back")))
    k = F.size("rows")
    gained = listed.select("rows", "all", gain.alias("gain"), k.alias("k"))
    n = F.size(F.filter("gain", lambda x: x["g"] > 0))
    moved = F.when(n == 0, -F.array_max("gain")["back"]).when(n == F.col("k"), -F.array_min("gain")["back"]).otherwise(-1)
    sided = gained.withColumn("moved", moved).withColumn("yes", F.transform("gain", lambda x: (x["g"] > 0) != (-x["back"] == F.col("moved"))))
    right = total(F.zip_with("rows", "yes", lambda r, y: F.when(y, r["one"]).otherwise(r["zero"])))
    bits = F.aggregate("gain", F.lit(0).cast("long"), lambda s, x: s + F.when(F.get("yes", -x["back"]), F.call_function("shiftleft", F.lit(1).cast("long"), -x["back"])).otherwise(F.lit(0).cast("long")))
    few = F.col("k") < 2
    return sided.select(
        F.when(few, F.lit(0).cast("long")).when(F.col("k") <= 62, bits).alias("mask"),
        F.transform(F.filter("rows", lambda r, i: ~few & F.get("yes", i)), lambda r: r["label"]).alias("labels"),
        F.when(few, 0.0).otherwise(F.round(F.coalesce(right / F.nullif("all", F.lit(0.0)), F.lit(0.0)), 12)).alias("accuracy"),
    )


def role_accuracy(grid: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Right and all frames and their ratio for each gold role."""
    right = (F.col(gold) == F.col(predicted)).cast("long")
    return grid.groupBy(gold).agg(F.sum(right).alias("correct"), F.count("*").alias("total")).withColumn(
        "accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0)
    )


def summary(df: DataFrame, value: str, by: tuple[str, ...] = (), quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Count, mean, extremes and exact, interpolated quantiles."""
    cols = [F.percentile(value, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in quantiles]
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *cols)


def histogram(df: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """(bin, n) of bins of ``width`` from 0; bin -1 counts what is below, bin ``bins`` what is above; the last
    bin is closed. All bins appear."""
    c, top = F.col(value), width * bins
    at = F.when(c < 0, -1).when(c > top, bins).otherwise(F.least(F.floor(c / width), F.lit(bins - 1))).cast("int")
    counts = df.where(c.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bucket_means(events: DataFrame, cp: str, terms: list[str], high: float = 0.9, low: float = 0.3) -> DataFrame:
    """Means of the terms over events with a high and with a low change-point score."""
    bucket = F.when(F.col(cp) >= high, "high").when(F.col(cp) <= low, "low")
    return events.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), *[F.avg(t).alias(t) for t in terms])


def dominant_term(events: DataFrame, terms: list[str]) -> DataFrame:
    """The term of greatest absolute value, the first named of equal ones; null without any value."""
    pairs = F.array(*[F.struct(F.abs(F.col(t)).alias("v"), F.lit(-k).alias("k"), F.lit(t).alias("name")) for k, t in enumerate(terms)])
    best = F.array_max(F.filter(pairs, lambda x: x["v"].isNotNull()))
    return events.withColumn("dominant", best["name"])


def term_stats(events: DataFrame, terms: list[str], by: tuple[str, ...]) -> DataFrame:
    """Z3: per term count, missing, extremes, quantiles and mean."""
    long = events.select(*by, F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).cast("double").alias("value")) for t in terms])).alias("x"))
    flat = long.select(*by, "x.term", "x.value")
    return flat.groupBy(*by, "term").agg(
        F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("missing"), F.min("value").alias("least"),
        F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.max("value").alias("most"), F.avg("value").alias("mean"),
    )


def type_counts(events: DataFrame, kind: str) -> DataFrame:
    """A16."""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct(SESSION).alias("sessions"))


def speech_stats(spans: DataFrame, totals: DataFrame, hz: float) -> DataFrame:
    """Spans (session, first, stop) and totals (session, frames) -> ratio, number, mean and median in seconds."""
    own = spans.withColumn("_n", F.col("stop") - F.col("first")).groupBy(SESSION).agg(
        F.count("*").alias("segments"), F.sum("_n").alias("_sum"), (F.avg("_n") / hz).alias("mean_sec"), (F.percentile("_n", F.lit(0.5)) / hz).alias("median_sec")
    )
    j = totals.join(own, SESSION, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(SESSION, zero("segments").alias("segments"), (zero("_sum") / F.col("frames")).alias("ratio"), zero("mean_sec").alias("mean_sec"), zero("median_sec").alias("median_sec"))


def mask_scores(masks: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Overlap over union (0 of two empty masks), and precision, recall and F1 of b against a (1 of two empty)."""
    t, p = F.col(a), F.col(b)
    n = lambda c: F.sum(c.cast("long"))
    counts = masks.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"))
    ratio = lambda x, y, empty: F.when(y > 0, x / y).otherwise(F.lit(empty))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fp + fn) == 0
    pick = lambda v: F.when(none, 1.0).otherwise(v)
    return counts.select(
        *by, "tp", "fp", "fn", ratio(tp, tp + fp + fn, 0.0).alias("iou"), pick(ratio(tp, tp + fp, 0.0)).alias("precision"),
        pick(ratio(tp, tp + fn, 0.0)).alias("recall"), pick(ratio(2 * tp, 2 * tp + fp + fn, 0.0)).alias("f1"),
    )


def grid_search(points: DataFrame, truth: Column, score: Column, a: list[float], b: list[float], threshold: list[float]) -> DataFrame:
    """The (a, b, threshold) with the best F1 of sigmoid(a (score - b)) >= threshold; the first of equal ones.
    The parameters are an array literal that each row is held against; one pass, partial sums."""
    from ..functions.numbers import calibrated

    grid = [(x, y, t) for x in a for y in b for t in threshold]
    p = [calibrated(score, x, y) >= t for x, y, t in grid]
    cols = []
    for k, hit in enumerate(p):
        cols += [F.sum((truth & hit).cast("long")).alias(f"tp{k}"), F.sum((truth != hit).cast("long")).alias(f"off{k}")]
    sums = points.agg(*cols)
    rows = F.array(*[
        F.struct(F.when(F.col(f"tp{k}") + F.col(f"off{k}") == 0, 1.0).otherwise(2.0 * F.col(f"tp{k}") / (2 * F.col(f"tp{k}") + F.col(f"off{k}"))).alias("f1"),
                 F.lit(-k).alias("k"), F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(t).alias("threshold"))
        for k, (x, y, t) in enumerate(grid)
    ])
    return sums.select(F.array_max(rows).alias("m")).select("m.a", "m.b", "m.threshold", "m.f1")


def gaps(segments: DataFrame, least: float = 0.1, most: int = 5) -> DataFrame:
    """The ``most`` longest gaps over ``least`` between segments of each session."""
    w = Window.partitionBy(SESSION).orderBy("t0", "seg_idx")
    found = segments.withColumn("gap", F.lead("t0").over(w) - F.col("t1")).where(F.col("gap") > least)
    rank = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.round("gap", 9).desc(), "t0"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select(SESSION, "rank", F.col("t1").alias("t"), "gap")


def confident_zones(frames: DataFrame, speech: float = 0.35, top: float = 0.95, margin: float = 0.7, entropy: float = 0.3, least: float = 0.5, dt: float = 0.5) -> DataFrame:
    """The longest five runs per session of speech frames with a clear speaker."""
    from ..functions.vectors import argmax, entropy_normalised
    from ..functions.vectors import margin as gap
    from .sequences import run_ids

    p = F.col("p")
    sure = (F.array_max(p) >= top) & (gap(p) >= margin) & (entropy_normalised(p) <= entropy) & (F.col("vad") >= speech)
    marked = run_ids(frames.withColumn("_own", F.when(sure, argmax(p))), "_own", "i").where("_own is not null")
    spans = marked.groupBy(SESSION, "run").agg(F.first("_own").alias("speaker"), F.min("t").alias("t0"), (F.count("*") * dt).alias("seconds")).where(F.col("seconds") >= least)
    rank = F.row_number().over(Window.partitionBy(SESSION).orderBy(F.col("seconds").desc(), "t0"))
    return spans.withColumn("rank", rank).where("rank <= 5").drop("run")


def path_report(frames: DataFrame, path: str, hz: float) -> DataFrame:
    """How often the path differs from the likeliest speaker, and its switches a minute."""
    from ..functions.vectors import argmax

    w = Window.partitionBy(SESSION).orderBy("i")
    marked = frames.select(SESSION, "i", (F.col(path) != argmax(F.col("p"))).cast("double").alias("off"), (F.col(path) != F.lag(path).over(w)).cast("int").alias("s"))
    return marked.groupBy(SESSION).agg(F.avg("off").alias("mismatch"), (F.coalesce(F.sum("s"), F.lit(0)) * 60 * hz / F.count("*")).alias("switches_per_minute"))


def tail_margin(segments: DataFrame, low: float = 1.0, high: float = 15.0) -> DataFrame:
    """The upper median of the positive distances of starts, within low and high; ``low`` for fewer than two segments."""
    w = Window.partitionBy(SESSION).orderBy("t0", "seg_idx")
    d = segments.withColumn("_d", F.lead("t0").over(w) - F.col("t0"))
    listed = d.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.when(F.col("_d") > 0, F.col("_d")))).alias("g"), F.count("*").alias("n"))
    middle = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    return listed.select(SESSION, F.when(F.col("n") < 2, low).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(middle, F.lit(low))))).alias("tail"))


def step_report(steps: DataFrame, durations: DataFrame) -> DataFrame:
    """Real-time factor (sum of step times over the duration, at least 1 s) and each step's share."""
    total = steps.groupBy(SESSION).agg(F.sum("seconds").alias("_total"))
    j = steps.join(total, SESSION).join(durations, SESSION)
    return j.select(SESSION, "step", (F.col("seconds") / F.col("_total")).alias("share"), (F.col("_total") / F.greatest("duration", F.lit(1.0))).alias("rtf"))


def token_accuracy(aligned: DataFrame) -> DataFrame:
    """A9's counts: aligned (doc, ref_word, hyp_word, ref_speaker, hyp_speaker) -> tokens of equal words per pair of speakers."""
    same = aligned.where("ref_word = hyp_word")
    return same.groupBy("doc", "ref_speaker", "hyp_speaker").agg(F.count("*").alias("n"))
