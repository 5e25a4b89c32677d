"""The timeline from word and frame tables to speaker-attributed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..durable import settled
from ..operators import aggregates as A
from ..operators import decode as D
from ..operators import folds
from ..operators import intervals as J
from ..operators import sequences as W

SESSION = "session"


def sanitised(segments: DataFrame, durations: DataFrame, s: Settings | None = None, least: int = 1, most: int = 8) -> DataFrame:
    """Dominant speakers, reassignment of the others, merging, island smoothing, zones if wanted, and the clamp to the recording."""
    t = (s or Settings()).timeline
    segments = settled(segments)
    kept = A.effective_speakers(A.speaker_stats(segments), t.coverage, least, most).select(SESSION, "speaker", "rank")
    merged = settled(W.merged_timeline(folds.reassigned(segments, kept), t.merge_gap))
    smooth = folds.smoothed_segments(merged.withColumnRenamed("run", "seg_idx"), t.longest_island, t.merge_gap)
    if t.zones:
        smooth = in_zones(smooth, W.switch_zones(_numbered(smooth), t.zone_window, t.zone_step))
    clamped = smooth.join(durations, SESSION).withColumns(
        {"t0": F.greatest(F.lit(0.0), F.col("t0")), "t1": F.least(F.col("t1"), F.col("duration"))}
    )
    return _numbered(clamped.where("t1 > t0").select(SESSION, "t0", "t1", "speaker"))


def _numbered(segments: DataFrame) -> DataFrame:
    return segments.withColumn("seg_idx", (F.row_number().over(W.by("t0", "t1")) - 1).cast("long"))


def in_zones(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Segments whose middle lies in a zone take the first such zone's speaker."""
    own = _numbered(segments)
    middle = (F.col("t0") + F.col("t1")) / 2
    hit = J.touching(own.select(SESSION, "seg_idx", middle.alias("l0"), middle.alias("l1")), zones.select(SESSION, "zone", F.col("speaker").alias("_s"), F.col("t0").alias("r0"), F.col("t1").alias("r1")))
    first = hit.groupBy(SESSION, "seg_idx").agg(F.min_by("_s", "zone").alias("_s"))
    return own.join(first, [SESSION, "seg_idx"], "left").select(SESSION, "t0", "t1", F.coalesce("_s", "speaker").alias("speaker"))


def attributed(frames: DataFrame, words: DataFrame, s: Settings | None = None) -> DataFrame:
    """frames (session, i, t, vad, p) and words -> session, seg_idx, t0, t1, speaker, text: change points and costs, frame and word
    decoding, segments, sanitation, text."""
    s = s or Settings()
    hz = s.align.hz
    frames, words = settled(frames), settled(words)
    scored = W.change_scores(frames).join(J.word_costs(words, frames, hz), [SESSION, "i"]).join(J.lexical_scales(words, frames, hz, 1.0, 1.0), [SESSION, "i"])
    path = D.decoded(scored, s.align).select(SESSION, "i", "path")
    with_path = frames.join(path, [SESSION, "i"])
    with_path = settled(with_path)
    smooth = W.smoothed_islands(with_path, "path").select(*frames.columns, F.col("smoothed").alias("path"))
    worded = settled(D.with_word_path(smooth, words, s.align))
    final = frames.join(worded, [SESSION, "i"])
    found = D.segmented(final).withColumn("speaker", F.format_string("SPEAKER_%02d", "k")).drop("k")
    durations = frames.groupBy(SESSION).agg((F.max("t") + 1 / hz).alias("duration"))
    clean = settled(sanitised(found, durations, s))
    return J.text_by_start(clean, words, " ").withColumnRenamed("joined", "text")


def boundary_events(frames: DataFrame, path: str, words: DataFrame, most: int = 30, around: int = 25) -> DataFrame:
    """V9: a nested record of each switch and change-point peak (switches first, ``most`` a session), with the frames around it
    and the words near it; frames are keyed by their index."""
    from ..functions.vectors import argmax, entropy_normalised, margin

    scored = settled(W.change_scores(frames))
    sw = W.switches(scored, path).select(SESSION, "i", F.lit("switch").alias("event_type"))
    pk = W.peaks(scored, "cp", 0.9, 10).select(SESSION, "i", F.lit("cp_peak").alias("event_type"))
    ev = W.events_with_precedence(sw, pk, most).drop("rank")
    p = F.col("p")
    rows = scored.select(SESSION, F.col("i").alias("j"), F.struct(F.col("i"), "t", F.col(path).alias("path_spk"), "vad", F.array_max("p").alias("p_top1"), margin(p).alias("p_margin"), entropy_normalised(p).alias("p_entropy_norm"), argmax(p).alias("p_argmax"), "cp").alias("frame"))
    near = ev.withColumn("j", F.explode(F.sequence(F.col("i") - around, F.col("i") + around))).join(rows, [SESSION, "j"])
    nested = near.groupBy(SESSION, "i", "event_type").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    timed = nested.join(scored.select(SESSION, "i", F.col("t").alias("time")), [SESSION, "i"])
    said = J.words_near(timed.select(SESSION, F.col("i").alias("event_id"), F.col("time").alias("t")), words)
    return timed.join(said.withColumnRenamed("event_id", "i"), [SESSION, "i"], "left").select(SESSION, "event_type", F.col("i").alias("frame"), "time", F.col("words").alias("words_text"), "frames")
