"""Writers of transcripts, subtitles, results and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown, timecode

SESSION = "session"


def _assembled(df: DataFrame, block, separator: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("t0", "seg_idx", block.alias("b"))))
    return df.groupBy(SESSION).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), separator).alias("text"))


def srt(segments: DataFrame) -> DataFrame:
    """K2: (session, text): numbered blocks with times, speaker and text."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(SESSION).orderBy("t0", "seg_idx"))
    numbered = segments.withColumn("_n", n)
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), timecode(F.col("t0")), F.lit(" --> "), timecode(F.col("t1")), F.lit("\n"), F.col("speaker"), F.lit(":\n"), F.coalesce("text", F.lit("")))
    return _assembled(numbered, block, "\n\n")


def txt(segments: DataFrame) -> DataFrame:
    """K3: (session, text): a header, the text and a blank line for each segment."""
    block = F.concat(F.lit("["), timecode(F.col("t0"), millis=False), F.lit("] "), F.col("speaker"), F.lit(":\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return _assembled(segments, block, "\n")


def result_json(segments: DataFrame, words: DataFrame) -> DataFrame:
    """K1: (session, json) with the lists segments and words."""
    s = segments.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.struct(F.col("t0").alias("start"), F.col("t1").alias("end"), "speaker", "text"))).alias("segments"))
    w = words.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.struct(F.col("t0").alias("start"), F.col("t1").alias("end"), "word"))).alias("words"))
    return s.join(w, SESSION, "left").select(SESSION, F.to_json(F.struct("segments", "words")).alias("json"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One row a session below a folder of its own; an existing path is an error (K6)."""
    texts.write.mode("errorifexists").partitionBy(SESSION).text(path)


def write_events_tsv(events: DataFrame, columns: list[str], path: str) -> None:
    """K4: tab-separated, six decimals, NA for null."""
    kinds = dict(events.dtypes)
    cols = [shown(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns]
    events.select(*cols).write.mode("errorifexists").csv(path, sep="\t", header=True)


def write_events_jsonl(events: DataFrame, path: str) -> None:
    """K5: nested events, one object a line."""
    events.write.mode("errorifexists").json(path)


def performance_report(metrics: DataFrame) -> DataFrame:
    """K7: (session, report) of metrics (session, rtf, coverage, speakers)."""
    line = F.format_string("RTF %.3f, coverage %.1f%%, speakers %d", "rtf", F.col("coverage") * 100, F.col("speakers").cast("int"))
    return metrics.select(SESSION, line.alias("report"))


def interval_report(intervals: DataFrame, label: str) -> DataFrame:
    """(session, report): the intervals of each session as the report reader expects them."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(SESSION).orderBy("t0"))
    line = F.format_string("  %2d  %8.2f  %8.2f  %7.2f", n, F.col("t0"), F.col("t1"), F.col("t1") - F.col("t0"))
    rows = intervals.withColumn("_line", F.struct("t0", line.alias("b")))
    listed = F.transform(F.sort_array(F.collect_list("_line")), lambda x: x["b"])
    head = F.format_string("=== Misclassified intervals (%s) ===\n  count : %d\n  total : %.1f sec\n", F.lit(label), F.count("*"), F.sum(F.col("t1") - F.col("t0")))
    return rows.groupBy(SESSION).agg(F.concat(head, F.array_join(listed, "\n")).alias("report"))


def write_posteriors(frames: DataFrame, path: str) -> None:
    """K8: frames (session, i, t, p) as Parquet, in single precision, each with its session's last time as ``duration``."""
    last = frames.groupBy(SESSION).agg(F.max("t").cast("float").alias("duration"))
    kept = frames.select(SESSION, "i", F.col("t").cast("float").alias("t"), F.col("p").cast("array<float>").alias("p"))
    kept.join(last, SESSION).write.mode("errorifexists").parquet(path)


def upper_bound_report(pairs: DataFrame, mapping: DataFrame, hz: float) -> DataFrame:
    """(session, report) of the best possible accuracy: pairs (session, gold, pred, seconds) with the roles GUEST and HOST,
    mapping (session, cluster, role)."""
    of = lambda g, p: F.coalesce(F.sum(F.when((F.col("gold") == g) & (F.col("pred") == p), F.col("seconds"))), F.lit(0.0))
    sums = pairs.groupBy(SESSION).agg(of("GUEST", "GUEST").alias("gg"), of("GUEST", "HOST").alias("gh"), of("HOST", "GUEST").alias("hg"), of("HOST", "HOST").alias("hh"))
    named = F.format_string("cluster_%d→%d (%s)", F.col("cluster").cast("int"), (F.col("role") == "HOST").cast("int"), "role")
    listed = mapping.groupBy(SESSION).agg(F.sort_array(F.collect_list(F.struct("cluster", named.alias("b")))).alias("m"))
    share = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0.0)), F.lit(0.0))
    gg, gh, hg, hh = (F.col(c) for c in ("gg", "gh", "hg", "hh"))
    total = gg + gh + hg + hh
    # The report's lines.
    lines = [
        F.lit("=== CampPlus Upper-Bound Oracle (frame-wise, argmax(spk_probs)) ==="),
        F.format_string("- Frame step        : %.3f sec (%.1f Hz)", F.lit(1 / hz), F.lit(float(hz))),
        F.format_string("- Total frames      : %d  (%.1f sec)", F.round(total * hz).cast("long"), total),
        F.concat(F.lit("- Best cluster→role mapping (0=GUEST, 1=HOST): "), F.coalesce(F.array_join(F.transform("m", lambda x: x["b"]), ", "), F.lit(""))),
        F.lit(""),
        F.format_string("Upper-bound accuracy: %.4f", share(gg + hh, total)),
        F.lit(""),
        F.lit("Confusion matrix (durations in seconds)"),
        F.lit("  gold\\pred   GUEST       HOST"),
        F.format_string("  GUEST     %8.1f  %8.1f", gg, gh),
        F.format_string("  HOST      %8.1f  %8.1f", hg, hh),
        F.lit(""),
        F.lit("Per-role accuracy (by gold role)"),
        F.format_string("  GUEST: %.4f  (correct %.1fs / total %.1fs)", share(gg, gg + gh), gg, gg + gh),
        F.format_string("  HOST : %.4f  (correct %.1fs / total %.1fs)", share(hh, hg + hh), hh, hg + hh),
    ]
    return sums.join(listed, SESSION, "left").select(SESSION, F.array_join(F.array(*lines), "\n").alias("report"))
