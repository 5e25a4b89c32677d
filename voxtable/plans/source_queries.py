"""Readers and windows, fed with what the writers make of the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sequences
from ..sources import audio, sinks, transcripts
from . import standins as S
from .registry import query
from .standins import SEG, VEC
from .timeline_queries import GRID, HF, role_grid

#: Texts on one line and speakers in capitals, as the formats want them.
SAID = r", sd AS (SELECT session, seg_idx, upper(speaker) AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(round(t0 * 1000000) AS BIGINT) AS a, CAST(round(t1 * 1000000) AS BIGINT) AS b, t0 FROM seg)"
HEAD = f"WITH {SEG}{SAID}"


ERRORS = f"""{HF}{GRID}, m AS (SELECT *, gold = 'GUEST' AND pred = 'HOST' AS hit, coalesce(lead(t) OVER (PARTITION BY session ORDER BY i), t + 0.5) AS nx FROM g),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(coalesce(lag(hit) OVER (PARTITION BY session ORDER BY i) <> hit, TRUE) AS INTEGER) AS new FROM m)),
e AS (SELECT session, min(t) AS t0, max(nx) AS t1 FROM r WHERE hit GROUP BY session, run HAVING max(nx) - min(t) >= 1) """


def said(spark, d) -> DataFrame:
    one_line = F.trim(F.regexp_replace("text", r"\s+", " "))
    return S.segments(spark, d).withColumns({"speaker": F.upper("speaker"), "text": one_line})


def as_lines(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("session").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query("S6_transcript_parse", f"{HEAD} SELECT session AS file, row_number() OVER (PARTITION BY session ORDER BY a // 1000000, t0, seg_idx) - 1 AS seg_idx, CAST(a // 1000000 AS DOUBLE) AS start, speaker, text FROM sd")
def s6(spark, d):
    out = transcripts.transcript(as_lines(sinks.txt(said(spark, d))))
    return out.withColumn("seg_idx", F.col("seg_idx").cast("long"))


TOKENS = HEAD + r""", tk AS (SELECT session, seg_idx, t0, unnest(range(len(w))) AS k, w FROM (SELECT *, string_split(text, ' ') AS w FROM sd WHERE text <> ''))
SELECT session AS file, row_number() OVER (PARTITION BY session ORDER BY t0, seg_idx, k) - 1 AS pos, w[k + 1] AS word, 'SPEAKER_' || lpad(CAST(seg_idx % 2 AS VARCHAR), 2, '0') AS speaker FROM tk"""


@query("S7_token_scan", TOKENS)
def s7(spark, d):
    line = F.format_string("[%s] SPEAKER_%02d: %s", F.lit("00:00:01,000"), (F.col("seg_idx") % 2).cast("int"), F.col("text"))
    df = said(spark, d).select(F.col("session").alias("file"), F.col("seg_idx").alias("n"), line.alias("line"))
    out = transcripts.tokens(df)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("S8_header_times", f"""{HEAD}, n AS (SELECT session, CAST(a // 1000000 AS DOUBLE) AS start, coalesce(CAST(lead(a) OVER (PARTITION BY session ORDER BY t0, seg_idx) // 1000000 AS DOUBLE), 1000000) AS "end", speaker FROM sd)
SELECT session AS file, start, "end", speaker FROM n WHERE "end" > start""")  # fmt: skip
def s8(spark, d):
    return transcripts.header_times(as_lines(sinks.txt(said(spark, d))), 1_000_000.0)


@query("S9_subtitle_parse", f"""{HEAD} SELECT session AS file, row_number() OVER (PARTITION BY session ORDER BY t0, seg_idx) - 1 AS n, round(a // 1000 / 1000.0::DOUBLE, 6) AS start, round(b // 1000 / 1000.0::DOUBLE, 6) AS "end", CASE WHEN text = '' THEN speaker || ':' ELSE speaker || ':' || chr(10) || text END AS text FROM sd""")
def s9(spark, d):
    out = transcripts.subtitles(as_lines(sinks.srt(said(spark, d))))
    return out.withColumns({"n": F.col("n").cast("long"), "start": F.round("start", 6), "end": F.round("end", 6)})


def samples(spark, d) -> DataFrame:
    return S.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("session"), F.col("embedding").alias("samples"))


@query("S3_chunk_scan", f"""WITH {VEC}, st AS (SELECT vec_id, v, unnest(range(0, len(v), 6)) AS s FROM vec) SELECT CAST(vec_id AS VARCHAR) AS session, CAST(s // 6 AS INTEGER) AS chunk_idx, s AS start, CAST(len(v[s + 1 : s + 10]) AS INTEGER) AS n, round(list_sum(v[s + 1 : s + 10]), 5) AS total FROM st""")
def s3(spark, d):
    c = audio.chunks(samples(spark, d), 10, 6)
    total = F.aggregate("chunk", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return c.select("session", "chunk_idx", "start", F.size("chunk").alias("n"), F.round(total, 5).alias("total"))


@query("S4_full_windows", f"WITH {VEC} SELECT CAST(vec_id AS VARCHAR) AS session, s AS a, s + 10 AS b FROM (SELECT vec_id, unnest(range(0, len(v) - 9, 6)) AS s FROM vec)")
def s4(spark, d):
    return audio.full_windows(samples(spark, d), 10, 6)


@query("S5_range_grid", f"""WITH {SEG}, f AS (SELECT *, t0 + k * 0.75::DOUBLE AS a, least(t0 + k * 0.75::DOUBLE + 1.5::DOUBLE, t1) AS b FROM (SELECT session, seg_idx, t0, t1, unnest(range(CAST(ceil((t1 - t0) / 0.75::DOUBLE) AS BIGINT))) AS k FROM seg))
SELECT session, seg_idx, k, round(a, 6) AS a, round(b, 6) AS b FROM f WHERE b - a >= 0.3::DOUBLE * 1.5::DOUBLE""")  # fmt: skip
def s5(spark, d):
    found = audio.range_frames(S.segments(spark, d).select("session", "seg_idx", "t0", "t1"), 1.5, 0.75)
    return found.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@query("S12_report_intervals", ERRORS + "SELECT session, t0, t1 FROM e")
def s12(spark, d):
    wrong = sequences.error_intervals(role_grid(spark, d), "gold", "pred", ("GUEST", "HOST"), 0.5, least=1.0)
    report = sinks.interval_report(wrong, "GUEST as HOST").withColumnRenamed("report", "text")
    return transcripts.report_intervals(as_lines(report), "GUEST as HOST")


@query("Z7_segment_samples", f"""WITH {VEC}, sp AS (SELECT vec_id, v, (vec_id % 7) * 0.6::DOUBLE AS a, (vec_id % 7) * 0.6::DOUBLE + (vec_id % 5) * 0.9::DOUBLE AS b FROM vec),
n AS (SELECT *, CAST(trunc(a * 4) AS BIGINT) AS s, least(CAST(trunc(b * 4) AS BIGINT), len(v)) AS e FROM sp)
SELECT CAST(vec_id AS VARCHAR) AS session, a, b, CAST(e - s AS INTEGER) AS n, round(list_sum(v[s + 1 : e]), 5) AS total FROM n WHERE e - s >= 1""")  # fmt: skip
def z7(spark, d):
    recorded = samples(spark, d)
    k = F.col("session").cast("long")
    a = (k % 7) * F.lit(0.6)
    spans = recorded.select("session", a.alias("a"), (a + (k % 5) * F.lit(0.9)).alias("b"))
    cut = audio.segment_samples(recorded, spans, rate=4)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return cut.select("session", "a", "b", F.size("samples").alias("n"), F.round(total, 5).alias("total"))


LOGGED = """CASE doc_id % 6 WHEN 0 THEN '12:00:01-INFO-' || coalesce(source, '') || ': read' WHEN 1 THEN '2024-01-01 10:00:00,123 - ERROR - ' || coalesce(source, '') || ': lost'
WHEN 2 THEN '2024-01-01T10:00:00 [DEBUG] ' || coalesce(source, '') || ': seen' WHEN 3 THEN '[STDERR] ' || coalesce(source, '') WHEN 4 THEN '[TRACE-ALIGNER] ' || coalesce(source, '') ELSE coalesce(source, '') || ' [SENTINEL]' END"""


@query("T17_log_lines", r"""SELECT doc_id, regexp_matches(line, '^\d\d:\d\d:\d\d-(DEBUG|INFO|WARNING|ERROR|CRITICAL)-[^:]+:') OR regexp_matches(line, '^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(,\d{3})?\s*(- *(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s*-|\[(DEBUG|INFO|WARNING|ERROR|CRITICAL)\])\s*[^:]+:')
OR starts_with(line, '[STDERR]') OR starts_with(line, '[STDOUT]') OR starts_with(line, '[SENTINEL]') AS logged, NOT starts_with(line, '[TRACE-ALIGNER') AS kept FROM (SELECT doc_id, """ + LOGGED + " AS line FROM documents)")
def t17(spark, d):
    lines = S.table(spark, d, "documents").select("doc_id", F.expr(LOGGED).alias("line"))
    return lines.select("doc_id", X.is_log_line(F.col("line")).alias("logged"), X.is_kept(F.col("line")).alias("kept"))
