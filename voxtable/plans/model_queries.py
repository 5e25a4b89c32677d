"""Folds, decoders, clustering, writers and whole plans over the stand-in tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import AlignSettings, ClusterSettings, Settings
from ..functions.numbers import r6
from ..operators import aggregates as A
from ..operators import clustering as C
from ..operators import decode as D
from ..operators import folds
from ..operators import intervals as J
from ..operators import sequences as W
from ..sources import sinks
from . import standins as S
from . import timeline as TL
from .registry import query
from .standins import FRAMES, HZ, SEG, WORDS
from .timeline_queries import HOSTS, TOP, paired, rounded, tops
from .value_queries import ACOS

ALIGN = AlignSettings(hz=HZ)
TURNS = ", tn AS (SELECT session, seg_idx, CASE WHEN seg_idx % 4 = 1 THEN 'B' WHEN seg_idx % 7 = 3 THEN 'C' ELSE 'A' END AS speaker, t0, t1 FROM seg)"


def turns(spark, d):
    """Segments whose speakers make islands."""
    k = F.col("seg_idx")
    return S.segments(spark, d).withColumn("speaker", F.when(k % 4 == 1, "B").when(k % 7 == 3, "C").otherwise("A"))


@query("W7c_island_segments", f"""WITH RECURSIVE {SEG}{TURNS}, ix AS (SELECT *, row_number() OVER w AS n, lead(speaker) OVER w AS nx, lag(seg_idx) OVER w IS NOT NULL AND lead(seg_idx) OVER w IS NOT NULL AS inner_ FROM tn WINDOW w AS (PARTITION BY session ORDER BY t0, seg_idx)),
r AS (SELECT session, n, seg_idx, t0, t1, speaker AS old, speaker AS sp FROM ix WHERE n = 1 UNION ALL
  SELECT ix.session, ix.n, ix.seg_idx, ix.t0, ix.t1, ix.speaker, CASE WHEN ix.inner_ AND r.sp = ix.nx AND r.sp <> ix.speaker AND ix.t1 > ix.t0 AND ix.t1 - ix.t0 <= 12 THEN r.sp ELSE ix.speaker END FROM r JOIN ix ON ix.session = r.session AND ix.n = r.n + 1),
ch AS (SELECT session, bool_or(old <> sp) AS any_ FROM r GROUP BY 1),
m AS (SELECT r.*, CAST(coalesce(NOT (sp = lag(sp) OVER w AND r.t0 - lag(r.t1) OVER w >= 0 AND r.t0 - lag(r.t1) OVER w <= 0.3), TRUE) AS INTEGER) AS new FROM r JOIN ch USING (session) WHERE any_ WINDOW w AS (PARTITION BY session ORDER BY r.t0, seg_idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t0, seg_idx) AS run FROM m)
SELECT session, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(sp) AS speaker FROM g GROUP BY session, run
UNION ALL SELECT session, round(t0, 6), round(t1, 6), sp FROM r JOIN ch USING (session) WHERE NOT any_""")  # fmt: skip
def w7c(spark, d):
    return rounded(folds.smoothed_segments(turns(spark, d), longest=12.0), "t0", "t1")


@query("W7b_island_confidence")
def w7b(spark, d):
    index = F.when(F.col("speaker") == "A", 0).when(F.col("speaker") == "B", 1).otherwise(2)
    s = turns(spark, d)
    sure = A.segment_confidence(s, S.frames(spark, d), HZ, index)
    return rounded(folds.smoothed_by_confidence(s.join(sure, ["session", "seg_idx"], "left"), longest=12.0).drop("run"), "t0", "t1")


@query("W8_short_merge", f"""WITH RECURSIVE {SEG}{HOSTS}, ix AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t0) AS n FROM two),
r AS (SELECT session, n, t0 AS h0, t1 AS h1, speaker AS hs, CAST(NULL AS DOUBLE) AS e0, CAST(NULL AS DOUBLE) AS e1, CAST(NULL AS VARCHAR) AS es FROM ix WHERE n = 1 UNION ALL
  SELECT ix.session, ix.n, CASE WHEN hs = speaker AND t1 - h1 < 0.5 THEN h0 WHEN h1 - h0 < 8 THEN least(h0, t0) ELSE t0 END, t1, speaker,
    CASE WHEN NOT (hs = speaker AND t1 - h1 < 0.5) AND h1 - h0 >= 8 THEN h0 END, h1, hs FROM r JOIN ix ON ix.session = r.session AND ix.n = r.n + 1),
o AS (SELECT session, n, e0 AS t0, e1 AS t1, es AS speaker FROM r WHERE e0 IS NOT NULL),
l AS (SELECT session, n, h0, h1, hs FROM r QUALIFY n = max(n) OVER (PARTITION BY session)),
b AS (SELECT o.session, o.n, o.t0, CASE WHEN l.h1 - l.h0 < 8 AND o.n = max(o.n) OVER (PARTITION BY o.session) THEN l.h1 ELSE o.t1 END AS t1, speaker FROM o JOIN l USING (session)
  UNION ALL SELECT session, n + 1, h0, h1, hs FROM l WHERE h1 - h0 >= 8 OR session NOT IN (SELECT session FROM o))
SELECT session, row_number() OVER (PARTITION BY session ORDER BY n) - 1 AS seg_idx, round(t0, 6) AS t0, round(t1, 6) AS t1, speaker FROM b""")  # fmt: skip
def w8(spark, d):
    return rounded(folds.merged_short(paired(spark, d), least=8.0), "t0", "t1")


@query("W10_ema", f"""WITH RECURSIVE {SEG}{FRAMES}, e AS (SELECT session, i, vad AS y FROM frames WHERE i = 0 UNION ALL SELECT f.session, f.i, 0.3 * f.vad + 0.7 * e.y FROM e JOIN frames f ON f.session = e.session AND f.i = e.i + 1)
SELECT session, i, round(y, 6) AS ema FROM e""")  # fmt: skip
def w10(spark, d):
    return rounded(folds.ema(S.frames(spark, d), "vad", 0.3), "ema")


@query("W16_reassign", f"""WITH RECURSIVE {SEG}{TURNS}{ACOS.replace("FROM seg", "FROM tn")}, rk AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(seconds, 9) DESC, first_seen, speaker) AS rank FROM sp), kp AS (SELECT session, speaker, rank FROM rk WHERE rank <= 2),
ix AS (SELECT t.*, row_number() OVER w AS n, lead(t.speaker) OVER w AS nx, lead(t.t0) OVER w AS n0, lead(t.t1) OVER w AS n1, lag(t.t0) OVER w AS p0, lag(t.t1) OVER w AS p1, k.speaker IS NOT NULL AS kept, h.speaker AS head FROM tn t LEFT JOIN kp k ON k.session = t.session AND k.speaker = t.speaker LEFT JOIN kp h ON h.session = t.session AND h.rank = 1 WINDOW w AS (PARTITION BY t.session ORDER BY t.t0)),
jx AS (SELECT ix.*, k.speaker AS right_, greatest(0, ix.t0 - p1, p0 - ix.t1) AS gl, greatest(0, n0 - ix.t1, ix.t0 - n1) AS gr FROM ix LEFT JOIN kp k ON k.session = ix.session AND k.speaker = ix.nx),
r AS (SELECT session, n, seg_idx, t0, t1, CASE WHEN kept THEN speaker ELSE coalesce(right_, head) END AS sp FROM jx WHERE n = 1 UNION ALL
  SELECT jx.session, jx.n, jx.seg_idx, jx.t0, jx.t1, CASE WHEN jx.kept THEN jx.speaker WHEN jx.right_ IS NOT NULL AND jx.gr < jx.gl THEN jx.right_ ELSE r.sp END FROM r JOIN jx ON jx.session = r.session AND jx.n = r.n + 1)
SELECT session, seg_idx, round(t0, 6) AS t0, round(t1, 6) AS t1, sp AS speaker FROM r""")  # fmt: skip
def w16(spark, d):
    s = turns(spark, d)
    kept = A.effective_speakers(A.speaker_stats(s), coverage=0.0, least=2, most=2).select("session", "speaker", "rank")
    return rounded(folds.reassigned(s, kept), "t0", "t1")


@query("W21_candidate_merge", f"""WITH RECURSIVE {SEG}{FRAMES}{TOP}, sw AS (SELECT session, t FROM (SELECT *, lag(path) OVER (PARTITION BY session ORDER BY i) AS old FROM top) WHERE old <> path),
ix AS (SELECT session, t AS centre, t - 0.4::DOUBLE AS a, t + 0.4::DOUBLE AS b, row_number() OVER (PARTITION BY session ORDER BY t) AS n FROM sw),
r AS (SELECT session, n, 0 AS k, centre, a, b, 'switch' AS reason FROM ix WHERE n = 1 UNION ALL
  SELECT ix.session, ix.n, CASE WHEN m THEN k ELSE k + 1 END, CASE WHEN m THEN (r.centre + ix.centre) / 2 ELSE ix.centre END, CASE WHEN m THEN least(r.a, ix.a) ELSE ix.a END,
    CASE WHEN m THEN greatest(r.b, ix.b) ELSE ix.b END, CASE WHEN m THEN r.reason || '+switch' ELSE 'switch' END
  FROM r JOIN ix ON ix.session = r.session AND ix.n = r.n + 1, LATERAL (SELECT ix.a <= r.b + 0.5 AND greatest(ix.b, r.b) - least(ix.a, r.a) <= 2 AS m))
SELECT session, CAST(k AS BIGINT) AS n, round(centre, 6) AS centre, round(a, 6) AS a, round(b, 6) AS b, reason FROM r QUALIFY r.n = max(r.n) OVER (PARTITION BY session, k)""")  # fmt: skip
def w21(spark, d):
    sw = W.switches(tops(spark, d), "path")
    c = sw.select("session", F.col("t").alias("centre"), (F.col("t") - 0.4).alias("a"), (F.col("t") + 0.4).alias("b"), F.lit("switch").alias("reason"))
    return rounded(folds.merged_candidates(c), "centre", "a", "b")


@query("J10_boundary_snap")
def j10(spark, d):
    return rounded(folds.snapped(S.segments(spark, d), S.words(spark, d), reach=2.0, marks=".?"), "t0", "t1")


def scored(spark, d):
    f, w = S.frames(spark, d), S.words(spark, d)
    return W.change_scores(f).join(J.word_costs(w, f, HZ), ["session", "i"]).join(J.lexical_scales(w, f, HZ, 0.5, 0.7), ["session", "i"])


@query("V1_resegment")
def v1(spark, d):
    out = D.resegmented(S.frames(spark, d), HZ)
    return out.select("session", "i", "path", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


@query("V2_frame_decode")
def v2(spark, d):
    return D.decoded(scored(spark, d), ALIGN)


@query("V3_word_decode")
def v3(spark, d):
    return D.with_word_path(tops(spark, d), S.words(spark, d), ALIGN)


@query("V6_cluster")
def v6(spark, d):
    return C.clustered(S.vectors(spark, d), ClusterSettings(min_speakers=2, max_speakers=6, em_schedule=(0.3, 0.2, 0.1)))


@query("V8_posteriors")
def v8(spark, d):
    v = S.vectors(spark, d).withColumn("t", F.col("idx") * 0.75).withColumn("valid", F.col("vec_id") % 11 != 0)
    out = C.timelines(v, HZ, ClusterSettings(min_speakers=2, max_speakers=4))
    return out.select("session", "i", "t", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


@query("V9_boundary_events")
def v9(spark, d):
    return TL.boundary_events(tops(spark, d).withColumn("path", (F.floor(F.col("i") / 5) % 3).cast("int")), "path", S.words(spark, d), around=5)


@query("V10_token_alignment")
def v10(spark, d):
    w = S.words(spark, d)
    ref = w.select(F.col("session").alias("doc"), F.lit("ref").alias("side"), F.col("word_idx").alias("pos"), "word", "speaker")
    hyp = w.where(F.length("word") != 4).select(F.col("session").alias("doc"), F.lit("hyp").alias("side"), F.col("word_idx").alias("pos"), "word", "speaker")
    return A.token_accuracy(D.aligned(ref.unionByName(hyp)))


@query("W18_path_segments")
def w18(spark, d):
    return rounded(D.segmented(tops(spark, d).withColumn("path", (F.floor(F.col("i") / 9) % 3).cast("int"))), "t0", "t1")


@query("W24_sanitise")
def w24(spark, d):
    return rounded(TL.sanitised(turns(spark, d), S.durations(spark, d)), "t0", "t1")


@query("E2E_attributed_timeline")
def e2e(spark, d):
    s = replace(Settings(), align=ALIGN)
    return rounded(TL.attributed(S.frames(spark, d), S.words(spark, d), s), "t0", "t1")


US = "CAST(round({} * 1000000) AS BIGINT)"
CODE = "printf('%02d:%02d:%02d,%03d', {0} // 3600000000, {0} // 60000000 % 60, {0} // 1000000 % 60, {0} % 1000000 // 1000)"


@query("K2_srt", f"""WITH {SEG}, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t0, seg_idx) AS n FROM seg)
SELECT session, string_agg(n || chr(10) || {CODE.format(US.format("t0"))} || ' --> ' || {CODE.format(US.format("t1"))} || chr(10) || speaker || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY t0, seg_idx) AS text FROM b GROUP BY 1""")  # fmt: skip
def k2(spark, d):
    return sinks.srt(S.segments(spark, d))


@query("K3_txt", f"""WITH {SEG} SELECT session, string_agg('[' || left({CODE.format(US.format("t0"))}, 8) || '] ' || speaker || ':' || chr(10) || text || chr(10), chr(10) ORDER BY t0, seg_idx) AS text FROM seg GROUP BY 1""")
def k3(spark, d):
    return sinks.txt(S.segments(spark, d))


@query("K1_json", f"""WITH {WORDS}, s AS (SELECT session, list({{'start': round(t0, 6), 'end': round(t1, 6), 'speaker': speaker, 'text': text}} ORDER BY round(t0, 6), round(t1, 6), speaker, text) AS segments FROM seg GROUP BY 1),
w AS (SELECT session, list({{'start': round(t0, 6), 'end': round(t1, 6), 'word': word}} ORDER BY round(t0, 6), round(t1, 6), word) AS words FROM words GROUP BY 1)
SELECT session, CAST(CASE WHEN words IS NULL THEN to_json({{'segments': segments}}) ELSE to_json({{'segments': segments, 'words': words}}) END AS VARCHAR) AS json FROM s LEFT JOIN w USING (session)""")  # fmt: skip
def k1(spark, d):
    return sinks.result_json(rounded(S.segments(spark, d), "t0", "t1"), rounded(S.words(spark, d), "t0", "t1"))


@query("K7_report", f"""WITH {SEG} SELECT session, printf('RTF %.3f, coverage %.1f%%, speakers %d', CAST(0.25 AS DOUBLE), CAST(100 AS DOUBLE), count(DISTINCT speaker)) AS report FROM seg GROUP BY 1""")
def k7(spark, d):
    m = S.segments(spark, d).groupBy("session").agg(F.lit(0.25).alias("rtf"), F.lit(1.0).alias("coverage"), F.countDistinct("speaker").alias("speakers"))
    return sinks.performance_report(m)
