"""Interval joins and sequence operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import r6
from ..functions.vectors import argmax, margin
from ..operators import aggregates as A
from ..operators import intervals as J
from ..operators import sequences as W
from . import standins as S
from .registry import query
from .standins import CHUNKS, FRAMES, HZ, SEG, SIG, WORDS

H = f"WITH {SEG}"
HW = f"WITH {WORDS}"
HF = f"WITH {SEG}{FRAMES}"
HWF = f"WITH {WORDS}{FRAMES}"
HS = f"WITH {SIG}"


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("P2_word_flatten", f"{HW} SELECT session, word_idx, word, speaker, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM words WHERE t1 > t0")
def p2(spark, d):
    return rounded(S.words(spark, d).where("t1 > t0").select("session", "word_idx", "word", "speaker", "t0", "t1"), "t0", "t1")


@query("P3_speech_gated_chunks", f"""{HF}{CHUNKS} SELECT session, chunk_idx, round(score, 6) AS score FROM (SELECT c.session, c.chunk_idx, coalesce(avg(f.vad), 0) AS score
  FROM chunks c LEFT JOIN frames f ON f.session = c.session AND f.t >= c.t0 AND f.t < c.t1 GROUP BY 1, 2) WHERE round(score, 9) >= 0.4""")  # fmt: skip
def p3(spark, d):
    s = J.chunk_means(S.chunks(spark, d), S.frames(spark, d), HZ).where(F.round("score", 9) >= 0.4)
    return rounded(s.select("session", "chunk_idx", "score"), "score")


@query("J1_max_overlap_assign", f"""{HW}, moved AS (SELECT session, seg_idx, speaker, t0 + CAST(0.4 AS DOUBLE) AS t0, t1 + CAST(0.4 AS DOUBLE) AS t1 FROM seg),
pairs AS (SELECT w.session, w.word_idx, w.t0, w.t1, m.seg_idx, m.speaker, least(w.t1, m.t1) - greatest(w.t0, m.t0) AS o,
  (w.t0 + w.t1) / 2 BETWEEN m.t0 AND m.t1 AS mid FROM words w JOIN moved m ON w.session = m.session AND w.t0 <= m.t1 AND m.t0 <= w.t1),
best AS (SELECT session, word_idx, arg_max(seg_idx, o) AS top, max(o) AS o, min(seg_idx) FILTER (mid) AS mid FROM (SELECT * FROM pairs WHERE o > 0 ORDER BY session, word_idx, seg_idx) GROUP BY 1, 2),
chosen AS (SELECT w.session, w.word_idx, CASE WHEN b.o / (w.t1 - w.t0) < 0.55 AND b.mid IS NOT NULL THEN b.mid ELSE (SELECT min(p.seg_idx) FROM pairs p WHERE p.session = w.session AND p.word_idx = w.word_idx AND p.o = b.o) END AS assigned_seg
  FROM words w LEFT JOIN best b ON w.session = b.session AND w.word_idx = b.word_idx)
SELECT c.session, c.word_idx, c.assigned_seg, m.speaker AS assigned FROM chosen c LEFT JOIN moved m ON c.session = m.session AND c.assigned_seg = m.seg_idx""")  # fmt: skip
def j1(spark, d):
    return J.assign_by_overlap(S.words(spark, d), S.shifted(spark, d)).select("session", "word_idx", "assigned_seg", "assigned")


@query("J2_midpoint_asof", f"""{HW}, moved AS (SELECT session, seg_idx, speaker, t0 + CAST(0.4 AS DOUBLE) AS t0, t1 + CAST(0.4 AS DOUBLE) AS t1 FROM seg),
pts AS (SELECT session, word_idx, (t0 + t1) / 2 AS t FROM words)
SELECT p.session, p.word_idx, CASE WHEN p.t <= m.t1 + 1e-6 THEN m.speaker END AS speaker FROM pts p ASOF LEFT JOIN (SELECT *, t0 - 1e-6 AS a FROM moved) m ON p.session = m.session AND p.t >= m.a""")  # fmt: skip
def j2(spark, d):
    return J.last_containing(S.words(spark, d), S.shifted(spark, d)).select("session", "word_idx", "speaker")


@query("J3_chunk_frame_mean", f"""{HF}{CHUNKS} SELECT c.session, c.chunk_idx, round(coalesce(avg(f.vad), 0), 6) AS score
  FROM chunks c LEFT JOIN frames f ON f.session = c.session AND f.t >= c.t0 AND f.t < c.t1 GROUP BY 1, 2""")  # fmt: skip
def j3(spark, d):
    return rounded(J.chunk_means(S.chunks(spark, d), S.frames(spark, d), HZ).select("session", "chunk_idx", "score"), "score")


@query("J4_word_cost_paint", f"""{HWF} SELECT f.session, f.i, round(coalesce(1 - least(greatest(coalesce(arg_max(coalesce(w.prob, 0.8), w.word_idx), 0), 0), 1), 1), 6) AS cost
  FROM frames f LEFT JOIN words w ON f.session = w.session AND f.t BETWEEN w.t0 AND w.t1 WHERE w.word_idx IS NOT NULL OR w.session IS NULL GROUP BY 1, 2""")  # fmt: skip
def j4(spark, d):
    return rounded(J.word_costs(S.words(spark, d), S.frames(spark, d), HZ), "cost")


@query("J5_lexical_scale", f"""{HWF}, ends AS (SELECT session, t1 AS a, t1 + CAST(0.3 AS DOUBLE) AS b, CASE WHEN word LIKE '%?' THEN 0.5 ELSE 0.7 END AS s FROM words WHERE word LIKE '%?' OR word LIKE '%.')
SELECT f.session, f.i, CAST(coalesce(min(e.s), 1) AS DOUBLE) AS scale FROM frames f LEFT JOIN ends e ON f.session = e.session AND f.t BETWEEN e.a AND e.b GROUP BY 1, 2""")  # fmt: skip
def j5(spark, d):
    return J.lexical_scales(S.words(spark, d), S.frames(spark, d), HZ, question=0.5, full_stop=0.7)


@query("J6_nearest", f"""{HWF}, pts AS (SELECT session, word_idx, (t0 + t1) / 2 AS t FROM words),
c AS (SELECT p.session, p.word_idx, f.i, abs(p.t - f.t) AS d FROM pts p JOIN frames f ON p.session = f.session AND f.t BETWEEN p.t - 1 AND p.t + 1)
SELECT session, word_idx, arg_min(i, struct_pack(d := d, i := i)) AS nearest FROM c GROUP BY 1, 2""")  # fmt: skip
def j6(spark, d):
    points = S.words(spark, d).select("session", "word_idx", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
    known = S.frames(spark, d).select("session", "t", F.col("i").alias("idx"))
    found = J.nearest(points, known).where(F.col("nearest").isNotNull() & (F.abs(F.col("t") - F.col("nearest") / HZ) <= 1))
    return found.select("session", "word_idx", "nearest")


@query("J7_asof_label", f"""{HS} SELECT g.session, g.i, coalesce(s.label, 'UNKNOWN') AS label FROM (SELECT session, i, a - 1 + i * CAST(0.5 AS DOUBLE) AS t FROM (SELECT session, min(t) AS a, unnest(range(40)) AS i FROM sig GROUP BY 1)) g
  ASOF LEFT JOIN (SELECT session, t, arg_max(label, idx) AS label FROM sig GROUP BY 1, 2) s ON g.session = s.session AND g.t >= s.t""")  # fmt: skip
def j7(spark, d):
    s = S.signal(spark, d)
    grid = s.groupBy("session").agg(F.min("t").alias("a")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))))
    points = grid.select("session", "i", (F.col("a") - 1 + F.col("i") * 0.5).alias("t"))
    return J.as_of(points, s.select("session", "t", "idx", "label"), "label", "UNKNOWN").select("session", "i", "label")


@query("J8_interp", f"""{HS}, g AS (SELECT session, i, a - 1 + i * CAST(0.5 AS DOUBLE) AS t FROM (SELECT session, min(t) AS a, unnest(range(40)) AS i FROM sig GROUP BY 1)),
lo AS (SELECT g.session, g.i, g.t, b.t AS bt, b.p AS bp FROM g ASOF LEFT JOIN (SELECT session, t, arg_max(p, idx) AS p FROM sig GROUP BY 1, 2) b ON g.session = b.session AND g.t >= b.t),
hi AS (SELECT g.session, g.i, a.t AS nt, a.p AS ap FROM g ASOF LEFT JOIN (SELECT session, t, arg_min(p, idx) AS p FROM sig GROUP BY 1, 2) a ON g.session = a.session AND g.t <= a.t)
SELECT lo.session, lo.i, round(CASE WHEN bt IS NULL THEN ap WHEN nt IS NULL OR nt = bt THEN bp ELSE bp + (ap - bp) * (t - bt) / (nt - bt) END, 6) AS p FROM lo JOIN hi USING (session, i)""")  # fmt: skip
def j8(spark, d):
    s = S.signal(spark, d)
    grid = s.groupBy("session").agg(F.min("t").alias("a")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))))
    points = grid.select("session", "i", (F.col("a") - 1 + F.col("i") * 0.5).alias("t"))
    return rounded(J.interpolated(points, s.select("session", "t", "idx", "p"), "p").select("session", "i", "p"), "p")


@query("J9_frame_paint", f"""{HF} SELECT f.session, f.i, coalesce(max(s.seg_idx), -1) AS painted FROM frames f LEFT JOIN (SELECT session, seg_idx, t0 + CAST(0.4 AS DOUBLE) AS t0, t1 + CAST(0.4 AS DOUBLE) AS t1 FROM seg) s
  ON f.session = s.session AND f.i >= floor(s.t0 * 2) AND f.i < ceil(s.t1 * 2) GROUP BY 1, 2""")  # fmt: skip
def j9(spark, d):
    return J.paint(S.shifted(spark, d), S.frames(spark, d), HZ)


IV = ", iv AS (SELECT session, seg_idx AS iv, t0, t1 FROM seg WHERE speaker = 'assistant'), ev AS (SELECT session, word_idx AS event_id, t0 AS t, speaker FROM words WHERE regexp_matches(word, '[.?]$'))"


def _events(spark, d):
    """Words that end a sentence."""
    return S.words(spark, d).where(F.col("word").rlike("[.?]$")).select("session", F.col("word_idx").alias("event_id"), F.col("t0").alias("t"), "speaker")


def _intervals(spark, d):
    """The assistant's segments."""
    return S.segments(spark, d).where("speaker = 'assistant'").select("session", F.col("seg_idx").alias("iv"), "t0", "t1")


@query("J11_event_semi", f"{HW}{IV} SELECT session, event_id, round(t, 6) AS t FROM ev WHERE EXISTS (SELECT 1 FROM iv WHERE iv.session = ev.session AND ev.t BETWEEN iv.t0 - 0.25 AND iv.t1 + 0.25)")
def j11(spark, d):
    return rounded(J.inside(_events(spark, d), _intervals(spark, d), 0.25).select("session", "event_id", "t"), "t")


@query("J11_event_anti", f"{HW}{IV} SELECT session, event_id, round(t, 6) AS t FROM ev WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.session = ev.session AND ev.t BETWEEN iv.t0 - 0.25 AND iv.t1 + 0.25)")
def j11b(spark, d):
    return rounded(J.inside(_events(spark, d), _intervals(spark, d), 0.25, anti=True).select("session", "event_id", "t"), "t")


@query("J12_interval_hits", f"{HW}{IV} SELECT session, iv, round(t1 - t0, 6) AS seconds FROM iv WHERE EXISTS (SELECT 1 FROM ev WHERE iv.session = ev.session AND ev.t BETWEEN iv.t0 AND iv.t1)")
def j12(spark, d):
    hit = J.hit_intervals(_intervals(spark, d), _events(spark, d))
    return hit.select("session", "iv", r6(F.col("t1") - F.col("t0")).alias("seconds"))


@query("J13_next_event", f"""{HS} SELECT a.session, a.event_id AS seed, arg_min(b.event_id, struct_pack(t := b.t, e := b.event_id)) AS target, round(min(b.t) - any_value(a.t), 6) AS delay
  FROM sig a JOIN sig b ON a.session = b.session AND b.t > a.t AND b.t <= a.t + 2 AND a.k = b.k WHERE a.p >= 0.5 GROUP BY 1, 2""")  # fmt: skip
def j13(spark, d):
    s = S.signal(spark, d)
    return rounded(J.next_within(s.where("p >= 0.5"), s, 2.0, ("k", "k")), "delay")


@query("J14_words_near", f"""{HW}{IV}, n AS (SELECT e.session, e.event_id, w.word_idx, w.word, row_number() OVER (PARTITION BY e.session, e.event_id ORDER BY w.word_idx) AS r
  FROM ev e JOIN words w ON e.session = w.session AND w.t0 <= e.t + 1.5 AND w.t1 >= e.t - 1.5)
SELECT session, event_id, string_agg(word, ' ' ORDER BY word_idx) AS words FROM n WHERE r <= 20 GROUP BY 1, 2""")  # fmt: skip
def j14(spark, d):
    return J.words_near(_events(spark, d), S.words(spark, d))


@query("J15_segment_text", f"""{HW}, moved AS (SELECT session, seg_idx, t0 + CAST(0.4 AS DOUBLE) AS t0, t1 + CAST(0.4 AS DOUBLE) AS t1 FROM seg)
SELECT m.session, m.seg_idx, coalesce(string_agg(w.word, '' ORDER BY w.word_idx), '') AS joined FROM moved m LEFT JOIN words w ON m.session = w.session AND w.t0 >= m.t0 AND w.t0 < m.t1 GROUP BY 1, 2""")  # fmt: skip
def j15(spark, d):
    return J.text_by_start(S.shifted(spark, d), S.words(spark, d)).select("session", "seg_idx", "joined")


@query("J16_overlap_text", f"""{HW}, moved AS (SELECT session, seg_idx, t0 + CAST(0.4 AS DOUBLE) AS t0, t1 + CAST(0.4 AS DOUBLE) AS t1 FROM seg)
SELECT m.session, m.seg_idx, string_agg(w.word, ' ' ORDER BY w.word_idx) AS joined FROM moved m JOIN words w ON m.session = w.session AND w.t0 < m.t1 AND w.t1 > m.t0 GROUP BY 1, 2""")  # fmt: skip
def j16(spark, d):
    return J.text_by_overlap(S.shifted(spark, d), S.words(spark, d)).select("session", "seg_idx", "joined")


@query("P8_excerpt", f"{H} SELECT session, seg_idx, speaker FROM seg WHERE NOT (t1 < 10 OR t0 > 25)")
def p8(spark, d):
    return S.segments(spark, d).where("NOT (t1 < 10 OR t0 > 25)").select("session", "seg_idx", "speaker")


@query("Z1_clamp_to_words", f"""{HW}, b AS (SELECT session, min(t0) AS a, max(t1) AS b FROM words GROUP BY 1)
SELECT m.session, m.seg_idx, round(greatest(m.t0 + CAST(0.4 AS DOUBLE), b.a), 6) AS t0, round(least(m.t1 + CAST(0.4 AS DOUBLE), b.b), 6) AS t1 FROM seg m JOIN b USING (session)
WHERE least(m.t1 + CAST(0.4 AS DOUBLE), b.b) > greatest(m.t0 + CAST(0.4 AS DOUBLE), b.a)""")  # fmt: skip
def z1(spark, d):
    return rounded(J.clamp_to_words(S.shifted(spark, d), S.words(spark, d)).select("session", "seg_idx", "t0", "t1"), "t0", "t1")


TOP = ", top AS (SELECT *, list_position(p, list_max(p)) - 1 AS path FROM frames)"
RUNS = ", flagged AS (SELECT *, CAST(coalesce(lag(path) OVER (PARTITION BY session ORDER BY i) <> path, TRUE) AS INTEGER) AS new FROM top), run AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY i) AS BIGINT) AS run FROM flagged)"


def tops(spark, d):
    return S.frames(spark, d).withColumn("path", argmax(F.col("p")))


@query("W1_rle", f"{HF}{TOP}{RUNS} SELECT session, run, CAST(any_value(path) AS INTEGER) AS path, min(i) AS first, max(i) AS last, count(*) AS n FROM run GROUP BY 1, 2")
def w1(spark, d):
    return W.runs(tops(spark, d), "path")


@query("W2_switches", f"{HF}{TOP} SELECT session, i, t, CAST(old AS INTEGER) AS old, CAST(path AS INTEGER) AS new FROM (SELECT *, lag(path) OVER (PARTITION BY session ORDER BY i) AS old FROM top) WHERE old <> path")
def w2(spark, d):
    return W.switches(tops(spark, d), "path")


SIGRUNS = """, m AS (SELECT *, p {op} 0.5 AS hit, coalesce(lead(t) OVER (PARTITION BY session ORDER BY t, idx), t) AS nx FROM sig),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY t, idx) AS BIGINT) AS run FROM (SELECT *, CAST(coalesce(lag(hit) OVER (PARTITION BY session ORDER BY t, idx) <> hit, TRUE) AS INTEGER) AS new FROM m))"""


@query("W3_threshold_intervals", f"{HS}{SIGRUNS.format(op='>=')} SELECT session, run, round(min(t), 6) AS t0, round(max(nx), 6) AS t1 FROM r WHERE hit GROUP BY 1, 2 HAVING max(nx) - min(t) >= 1")
def w3(spark, d):
    return rounded(W.above(S.signal(spark, d), "p", 0.5, least=1.0), "t0", "t1")


@query("W3b_threshold_index", f"{HS}{SIGRUNS.format(op='>')} SELECT session, min(idx) AS first, max(idx) + 1 AS stop FROM r WHERE hit GROUP BY session, run")
def w3b(spark, d):
    return W.above_index(S.signal(spark, d), "p", 0.5)


GRID = """, g AS (SELECT session, i, i / CAST(2 AS DOUBLE) AS t, CASE WHEN list_position(p, list_max(p)) = 1 THEN 'HOST' ELSE 'GUEST' END AS gold,
  CASE WHEN vad >= 0.4 THEN 'HOST' ELSE 'GUEST' END AS pred FROM frames)"""


def role_grid(spark, d):
    f = tops(spark, d)
    return f.select("session", "i", "t", F.when(F.col("path") == 0, "HOST").otherwise("GUEST").alias("gold"), F.when(F.col("vad") >= 0.4, "HOST").otherwise("GUEST").alias("pred"))


@query("W4_error_intervals", f"""{HF}{GRID}, m AS (SELECT *, gold = 'GUEST' AND pred = 'HOST' AS hit, coalesce(lead(t) OVER (PARTITION BY session ORDER BY i), t + 0.5) AS nx FROM g),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(coalesce(lag(hit) OVER (PARTITION BY session ORDER BY i) <> hit, TRUE) AS INTEGER) AS new FROM m))
SELECT session, min(t) AS t0, max(nx) AS t1 FROM r WHERE hit GROUP BY session, run HAVING max(nx) - min(t) >= 1""")  # fmt: skip
def w4(spark, d):
    return W.error_intervals(role_grid(spark, d), "gold", "pred", ("GUEST", "HOST"), 0.5, least=1.0)


@query("W5_interval_merge", f"""{HS}, s AS (SELECT session, t AS t0, t + value / CAST(40 AS DOUBLE) AS t1 FROM sig WHERE value > 0),
m AS (SELECT *, CAST(coalesce(t0 > max(t1) OVER (PARTITION BY session ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS INTEGER) AS new FROM s WHERE t1 > t0),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT session, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1 FROM r GROUP BY session, run""")  # fmt: skip
def w5(spark, d):
    s = S.signal(spark, d).where("value > 0").select("session", F.col("t").alias("t0"), (F.col("t") + F.col("value") / 40.0).alias("t1"))
    return rounded(W.merged(s), "t0", "t1")


HOSTS = ", two AS (SELECT session, seg_idx, CASE WHEN (seg_idx // 2) % 2 = 0 THEN 'A' ELSE 'B' END AS speaker, t0, t1 FROM seg)"


def paired(spark, d):
    """Segments of two speakers that take two turns each."""
    return S.segments(spark, d).withColumn("speaker", F.when(F.floor(F.col("seg_idx") / 2) % 2 == 0, "A").otherwise("B"))


@query("W6_timeline_merge", f"""{H}{HOSTS}, m AS (SELECT *, CAST(coalesce(NOT (speaker = lag(speaker) OVER w AND t0 - lag(t1) OVER w >= 0 AND t0 - lag(t1) OVER w <= 0.3), TRUE) AS INTEGER) AS new FROM two WINDOW w AS (PARTITION BY session ORDER BY t0, seg_idx)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY t0, seg_idx) AS BIGINT) AS run FROM m)
SELECT session, run, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(speaker) AS speaker, count(*) AS parts FROM r GROUP BY 1, 2""")  # fmt: skip
def w6(spark, d):
    return rounded(W.merged_timeline(paired(spark, d)), "t0", "t1")


@query("W6b_turn_merge", f"""{H}{HOSTS}, m AS (SELECT *, CAST(coalesce(NOT (speaker = lag(speaker) OVER w AND t0 - lag(t1) OVER w <= 1.5), TRUE) AS INTEGER) AS new FROM two WINDOW w AS (PARTITION BY session ORDER BY t0, seg_idx)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY t0, seg_idx) AS BIGINT) AS run FROM m)
SELECT session, run, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(speaker) AS speaker FROM r GROUP BY 1, 2 HAVING max(t1) - min(t0) >= 12""")  # fmt: skip
def w6b(spark, d):
    return rounded(W.merged_turns(paired(spark, d), least=12.0), "t0", "t1")


@query("W7a_islands", f"""{HF}{TOP}{RUNS}, sp AS (SELECT session, run, any_value(path) AS own, min(t) AS a, max(t) AS b FROM run GROUP BY 1, 2),
fx AS (SELECT session, run, CASE WHEN lag(own) OVER w = lead(own) OVER w AND b - a <= 1 THEN lag(own) OVER w ELSE own END AS smoothed FROM sp WINDOW w AS (PARTITION BY session ORDER BY run))
SELECT r.session, r.i, CAST(r.path AS INTEGER) AS path, CAST(f.smoothed AS INTEGER) AS smoothed FROM run r JOIN fx f USING (session, run)""")  # fmt: skip
def w7a(spark, d):
    return W.smoothed_islands(tops(spark, d), "path").select("session", "i", "path", "smoothed")


@query("W9_since_onset", f"""{HF}, m AS (SELECT *, vad >= 0.35 AS sp FROM frames), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(coalesce(lag(sp) OVER (PARTITION BY session ORDER BY i) <> sp, TRUE) AS INTEGER) AS new FROM m))
SELECT session, i, CASE WHEN sp THEN 0.5 * (row_number() OVER (PARTITION BY session, run ORDER BY i) - 1) ELSE -1 END::DOUBLE AS since, CASE WHEN sp THEN 0.5 * (row_number() OVER (PARTITION BY session, run ORDER BY i DESC) - 1) ELSE -1 END::DOUBLE AS until FROM r
WHERE session IN (SELECT session FROM frames GROUP BY 1 HAVING count(*) > 1)""")  # fmt: skip
def w9(spark, d):
    f = W.onset_distances(S.frames(spark, d), F.col("vad") >= 0.35)
    n = S.frames(spark, d).groupBy("session").count().where("count > 1")
    finite = lambda c: F.when(F.col(c) == float("inf"), -1.0).otherwise(F.col(c))
    return f.join(n, "session", "left_semi").select("session", "i", finite("since").alias("since"), finite("until").alias("until"))


@query("W11_smooth", f"""{HF}, o AS (SELECT f.session, f.i, unnest([-2, -1, 0, 1, 2]) AS o, n FROM frames f JOIN (SELECT session, max(i) AS n FROM frames GROUP BY 1) USING (session))
SELECT o.session, o.i, round(avg(f.vad), 6) AS smooth FROM o JOIN frames f ON f.session = o.session AND f.i = least(greatest(o.i + o.o, 0), o.n) GROUP BY 1, 2""")  # fmt: skip
def w11(spark, d):
    return rounded(W.moving_average(S.frames(spark, d), "vad", 5, "repeat").select("session", "i", "smooth"), "smooth")


@query("F5_vad_sharpen", f"""{HF} SELECT session, i, round(1 / (1 + exp(-5 * (sum(vad) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 - 0.5))), 6) AS sharp FROM frames
  WHERE session IN (SELECT session FROM frames GROUP BY 1 HAVING count(*) >= 7)""")  # fmt: skip
def f5(spark, d):
    f = S.frames(spark, d)
    n = f.groupBy("session").count().where("count >= 7")
    s = W.moving_average(f.join(n, "session", "left_semi"), "vad", 7, "zero", "m")
    return s.select("session", "i", r6(1 / (1 + F.exp(-5 * (F.col("m") - 0.5)))).alias("sharp"))


CP = """, pq AS (SELECT *, lag(p) OVER (PARTITION BY session ORDER BY i) AS q FROM frames),
dd AS (SELECT *, CASE WHEN q IS NULL THEN 0 ELSE 1 - list_dot_product(p, q) / greatest(sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(q, q)), 1e-12) END AS d FROM pq),
sm AS (SELECT *, sum(d) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS s FROM dd),
qs AS (SELECT session, quantile_cont(s, 0.05) AS lo, quantile_cont(s, 0.95) AS hi FROM sm GROUP BY 1),
cp AS (SELECT sm.*, CASE WHEN hi - lo <= 1e-9 THEN 0 ELSE least(1, greatest(0, (s - lo) / (hi - lo))) END AS cp FROM sm JOIN qs USING (session))"""


@query("W13_change_point", f"{HF}{CP} SELECT session, i, round(cp, 6) AS cp FROM cp")
def w13(spark, d):
    return rounded(W.change_scores(S.frames(spark, d)).select("session", "i", "cp"), "cp")


@query("W14_peaks", f"""{HF}, n AS (SELECT *, lag(vad) OVER w AS b, lead(vad) OVER w AS a FROM frames WINDOW w AS (PARTITION BY session ORDER BY i)),
k AS (SELECT session, i, vad, row_number() OVER (PARTITION BY session ORDER BY vad DESC, i) AS rank FROM n WHERE vad >= 0.8 AND vad > b AND vad >= a) SELECT session, i, vad, rank FROM k WHERE rank <= 10""")  # fmt: skip
def w14(spark, d):
    return W.peaks(S.frames(spark, d), "vad", 0.8, 10).select("session", "i", "vad", F.col("rank").cast("long").alias("rank"))


@query("O6_event_union", f"""{HF}{TOP}, sw AS (SELECT session, i, 'switch' AS kind FROM (SELECT *, lag(path) OVER (PARTITION BY session ORDER BY i) AS old FROM top) WHERE old <> path),
pk AS (SELECT session, i, 'cp_peak' AS kind FROM (SELECT *, lag(vad) OVER w AS b, lead(vad) OVER w AS a FROM frames WINDOW w AS (PARTITION BY session ORDER BY i)) WHERE vad >= 0.8 AND vad > b AND vad >= a QUALIFY row_number() OVER (PARTITION BY session ORDER BY vad DESC, i) <= 10),
u AS (SELECT * FROM sw UNION ALL SELECT * FROM pk WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.session = pk.session AND sw.i = pk.i))
SELECT session, i, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) AS rank FROM u) WHERE rank <= 30""")  # fmt: skip
def o6(spark, d):
    sw = W.switches(tops(spark, d), "path").select("session", "i", F.lit("switch").alias("kind"))
    pk = W.peaks(S.frames(spark, d), "vad", 0.8, 10).select("session", "i", F.lit("cp_peak").alias("kind"))
    return W.events_with_precedence(sw, pk, 30).withColumn("rank", F.col("rank").cast("long"))


@query("W15_switch_zones", f"""{H}{HOSTS}, en AS (SELECT session, max(t1) AS e FROM two GROUP BY 1),
wn AS (SELECT session, k, k * CAST(10 AS DOUBLE) AS a, least(k * CAST(10 AS DOUBLE) + 30, e) AS b FROM (SELECT session, e, unnest(range(CAST(greatest(ceil(e / 10), 1) AS BIGINT))) AS k FROM en)),
ht AS (SELECT w.*, s.seg_idx, s.speaker, s.t0, least(s.t1, w.b) - greatest(s.t0, w.a) AS d FROM wn w JOIN two s ON w.session = s.session AND least(s.t1, w.b) - greatest(s.t0, w.a) > 0),
h2 AS (SELECT *, CAST(coalesce(speaker <> lag(speaker) OVER (PARTITION BY session, k ORDER BY t0, seg_idx), FALSE) AS INTEGER) AS s FROM ht),
ea AS (SELECT session, k, a, b, speaker, sum(d) AS d, sum(s) AS s FROM h2 GROUP BY 1, 2, 3, 4, 5),
zn AS (SELECT session, k, a, b, sum(d) AS total, sum(s) AS sw, max(struct_pack(d := round(d, 9), speaker := speaker)) AS top FROM ea GROUP BY 1, 2, 3, 4),
ch AS (SELECT session, a AS t0, b AS t1, top.speaker AS speaker FROM zn WHERE total >= 15 AND top.d / total >= 0.5 AND sw / (b - a) >= 0.03),
m AS (SELECT *, CAST(coalesce(NOT (speaker = lag(speaker) OVER w AND t0 <= lag(t1) OVER w), TRUE) AS INTEGER) AS new FROM ch WINDOW w AS (PARTITION BY session ORDER BY t0)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY t0) AS BIGINT) AS zone FROM m)
SELECT session, zone, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, any_value(speaker) AS speaker FROM r GROUP BY 1, 2""")  # fmt: skip
def w15(spark, d):
    return rounded(W.switch_zones(paired(spark, d), majority=0.5, density=0.03, least=15.0), "t0", "t1")


@query("W17_silence", f"""{HF}, m AS (SELECT *, vad < 0.5 AS low FROM frames), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(coalesce(lag(low) OVER (PARTITION BY session ORDER BY i) <> low, TRUE) AS INTEGER) AS new FROM m)),
s AS (SELECT session, run, any_value(low) AS low, min(t) AS t0 FROM r GROUP BY 1, 2), n AS (SELECT *, lead(t0) OVER (PARTITION BY session ORDER BY run) AS t1 FROM s)
SELECT session, t0, t1 FROM n WHERE low AND t1 - t0 >= 1""")  # fmt: skip
def w17(spark, d):
    return W.silences(S.frames(spark, d), 0.5, 1.0)


TAIL = """, ds AS (SELECT session, lead(t0) OVER (PARTITION BY session ORDER BY t0, seg_idx) - t0 AS d FROM seg),
tl AS (SELECT session, CASE WHEN n < 2 THEN 1 ELSE least(15, greatest(1, coalesce(g[len(g) // 2 + 1], 1))) END AS tail FROM (SELECT session, count(*) AS n, coalesce(list_sort(list(d) FILTER (d > 0)), []) AS g FROM ds GROUP BY 1))"""


@query("A25_tail_margin", f"{H}{TAIL} SELECT session, round(tail, 6) AS tail FROM tl")
def a25(spark, d):
    return rounded(A.tail_margin(S.segments(spark, d)), "tail")


@query("W23_label_grid", f"""{H}{TAIL}, sp AS (SELECT session, min(t0) AS a, max(t0) AS b FROM seg GROUP BY 1)
SELECT session, i, round(a + i / CAST(2 AS DOUBLE), 6) AS t FROM (SELECT session, a, unnest(range(CAST(ceil(round((b + tail - a) * 2, 9)) AS BIGINT))) AS i FROM sp JOIN tl USING (session))""")  # fmt: skip
def w23(spark, d):
    s = S.segments(spark, d)
    return rounded(W.label_grid(s, A.tail_margin(s), 2.0), "t")


@query("W25_early_end", f"""{H}, du AS (SELECT session, max(t1) * CASE WHEN session % 3 = 0 THEN 1.5 ELSE 1 END AS duration, max(t1) AS e FROM seg GROUP BY 1)
SELECT s.session, round(s.t0, 6) AS t0, round(s.t1, 6) AS t1, s.speaker FROM seg s JOIN du USING (session) WHERE e >= 0.9 * duration
UNION ALL SELECT session, 0, round(duration, 6), 'SPEAKER_00' FROM du WHERE e < 0.9 * duration""")  # fmt: skip
def w25(spark, d):
    du = S.durations(spark, d).withColumn("duration", F.col("duration") * F.when(F.col("session") % 3 == 0, 1.5).otherwise(1.0))
    return rounded(W.guarded_end(S.segments(spark, d), du), "t0", "t1")


@query("W22_stuck_candidates", f"""{HF}{TOP}, pa AS (SELECT session, i, t, p, CAST((i // 5) % 3 AS INTEGER) AS path, CAST(path AS INTEGER) AS top, list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS mg FROM top),
sw AS (SELECT * FROM (SELECT session, i, t, lag(path) OVER (PARTITION BY session ORDER BY i) AS old, path AS new FROM pa) WHERE old <> new),
c AS (SELECT s.session, s.i, s.t, f.i AS j, f.t AS tj, f.mg FROM sw s JOIN pa f ON f.session = s.session AND f.t < s.t AND f.t >= s.t - 1 WHERE f.path = s.old AND f.top = s.new AND f.mg >= 0.05)
SELECT session, i, j, round(mg, 6) AS margin, t - tj AS delay FROM c QUALIFY row_number() OVER (PARTITION BY session, i ORDER BY mg DESC, j) = 1""")  # fmt: skip
def w22(spark, d):
    f = tops(spark, d).select("session", "i", "t", (F.floor(F.col("i") / 5) % 3).cast("int").alias("path"), F.col("path").alias("top"), margin(F.col("p")).alias("margin"))
    return rounded(W.stuck_candidates(W.switches(f, "path"), f, 1.0, 0.05), "margin")
