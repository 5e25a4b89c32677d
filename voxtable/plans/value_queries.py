"""Aggregations, scalar functions, vectors, top-k and set operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import vectors as V
from ..functions.numbers import r6
from ..operators import aggregates as A
from ..operators import sequences as W
from ..operators import similarity as M
from ..operators import tables as B
from . import standins as S
from .registry import query
from .standins import DUR, FRAMES, HZ, SEG, SIG, VEC, WORDS
from .timeline_queries import GRID, H, HF, HS, HW, TOP, role_grid, rounded, tops

HV = f"WITH {VEC}"
ACOS = ", sp AS (SELECT session, speaker, sum(t1 - t0) AS seconds, count(*) AS segments, min(t0) AS first_seen FROM seg WHERE t1 > t0 AND speaker IS NOT NULL GROUP BY 1, 2)"


@query("A1_speaker_stats", f"{H}{ACOS} SELECT session, speaker, round(seconds, 6) AS seconds, segments, round(first_seen, 6) AS first_seen FROM sp")
def a1(spark, d):
    return rounded(A.speaker_stats(S.segments(spark, d)), "seconds", "first_seen")


@query("A2_effective_speakers", f"""{H}{ACOS}, r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(seconds) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(seconds) OVER (PARTITION BY session) AS b FROM sp WINDOW w AS (PARTITION BY session ORDER BY round(seconds, 9) DESC, first_seen, speaker))
SELECT session, speaker, round(seconds, 6) AS seconds, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8 AND (b < 0.8 OR rank <= 1)""")  # fmt: skip
def a2(spark, d):
    found = A.effective_speakers(A.speaker_stats(S.segments(spark, d)), coverage=0.8)
    return rounded(found.select("session", "speaker", "seconds", "rank"), "seconds")


@query("A3_coverage", f"""WITH {WORDS}{DUR} SELECT d.session, round(CASE WHEN duration <= 0.1 THEN 0 ELSE coalesce((b - a) / duration, 0) END, 6) AS coverage FROM dur d LEFT JOIN (SELECT session, min(t0) AS a, max(t1) AS b FROM words GROUP BY 1) USING (session)""")
def a3(spark, d):
    return rounded(A.coverage(S.words(spark, d), S.durations(spark, d)), "coverage")


@query("A3_speech_ratio", f"{HF} SELECT session, round(avg(CAST(vad > 0.5 AS INTEGER)), 6) AS speech_ratio FROM frames GROUP BY 1")
def a3b(spark, d):
    return rounded(A.speech_ratio(S.frames(spark, d)), "speech_ratio")


ENT = "-list_sum([x * ln(greatest(x, 1e-12)) for x in p])"


@query("A4_posterior_stats", f"""{HF}{TOP} SELECT session, round(avg(m), 6) AS mean_max, round(avg(e), 6) AS mean_entropy, CAST(sum(s) AS BIGINT) AS switches FROM (
  SELECT session, list_max(p) AS m, {ENT} AS e, CAST(coalesce(path <> lag(path) OVER (PARTITION BY session ORDER BY i), FALSE) AS INTEGER) AS s FROM top) GROUP BY 1""")  # fmt: skip
def a4(spark, d):
    return rounded(A.posterior_stats(S.frames(spark, d)), "mean_max", "mean_entropy")


@query("A5_cluster_mass", f"{HV} SELECT session, label, n, round(n / sum(n) OVER (PARTITION BY session), 6) AS mass FROM (SELECT session, label, count(*) AS n FROM vec GROUP BY 1, 2)")
def a5(spark, d):
    return rounded(A.mass_fractions(S.vectors(spark, d)), "mass")


@query("A6_segment_confidence", f"""{HF}, la AS (SELECT session, max(i) AS l FROM frames GROUP BY 1), sp AS (SELECT session, seg_idx, CASE speaker WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS k,
  least(ceil(t0 * 2), l) AS a, greatest(least(ceil(t1 * 2) - 1, l), least(ceil(t0 * 2), l)) AS b FROM seg JOIN la USING (session))
SELECT s.session, s.seg_idx, round(avg(f.p[s.k]), 6) AS confidence FROM sp s JOIN frames f ON f.session = s.session AND f.i BETWEEN s.a AND s.b GROUP BY 1, 2""")  # fmt: skip
def a6(spark, d):
    index = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2)
    return rounded(A.segment_confidence(S.segments(spark, d), S.frames(spark, d), HZ, index), "confidence")


@query("A7_confusion", f"{HF}{GRID} SELECT gold, pred, count(*) * 0.5::DOUBLE AS seconds FROM g GROUP BY 1, 2")
def a7(spark, d):
    return A.confusion(role_grid(spark, d), "gold", "pred", 0.5)


@query("A8_best_mapping", f"""{HS}, pr AS (SELECT label, CASE WHEN label IN ('click', 'view') OR k = 0 THEN 1 ELSE 0 END AS gold, count(*) AS s FROM sig GROUP BY 1, 2),
pl AS (SELECT label, sum(CASE WHEN gold = 1 THEN s ELSE 0 END) AS one, sum(CASE WHEN gold = 0 THEN s ELSE 0 END) AS zero, row_number() OVER (ORDER BY label) - 1 AS b FROM pr GROUP BY 1),
mk AS (SELECT unnest(range(1, (SELECT (1 << count(*)) - 1 FROM pl))) AS mask),
sc AS (SELECT mask, sum(CASE WHEN (mask >> b) & 1 = 1 THEN one ELSE zero END) / (SELECT sum(one + zero) FROM pl) AS accuracy FROM mk, pl GROUP BY 1)
SELECT CAST(mask AS BIGINT) AS mask, round(accuracy, 6) AS accuracy FROM sc ORDER BY round(accuracy, 12) DESC, mask LIMIT 1""")  # fmt: skip
def a8(spark, d):
    gold = F.when(F.col("label").isin("click", "view") | (F.col("k") == 0), 1).otherwise(0)
    pairs = S.signal(spark, d).groupBy("label", gold.alias("gold")).agg(F.count("*").cast("double").alias("seconds"))
    return rounded(A.best_mapping(pairs).drop("labels"), "accuracy")


@query("A10_two_way_accuracy", f"{HF}{GRID} SELECT round(greatest(avg(CAST(gold = pred AS INTEGER)), avg(CAST(gold <> pred AS INTEGER))), 6) AS accuracy FROM g")
def a10(spark, d):
    g = role_grid(spark, d)
    same = F.avg((F.col("gold") == F.col("pred")).cast("double"))
    return g.agg(r6(F.greatest(same, 1 - same)).alias("accuracy"))


@query("A11_role_accuracy", f"{HF}{GRID} SELECT gold, CAST(sum(CAST(gold = pred AS INTEGER)) AS BIGINT) AS correct, count(*) AS total, round(avg(CAST(gold = pred AS INTEGER)), 6) AS accuracy FROM g GROUP BY 1")
def a11(spark, d):
    return rounded(A.role_accuracy(role_grid(spark, d), "gold", "pred"), "accuracy")


QS = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100):02d}" for q in A.QUANTILES)


@query("A12_quantiles", f"{HS} SELECT label, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, {QS} FROM sig GROUP BY 1")
def a12(spark, d):
    s = A.summary(S.signal(spark, d), "value", ("label",))
    return rounded(s, *[c for c in s.columns if c not in ("label", "n")])


@query("A13_histogram", f"""{HS} SELECT bin, count(value) AS n FROM (SELECT CAST(unnest(range(-1, 11)) AS INTEGER) AS bin) LEFT JOIN (SELECT value, CASE WHEN value < 0 THEN -1 WHEN value > 200 THEN 10 ELSE least(CAST(floor(value / 20) AS INTEGER), 9) END AS b FROM sig) ON b = bin GROUP BY 1""")
def a13(spark, d):
    return A.histogram(S.signal(spark, d), "value", 20.0, 10)


TERMS = ", tm AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE p - 0.5 END AS vad, CAST((event_id * 31 + session) % 200 AS DOUBLE) / CAST(100 AS DOUBLE) - 1 AS spk, CAST((event_id * 17) % 90 AS DOUBLE) / CAST(100 AS DOUBLE) AS word, CAST((event_id * 13) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS cp FROM sig)"
TERM_NAMES = ["vad", "spk", "word"]


def terms(spark, d):
    """Events with made-up cost terms and change-point scores."""
    s, e = S.signal(spark, d), F.col("event_id")
    part = lambda x, n: (x % n).cast("double") / 100.0
    return s.withColumns({
        "vad": F.when(e % 7 != 0, F.col("p") - 0.5), "spk": part(e * 31 + F.col("session"), 200) - 1, "word": part(e * 17, 90), "cp": part(e * 13, 101),
    })


@query("A14_cp_buckets", f"""{HS}{TERMS} SELECT bucket, count(*) AS n, round(avg(vad), 6) AS vad, round(avg(spk), 6) AS spk, round(avg(word), 6) AS word FROM (SELECT *, CASE WHEN cp >= 0.9 THEN 'high' WHEN cp <= 0.3 THEN 'low' END AS bucket FROM tm) WHERE bucket IS NOT NULL GROUP BY 1""")
def a14(spark, d):
    return rounded(A.bucket_means(terms(spark, d), "cp", TERM_NAMES), *TERM_NAMES)


@query("A15_dominant_term", f"""{HS}{TERMS} SELECT event_id, CASE WHEN vad IS NOT NULL AND abs(vad) >= abs(spk) AND abs(vad) >= abs(word) THEN 'vad' WHEN abs(spk) >= abs(word) THEN 'spk' ELSE 'word' END AS dominant FROM tm""")
def a15(spark, d):
    return A.dominant_term(terms(spark, d), TERM_NAMES).select("event_id", "dominant")


@query("A16_type_counts", f"{HS} SELECT label, count(*) AS n, count(DISTINCT session) AS sessions FROM sig GROUP BY 1")
def a16(spark, d):
    return A.type_counts(S.signal(spark, d), "label")


@query("Z3_term_stats", HS + TERMS + ", lg AS (" + " UNION ALL ".join(f"SELECT label, '{t}' AS term, {t} AS v FROM tm" for t in TERM_NAMES) + """)
SELECT label, term, count(v) AS n, count(*) - count(v) AS missing, round(min(v), 6) AS least, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM lg GROUP BY 1, 2""")  # fmt: skip
def z3(spark, d):
    return rounded(A.term_stats(terms(spark, d), TERM_NAMES, ("label",)), "least", "p50", "p95", "most", "mean")


SPEECH = """, m AS (SELECT *, p > 0.5 AS hit FROM sig), r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY idx) AS run FROM (SELECT *, CAST(coalesce(lag(hit) OVER (PARTITION BY session ORDER BY idx) <> hit, TRUE) AS INTEGER) AS new FROM m)),
n AS (SELECT session, count(*) AS n FROM r WHERE hit GROUP BY session, run), ns AS (SELECT session, count(*) AS c, sum(n) AS s, avg(n) AS a, median(n) AS m FROM n GROUP BY 1)"""


@query("A17_speech_stats", f"""{HS}{SPEECH} SELECT t.session, coalesce(c, 0) AS segments, round(coalesce(s, 0) / t.f, 6) AS ratio, round(coalesce(a, 0) / 2, 6) AS mean_sec, round(coalesce(m, 0) / 2, 6) AS median_sec FROM (SELECT session, count(*) AS f FROM sig GROUP BY 1) t LEFT JOIN ns USING (session)""")
def a17(spark, d):
    s = S.signal(spark, d)
    return rounded(A.speech_stats(W.above_index(s, "p", 0.5), s.groupBy("session").agg(F.count("*").alias("frames")), 2.0), "ratio", "mean_sec", "median_sec")


MASKS = ", mk AS (SELECT session, vad >= 0.5 AS a, list_max(p) >= 0.5 AS b FROM frames), ct AS (SELECT session, sum(CAST(a AND b AS INTEGER)) AS tp, sum(CAST(NOT a AND b AS INTEGER)) AS fp, sum(CAST(a AND NOT b AS INTEGER)) AS fn FROM mk GROUP BY 1)"


def masks(spark, d):
    return S.frames(spark, d).select("session", (F.col("vad") >= 0.5).alias("a"), (F.array_max("p") >= 0.5).alias("b"))


@query("A18_iou", f"{HF}{MASKS} SELECT session, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou FROM ct")
def a18(spark, d):
    return rounded(A.mask_scores(masks(spark, d), "a", "b", ("session",)).select("session", "iou"), "iou")


@query("A19_f1", f"""{HF}{MASKS} SELECT session, round(CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM ct""")  # fmt: skip
def a19(spark, d):
    return rounded(A.mask_scores(masks(spark, d), "a", "b", ("session",)).select("session", "precision", "recall", "f1"), "precision", "recall", "f1")


GA, GB, GT = [2.0, 5.0, 8.0], [0.3, 0.4, 0.5, 0.6], [0.4, 0.5, 0.6]


@query("A20_grid_search", f"""{HF}, gr AS (SELECT a, b, t, row_number() OVER () AS k FROM (SELECT unnest({GA}::DOUBLE[]) AS a), (SELECT unnest({GB}::DOUBLE[]) AS b), (SELECT unnest({GT}::DOUBLE[]) AS t)),
sc AS (SELECT a, b, t, sum(CAST(tr AND h AS INTEGER)) AS tp, sum(CAST(tr <> h AS INTEGER)) AS off FROM (SELECT a, b, gr.t AS t, list_max(p) >= 0.5 AS tr, 1 / (1 + exp(-least(20, greatest(-20, a * (vad - b))))) >= gr.t AS h FROM frames, gr) GROUP BY 1, 2, 3)
SELECT a, b, t AS threshold, round(CASE WHEN tp + off = 0 THEN 1 ELSE 2 * tp / (2 * tp + off) END, 6) AS f1 FROM sc ORDER BY CASE WHEN tp + off = 0 THEN 1 ELSE 2 * tp / (2 * tp + off) END DESC, a, b, t LIMIT 1""")  # fmt: skip
def a20(spark, d):
    return rounded(A.grid_search(S.frames(spark, d), F.array_max("p") >= 0.5, F.col("vad"), GA, GB, GT), "f1")


SIM = ", few AS (SELECT * FROM vec), pr AS (SELECT a.session, a.idx AS i, b.idx AS j, least(1, greatest(-1, list_dot_product(a.v, b.v))) AS s FROM few a JOIN few b ON a.session = b.session AND a.idx <> b.idx)"


@query("A21_similarity_summary", f"""{HV}{SIM}, rw AS (SELECT session, i, max(s) AS top, list_sort(list(s), 'DESC')[2] AS snd FROM pr GROUP BY 1, 2)
SELECT p.session, round(p.m, 6) AS mean, round(p.sd, 6) AS deviation, round(r.g, 6) AS gap_mean, round(r.gm, 6) AS gap_median, r.iso AS isolated FROM (SELECT session, avg(s) AS m, stddev_pop(s) AS sd FROM pr GROUP BY 1) p
JOIN (SELECT session, avg(top - coalesce(snd, top)) AS g, median(top - coalesce(snd, top)) AS gm, CAST(sum(CAST(top < 0.4 AS INTEGER)) AS BIGINT) AS iso FROM rw GROUP BY 1) r USING (session)""")  # fmt: skip
def a21(spark, d):
    return rounded(M.similarity_summary(S.vectors(spark, d)), "mean", "deviation", "gap_mean", "gap_median")


@query("A22_gaps", f"""{H}, g AS (SELECT session, t0, t1, lead(t0) OVER (PARTITION BY session ORDER BY t0, seg_idx) - t1 AS gap FROM seg)
SELECT session, round(t1, 6) AS t, round(gap, 6) AS gap, CAST(row_number() OVER (PARTITION BY session ORDER BY round(gap, 9) DESC, t0) AS INTEGER) AS rank FROM g WHERE gap > 0.1 QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(gap, 9) DESC, t0) <= 5""")  # fmt: skip
def a22(spark, d):
    return rounded(A.gaps(S.segments(spark, d)), "t", "gap")


@query("A23_confident_zones", f"""{HF}{TOP}, ow AS (SELECT *, CASE WHEN list_max(p) >= 0.4 AND list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] >= 0.05 AND {ENT} / ln(3) <= 0.95 AND vad >= 0.35 THEN path END AS own FROM top),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(row_number() OVER w = 1 OR lag(own) OVER w IS DISTINCT FROM own AS INTEGER) AS new FROM ow WINDOW w AS (PARTITION BY session ORDER BY i))),
z AS (SELECT session, any_value(own) AS speaker, min(t) AS t0, count(*) * 0.5 AS seconds FROM r WHERE own IS NOT NULL GROUP BY session, run)
SELECT session, CAST(speaker AS INTEGER) AS speaker, t0, CAST(seconds AS DOUBLE) AS seconds, CAST(row_number() OVER (PARTITION BY session ORDER BY seconds DESC, t0) AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY session ORDER BY seconds DESC, t0) <= 5""")  # fmt: skip
def a23(spark, d):
    return A.confident_zones(S.frames(spark, d), top=0.4, margin=0.05, entropy=0.95)


@query("A24_path_report", f"""{HF}{TOP} SELECT session, round(avg(off), 6) AS mismatch, round(sum(s) * 120.0 / count(*), 6) AS switches_per_minute FROM (
  SELECT session, CAST(fixed <> path AS INTEGER) AS off, CAST(coalesce(fixed <> lag(fixed) OVER (PARTITION BY session ORDER BY i), FALSE) AS INTEGER) AS s FROM (SELECT *, (i // 5) % 3 AS fixed FROM top)) GROUP BY 1""")  # fmt: skip
def a24(spark, d):
    f = S.frames(spark, d).withColumn("fixed", (F.floor(F.col("i") / 5) % 3).cast("int"))
    return rounded(A.path_report(f, "fixed", HZ), "mismatch", "switches_per_minute")


@query("A26_step_report", f"""{H}{DUR}, st AS (SELECT session, speaker AS step, sum(length(text)) / 100.0::DOUBLE AS seconds FROM seg GROUP BY 1, 2)
SELECT s.session, s.step, round(s.seconds / sum(s.seconds) OVER (PARTITION BY s.session), 6) AS share, round(sum(s.seconds) OVER (PARTITION BY s.session) / greatest(d.duration, 1), 6) AS rtf FROM st s JOIN dur d USING (session)""")  # fmt: skip
def a26(spark, d):
    steps = S.segments(spark, d).groupBy("session", F.col("speaker").alias("step")).agg((F.sum(F.length("text")) / 100.0).alias("seconds"))
    return rounded(A.step_report(steps, S.durations(spark, d)), "share", "rtf")


@query("F1_l2norm", f"{HV} SELECT vec_id, [round(x * 3 / greatest(sqrt(list_dot_product(v, v)) * 3, 1e-8), 5) FOR x IN v] AS u FROM vec")
def f1(spark, d):
    scaled = F.transform("v", lambda x: x * 3)
    return S.vectors(spark, d).select("vec_id", F.transform(V.l2_normalise(scaled), lambda x: N.scaled_round(x, 5)).alias("u"))


def _listed(c):
    return F.transform(c, lambda x: F.round(x, 6))


def _softmax_sql(scale: str) -> str:
    return f"{HF} SELECT session, i, [round(exp({scale} - m) / s, 6) FOR x IN p] AS q FROM (SELECT *, list_sum([exp({scale} - m) FOR x IN p]) AS s FROM (SELECT *, list_max([{scale} FOR x IN p]) AS m FROM frames))"


@query("F2_softmax", _softmax_sql("x / 0.28"))
def f2(spark, d):
    return S.frames(spark, d).select("session", "i", _listed(V.softmax(F.col("p"), 0.28)).alias("q"))


@query("F3_scale_softmax", _softmax_sql("x * 5"))
def f3(spark, d):
    return S.frames(spark, d).select("session", "i", _listed(V.scale_softmax(F.col("p"), 5.0)).alias("q"))


@query("F4_calibrate", f"{HF} SELECT session, i, round(1 / (1 + exp(-least(20, greatest(-20, 5 * (vad - 0.5))))), 6) AS q FROM frames")
def f4(spark, d):
    return S.frames(spark, d).select("session", "i", r6(N.calibrated(F.col("vad"))).alias("q"))


@query("F6_gain_normalise", f"""{HS}, q AS (SELECT session, quantile_cont(abs(value - 50), 0.995) AS h FROM sig GROUP BY 1)
SELECT event_id, round(CASE WHEN h = 0 THEN value - 50 ELSE least(1, greatest(-1, (value - 50) * (0.9 / (h + 1e-8)))) END, 6) AS x FROM sig JOIN q USING (session)""")  # fmt: skip
def f6(spark, d):
    s = S.signal(spark, d).select("session", "event_id", (F.col("value") - 50.0).alias("x"))
    return rounded(B.gain_normalised(s, "x").select("event_id", "x"), "x")


@query("F8_sharpen", f"{HF} SELECT session, i, [round(pow(x, 1.2) / s, 6) FOR x IN p] AS q FROM (SELECT *, list_sum([pow(x, 1.2) FOR x IN p]) AS s FROM frames)")
def f8(spark, d):
    return S.frames(spark, d).select("session", "i", _listed(V.sharpen(F.col("p"), 1.2)).alias("q"))


@query("F9_posterior_cal", f"""{HF}, a AS (SELECT session, i, [greatest(x, 1e-12) / list_sum(p) FOR x IN p] AS p FROM frames), b AS (SELECT session, i, [pow(x, 0.4) FOR x IN p] AS p FROM a), c AS (SELECT session, i, [x / list_sum(p) FOR x IN p] AS p FROM b)
SELECT session, i, [round(0.92 * x + 0.08 / 3, 6) FOR x IN p] AS q FROM c""")  # fmt: skip
def f9(spark, d):
    return S.frames(spark, d).select("session", "i", _listed(V.calibrate(F.col("p"))).alias("q"))


@query("F10_log_emission", f"{HF} SELECT session, i, [round(ln(least(1, greatest(x, 1e-12))), 6) FOR x IN p] AS q FROM frames")
def f10(spark, d):
    return S.frames(spark, d).select("session", "i", _listed(V.log_emission(F.col("p"))).alias("q"))


@query("F11_entropy_margin", f"{HF}{TOP} SELECT session, i, CAST(path AS INTEGER) AS top, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS margin, round({ENT} / ln(3), 6) AS entropy FROM top")
def f11(spark, d):
    f = S.frames(spark, d)
    return f.select("session", "i", V.argmax(F.col("p")).alias("top"), r6(V.margin(F.col("p"))).alias("margin"), r6(V.entropy_normalised(F.col("p"))).alias("entropy"))


@query("F15_int16", f"{HS} SELECT event_id, CAST(trunc(least(1, greatest(-1, p * 2 - 1)) * 32767) AS SMALLINT) AS x FROM sig")
def f15(spark, d):
    return S.signal(spark, d).select("event_id", N.to_int16(F.col("p") * 2 - 1).alias("x"))


@query("P9_uncertain_frames", f"{HF} SELECT session, i FROM frames WHERE {ENT} / ln(3) >= 0.9 AND list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] <= 0.2")
def p9(spark, d):
    p = F.col("p")
    return S.frames(spark, d).where((V.entropy_normalised(p) >= 0.9) & (V.margin(p) <= 0.2)).select("session", "i")


@query("P4_weak_switches", f"{HS}{TERMS} SELECT event_id FROM tm WHERE label LIKE '%click%' AND cp < 0.5 AND coalesce(vad, 1) >= 0 AND (spk IS NULL OR spk <= 0.5)")
def p4(spark, d):
    return terms(spark, d).where(F.lower("label").contains("click") & (F.col("cp") < 0.5) & (F.coalesce("vad", F.lit(1.0)) >= 0) & (F.col("spk").isNull() | (F.col("spk") <= 0.5))).select("event_id")


@query("P5_strong_switches", f"{HS}{TERMS} SELECT event_id, cp FROM tm WHERE cp >= 0.9")
def p5(spark, d):
    return terms(spark, d).where("cp >= 0.9").select("event_id", "cp")


@query("P6_event_class", "SELECT event_id, event_type LIKE '%click%' AS is_switch, event_type LIKE '%view%' AS is_peak FROM events")
def p6(spark, d):
    kind = F.lower("event_type")
    return S.table(spark, d, "events").select("event_id", kind.contains("click").alias("is_switch"), kind.contains("view").alias("is_peak"))


@query("P7_time_neighbours", f"{HS} SELECT a.session, a.event_id AS a, b.event_id AS b FROM sig a JOIN sig b ON a.session = b.session AND abs(a.t - b.t) <= 1 AND a.event_id <> b.event_id WHERE a.label = 'click'")
def p7(spark, d):
    s = S.signal(spark, d)
    return B.time_neighbours(s.where("label = 'click'"), s, 1.0)


@query("P10_min_duration", f"{H} SELECT session, seg_idx, round(t1 - t0, 6) AS seconds FROM seg WHERE t1 - t0 >= 15")
def p10(spark, d):
    return S.segments(spark, d).where("t1 - t0 >= 15").select("session", "seg_idx", r6(F.col("t1") - F.col("t0")).alias("seconds"))


@query("J17_centroid_assign", f"""{HV}, el AS (SELECT label, k, avg(v[k]) AS m FROM vec, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2), ct AS (SELECT label, list(m ORDER BY k) AS c FROM el GROUP BY 1),
sc AS (SELECT vec_id, ct.label AS l, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS s FROM vec, ct) SELECT vec_id, arg_max(l, struct_pack(s := s, b := -l)) AS assigned, round(max(s), 5) AS score FROM sc GROUP BY 1""")  # fmt: skip
def j17(spark, d):
    v = S.vectors(spark, d)
    return M.assigned(v, M.centroids(v, "label"), "label").select("vec_id", "assigned", F.round("score", 5).alias("score"))


@query("J18_pairwise_cosine", f"{HV}{SIM} SELECT session, i, j, round(s, 5) AS s FROM pr WHERE i < j")
def j18(spark, d):
    return M.pairwise(S.vectors(spark, d)).select("session", "i", "j", F.round("s", 5).alias("s"))


@query("O2_topk_segments", f"{H} SELECT session, seg_idx, round(t0, 6) AS t0 FROM seg QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(t1 - t0, 9) DESC, seg_idx) <= 3")
def o2(spark, d):
    return rounded(B.longest(S.segments(spark, d), 3).select("session", "seg_idx", "t0"), "t0")


@query("O3_downsample", f"{HF}, n AS (SELECT session, max(i) AS l FROM frames GROUP BY 1), ix AS (SELECT DISTINCT session, CAST(floor(l * k / 9.0::DOUBLE) AS BIGINT) AS i FROM n, (SELECT unnest(range(10)) AS k)) SELECT session, i, vad FROM frames JOIN ix USING (session, i)")
def o3(spark, d):
    return B.evenly_spaced(S.frames(spark, d), 10).select("session", "i", "vad")


@query("O7_set_difference", f"{H} SELECT DISTINCT session, speaker FROM seg EXCEPT SELECT session, speaker FROM seg WHERE seg_idx < 2")
def o7(spark, d):
    s = S.segments(spark, d)
    return s.select("session", "speaker").distinct().join(s.where("seg_idx < 2"), ["session", "speaker"], "left_anti")


#: Turns whose vowels are written in CJK and other wide characters and whose blanks are doubled in part.
WIDE_FROM, WIDE_TO = "aeionrst", "あ漢㐀豈。Ａｱ　"
WIDE_SQL = f"SELECT conv_id, turn, replace(replace(translate(text, '{WIDE_FROM}', '{WIDE_TO}'), 'd ', 'd  '), '漢', '漢 ') AS text FROM conversations"
CJK_SQL = "[\\x{3000}-\\x{303F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"


def wide(spark, d):
    text = F.replace(F.replace(F.translate("text", WIDE_FROM, WIDE_TO), F.lit("d "), F.lit("d  ")), F.lit("漢"), F.lit("漢 "))
    return S.table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


def _twice(x):
    return f"regexp_replace(regexp_replace({x}, '({CJK_SQL}) +({CJK_SQL})', '\\1\\2', 'g'), '({CJK_SQL}) +({CJK_SQL})', '\\1\\2', 'g')"


@query("T1_cjk_spaces", f"SELECT conv_id, turn, {_twice('text')} AS clean FROM ({WIDE_SQL})")
def t1(spark, d):
    return wide(spark, d).select("conv_id", "turn", T.drop_cjk_spaces(F.col("text")).alias("clean"))


@query("T4_timecode", f"""{HS} SELECT event_id, printf('%02d:%02d:%02d,%03d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us % 1000000 // 1000) AS code FROM (SELECT event_id, CAST(round(value * 1000000) AS BIGINT) AS us FROM sig WHERE value >= 0)""")
def t4(spark, d):
    return S.signal(spark, d).where("value >= 0").select("event_id", T.timecode(F.col("value")).alias("code"))


@query("T5_seconds", f"{HS} SELECT event_id, CAST(floor(value) AS DOUBLE) AS seconds FROM sig WHERE value >= 0")
def t5(spark, d):
    return S.signal(spark, d).where("value >= 0").select("event_id", T.seconds_of(T.timecode(F.floor("value").cast("double"), millis=False)).alias("seconds"))


#: Turns in which marks lead, repeat and meet, with and without white space between.
MARKED = [(". ", "。 ? 。"), (", ", "、 、，"), ("e ", "？　．"), ("n ", ".! !"), ("a", "a。。 。?"), ("st", " ？？\t. ")]
WHITE_SQL = "[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]*"


def _marked_sql():
    x = "text"
    for old, new in MARKED:
        x = f"replace({x}, '{old}', '{new}')"
    return f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '. ' WHEN 1 THEN ' 　?、. ' ELSE '  ' END || {x} AS text FROM conversations"


def _cleaned_sql():
    x = f"regexp_replace(text, '^{WHITE_SQL}[{T.MARKS}]+', '')"
    for mark in T.MARKS:
        x = f"regexp_replace({x}, '[{mark}](?:{WHITE_SQL}[{mark}])+', '{mark}', 'g')"
    for pattern in ("[?？]+", f"？{WHITE_SQL}[{T.STOPS}]", f"[{T.STOPS}]{WHITE_SQL}？"):
        x = f"regexp_replace({x}, '{pattern}', '？', 'g')"
    return x


@query("T6_punct_cleanup", f"SELECT conv_id, turn, {_cleaned_sql()} AS clean FROM ({_marked_sql()})")
def t6(spark, d):
    text = F.col("text")
    for old, new in MARKED:
        text = F.replace(text, F.lit(old), F.lit(new))
    lead = F.when(F.col("turn") % 3 == 0, ". ").when(F.col("turn") % 3 == 1, " 　?、. ").otherwise("  ")
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.clean_punctuation(F.concat(lead, text)).alias("clean"))


@query("T9_sentence_final", f"{HW} SELECT session, word_idx FROM words WHERE regexp_matches(word, '[?？。.！!]$')")
def t9(spark, d):
    return S.words(spark, d).where(T.is_final(F.col("word"))).select("session", "word_idx")


@query("T10_file_name", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'run') AS name FROM pages")
def t10(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name"))


#: Ways to write a value; # stands for a number of the table.
WRITTEN = ['#', '#.0', '#.5', '"#"', '" +# "', '"#.25"', 'true', '"true"', '"Y"', '0', '1.0', 'null', '"x#"', '"f"', '-#e2', '[#]', '"1"']
_JSON = "'{\"k\": ' || replace(CASE event_id % " + str(len(WRITTEN)) + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WRITTEN)) + " END, '#', CAST(user_id AS VARCHAR)) || '}'"
_NUMERIC = "(?i)^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf|infinity|nan)\\s*$"


@query("T11_lenient_casts", f"""WITH j AS (SELECT event_id, json_type(j, '$.k') AS kind, j ->> '$.k' AS raw FROM (SELECT event_id, CAST({_JSON} AS JSON) AS j FROM events)), w AS (SELECT *, lower(trim(raw)) AS word, TRY_CAST(raw AS DOUBLE) AS n FROM j)
SELECT event_id, CASE WHEN kind = 'BOOLEAN' THEN CAST(CAST(raw AS BOOLEAN) AS DOUBLE) WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_matches(raw, '{_NUMERIC}') THEN TRY_CAST(trim(raw) AS DOUBLE) END ELSE n END AS x,
  CASE WHEN kind = 'BOOLEAN' THEN NULL WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_matches(raw, '^\\s*[+-]?\\d+\\s*$') THEN TRY_CAST(ltrim(trim(raw), '+') AS BIGINT) END WHEN n = floor(n) THEN CAST(n AS BIGINT) END AS n,
  CASE WHEN kind IN ('VARCHAR', 'BOOLEAN') THEN CASE WHEN word IN ('true', 't', '1', 'yes', 'y') THEN TRUE WHEN word IN ('false', 'f', '0', 'no', 'n') THEN FALSE END WHEN n = 1 THEN TRUE WHEN n = 0 THEN FALSE END AS b FROM w""")
def t11(spark, d):
    way = F.col("event_id") % len(WRITTEN)
    written = F.coalesce(*[F.when(way == i, F.lit(w)) for i, w in enumerate(WRITTEN)])
    json = F.concat(F.lit('{"k": '), F.replace(written, F.lit("#"), F.col("user_id").cast("string")), F.lit("}"))
    e = S.table(spark, d, "events").select("event_id", json.alias("j"))
    p = F.col("j")
    return e.select("event_id", N.lenient_double(p, "$.k").alias("x"), N.lenient_int(p, "$.k").alias("n"), N.lenient_boolean(p, "$.k").alias("b"))


@query("T13_speaker_label", f"{HS} SELECT event_id, printf('SPEAKER_%02d', k) AS label, k AS back FROM sig")
def t13(spark, d):
    s = S.signal(spark, d).select("event_id", T.speaker_label(F.col("k")).alias("label"))
    return s.withColumn("back", T.speaker_index(F.col("label")))


@query("T14_shown", f"{HS}{TERMS} SELECT event_id, CASE WHEN vad IS NULL THEN 'NA' ELSE printf('%.3f', round(vad, 3) + 0.0) END AS shown FROM tm")
def t14(spark, d):
    return terms(spark, d).select("event_id", T.shown(F.round("vad", 3) + 0.0, 3).alias("shown"))


@query("T16_reconstruct", f"{HW} SELECT session, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY 1")
def t16(spark, d):
    return B.reconstructed(S.words(spark, d))
