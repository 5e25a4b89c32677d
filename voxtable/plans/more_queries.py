"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import vectors as V
from ..functions.numbers import r6
from ..operators import aggregates as A
from ..operators import decode as D
from ..operators import intervals as J
from ..operators import posteriors as P
from ..operators import sequences as W
from ..sources import sinks
from . import standins as S
from .model_queries import ALIGN
from .registry import query
from .standins import HZ, WORDS
from .timeline_queries import GRID, HF, HS, HW, IV, TOP, _events, _intervals, role_grid, rounded, tops


@query("P1_valid_intervals", f"{HS} SELECT event_id FROM sig WHERE p - 0.5 > 0 AND label IS NOT NULL")
def p1(spark, d):
    return S.signal(spark, d).where("p - 0.5 > 0 AND label IS NOT NULL").select("event_id")


SHORT = ", short AS (SELECT session, c AS chunk_idx, c * 0.7::DOUBLE AS t0, c * 0.7::DOUBLE + 0.2::DOUBLE AS t1 FROM (SELECT session, unnest(range(CAST(floor(duration / 0.7::DOUBLE) AS BIGINT))) AS c FROM dur))"


@query("J3b_chunk_or_nearest", f"""{HF}{SHORT}, m AS (SELECT c.session, c.chunk_idx, (c.t0 + c.t1) / 2 AS mid, avg(f.vad) AS s FROM short c LEFT JOIN frames f ON f.session = c.session AND f.t >= c.t0 AND f.t < c.t1 GROUP BY 1, 2, 3),
n AS (SELECT m.session, m.chunk_idx, arg_min(f.vad, struct_pack(d := abs(f.t - m.mid), i := f.i)) AS v FROM m JOIN frames f ON f.session = m.session WHERE m.s IS NULL GROUP BY 1, 2)
SELECT m.session, m.chunk_idx, round(coalesce(m.s, n.v), 6) AS score FROM m LEFT JOIN n USING (session, chunk_idx) WHERE m.s IS NOT NULL OR n.v IS NOT NULL""")  # fmt: skip
def j3b(spark, d):
    n = S.durations(spark, d).withColumn("n", F.floor(F.col("duration") / 0.7)).where("n >= 1")
    c = n.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    short = c.select("session", "chunk_idx", (F.col("chunk_idx") * 0.7).alias("t0"), (F.col("chunk_idx") * 0.7 + 0.2).alias("t1"))
    f = S.frames(spark, d)
    out = J.chunk_means_or_nearest(short.join(J.by_merge(f.select("session").distinct()), "session", "left_semi"), f, HZ)
    return rounded(out, "score")


ENT = "-list_sum([x * ln(greatest(x, 1e-12)) for x in p]) / ln(3)"


@query("F12_dominance_weight", f"""{HF}{TOP} SELECT session, i, round(0.8 * least(1, greatest(0.5, 1 - 0.5 * (1 - least(1, {ENT})) * least(1, (list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2]) / (2.0 / 3)))), 5) AS beta FROM top""")
def f12(spark, d):
    return P.dominance_weights(S.frames(spark, d)).select("session", "i", F.round("beta", 5).alias("beta"))


@query("F7_stretch", f"""{HF}, sd AS (SELECT session, i, p, list_avg(p) AS m, list_stddev_pop(p) AS s FROM frames)
SELECT session, i, [round(2 / (1 + exp(-2 * (3 * (x - m) / (s + 1e-8)))) - 1, 5) FOR x IN p] AS q FROM sd""")  # fmt: skip
def f7(spark, d):
    q = V.stretch_flat(F.col("p"), F.lit(0.01))
    return S.frames(spark, d).select("session", "i", F.transform(q, lambda x: F.round(x, 5)).alias("q"))


@query("W12_local_temperature", f"""{HF}, sd AS (SELECT session, i, list_stddev_pop(p) AS s FROM frames), n AS (SELECT session, max(i) AS n FROM frames GROUP BY 1),
o AS (SELECT sd.session, sd.i, unnest(range(-20, 21)) AS o, n FROM sd JOIN n USING (session)),
m AS (SELECT o.session, o.i, avg(sd.s) AS m FROM o JOIN sd ON sd.session = o.session AND sd.i = least(greatest(o.i + o.o, 0), o.n) GROUP BY 1, 2)
SELECT session, i, round(0.65 - (least(0.2, greatest(0.05, m)) - 0.05) * 0.3 / 0.15, 6) AS tau FROM m""")  # fmt: skip
def w12(spark, d):
    rows = S.frames(spark, d).select("session", "i", F.col("p").alias("s"))
    return rounded(P.local_temperatures(rows).select("session", "i", "tau"), "tau")


@query("Z2_hits_by_flag", f"{HW}{IV}, fl AS (SELECT *, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag FROM ev WHERE EXISTS (SELECT 1 FROM iv WHERE iv.session = ev.session AND ev.t BETWEEN iv.t0 AND iv.t1)) SELECT session, count(*) AS hits, count(*) FILTER (flag) AS yes, count(*) FILTER (NOT flag) AS no, count(*) FILTER (flag IS NULL) AS unknown FROM fl GROUP BY 1")
def z2(spark, d):
    e = _events(spark, d).withColumn("flag", F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False))
    return J.hits_by_flag(e, _intervals(spark, d), "flag")


@query("Z5_host_labels", f"{HF}{GRID} SELECT session, i, CAST(gold IN ('HOST') AS INTEGER) AS host FROM g")
def z5(spark, d):
    return role_grid(spark, d).select("session", "i", F.col("gold").isin("HOST").cast("int").alias("host"))


@query("Z6_interval_report", f"""{HF}{GRID}, m AS (SELECT *, gold = 'GUEST' AND pred = 'HOST' AS hit, coalesce(lead(t) OVER (PARTITION BY session ORDER BY i), t + 0.5) AS nx FROM g),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY i) AS run FROM (SELECT *, CAST(coalesce(lag(hit) OVER (PARTITION BY session ORDER BY i) <> hit, TRUE) AS INTEGER) AS new FROM m)),
e AS (SELECT session, min(t) AS t0, max(nx) AS t1, row_number() OVER (PARTITION BY session ORDER BY min(t)) AS n FROM r WHERE hit GROUP BY session, run HAVING max(nx) - min(t) >= 1)
SELECT session, printf('=== Misclassified intervals (%s) ===' || chr(10) || '  count : %d' || chr(10) || '  total : %.1f sec' || chr(10), 'GUEST as HOST', count(*), sum(t1 - t0)) || string_agg(printf('  %2d  %8.2f  %8.2f  %7.2f', n, t0, t1, t1 - t0), chr(10) ORDER BY t0) AS report FROM e GROUP BY 1""")  # fmt: skip
def z6(spark, d):
    e = W.error_intervals(role_grid(spark, d), "gold", "pred", ("GUEST", "HOST"), 0.5, least=1.0)
    return sinks.interval_report(e, "GUEST as HOST")


BROKEN = [(1, "そうなんで。", "すけど"), (2, "そうです。", "はい"), (3, "行く。", "hello"), (4, "これは", "だめ"), (5, "たのし。 ", " かった")]


@query("T8_broken_sentences", "SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, FALSE), (4, FALSE), (5, TRUE)) x(id, broken)")
def t8(spark, d):
    df = spark.createDataFrame(BROKEN, "id int, a string, b string")
    return df.select("id", T.broken_sentence(F.col("a"), F.col("b")).alias("broken"))


@query("T3_wrap")
def t3(spark, d):
    return S.segments(spark, d).select("session", "seg_idx", T.wrapped(F.col("text")).alias("wrapped"))


@query("T12_first_key", "SELECT event_id, coalesce(props ->> '$.missing', props ->> '$.k') AS v FROM events")
def t12(spark, d):
    return S.table(spark, d, "events").select("event_id", N.first_key(F.col("props"), "missing", "k").alias("v"))


@query("T15_to_json", f"WITH {WORDS} SELECT session, word_idx, '{{\"word_idx\":' || word_idx || ',\"seg_idx\":' || seg_idx || '}}' AS j FROM words")
def t15(spark, d):
    return S.words(spark, d).select("session", "word_idx", F.to_json(F.struct("word_idx", "seg_idx")).alias("j"))


@query("O1_stable_sort", f"{HS} SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY t, idx) AS n FROM sig")
def o1(spark, d):
    n = F.row_number().over(W.by("t", "idx"))
    return S.signal(spark, d).select("session", "event_id", n.cast("long").alias("n"))


@query("O4_earliest", f"{HS} SELECT session, event_id FROM sig QUALIFY row_number() OVER (PARTITION BY session ORDER BY t, idx) <= 30")
def o4(spark, d):
    return S.signal(spark, d).withColumn("_n", F.row_number().over(W.by("t", "idx"))).where("_n <= 30").select("session", "event_id")


@query("A9_speaker_mapping")
def a9(spark, d):
    w = S.words(spark, d)
    ref = w.select(F.col("session").alias("doc"), F.lit("ref").alias("side"), F.col("word_idx").alias("pos"), "word", "speaker")
    other = F.when(F.col("speaker") == "user", "x").otherwise("y")
    hyp = w.where(F.length("word") != 4).select(F.col("session").alias("doc"), F.lit("hyp").alias("side"), F.col("word_idx").alias("pos"), "word", other.alias("speaker"))
    return D.speaker_scores(A.token_accuracy(D.aligned(ref.unionByName(hyp))))


@query("V5_boundary_refine")
def v5(spark, d):
    f = tops(spark, d).withColumn("path", (F.floor(F.col("i") / 9) % 3).cast("int"))
    local = F.when(F.col("i") % 4 == 0, F.reverse("p"))
    sw = W.switches(f, "path")
    cand = sw.select("session", F.col("i").alias("n"), (F.col("t") - 1.0).alias("a"), (F.col("t") + 1.0).alias("b"))
    return D.refined(f.withColumn("q", local).withColumn("cost", F.lit(1.0)), cand, ALIGN, scale=0.2)


@query("W20_absorb_runs")
def w20(spark, d):
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = D.matrix(pdf["p"])
        return pd.DataFrame({"i": pdf["i"], "path": D.absorb_short_runs(p.argmax(axis=1), np.log(p), 3).astype("int32")})

    return D.per_session(S.frames(spark, d).select("session", "i", "p"), run, "i long, path int")
