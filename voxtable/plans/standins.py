"""Timeline tables derived from the driver's tables, in Spark and, by the same formulas, in SQL.

Times of conversations come from text lengths in fifteenths of a second, counted as integers, so that both engines
get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HZ = 2.0
SPEAKERS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(session, seg_idx, speaker, text, t0, t1), gaps of 0 to 11 fifteenths."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    e = F.sum(n + (F.col("turn") * 7 + F.col("conv_id")) % 12).over(w)
    timed = c.withColumns({"_n": n, "_e": e})
    return timed.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text",
        ((F.col("_e") - F.col("_n")).cast("double") / 15.0).alias("t0"), (F.col("_e").cast("double") / 15.0).alias("t1"),
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    """(session, word_idx, word, speaker, seg_idx, t0, t1, prob) with equal shares of the segment's time."""
    s = segments(spark, d).withColumn("_w", F.filter(F.split("text", "\\s+"), lambda x: x != "")).withColumn("_n", F.size("_w"))
    each = s.select("session", "seg_idx", "speaker", "t0", "t1", "_n", F.posexplode("_w").alias("k", "word"))
    span = F.col("t1") - F.col("t0")
    idx = (F.row_number().over(Window.partitionBy("session").orderBy("seg_idx", "k")) - 1).cast("long")
    out = each.select(
        "session", idx.alias("word_idx"), "word", "speaker", "seg_idx",
        (F.col("t0") + span * F.col("k") / F.col("_n")).alias("t0"), (F.col("t0") + span * (F.col("k") + 1) / F.col("_n")).alias("t1"),
    )
    p = ((F.col("word_idx") * 13 + F.col("session") * 7) % 100).cast("double") / 100.0
    return out.withColumn("prob", F.when(F.col("word_idx") % 10 != 3, p))


def shifted(spark: SparkSession, d: str) -> DataFrame:
    """The segments, moved by 0.4 s, as another system might cut them."""
    return segments(spark, d).withColumns({"t0": F.col("t0") + 0.4, "t1": F.col("t1") + 0.4})


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(session, i, t, vad, p) at HZ with three posteriors."""
    n = segments(spark, d).groupBy("session").agg(F.floor(F.max("t1") * HZ).alias("n")).where("n >= 1")
    f = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    base = F.col("i") * 37 + F.col("session") * 11
    w = [(1 + (base + k * 53) % 97).cast("double") for k in range(SPEAKERS)]
    sum_ = w[0] + w[1] + w[2]
    return f.select(
        "session", "i", (F.col("i") / HZ).alias("t"), ((base % 101).cast("double") / 100.0).alias("vad"), F.array(*[x / sum_ for x in w]).alias("p")
    )


def durations(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("session").agg(F.max("t1").alias("duration"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    n = durations(spark, d).withColumn("n", F.floor(F.col("duration") / 0.75)).where("n >= 1")
    c = n.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return c.select("session", "chunk_idx", (F.col("chunk_idx") * 0.75).alias("t0"), (F.col("chunk_idx") * 0.75 + 1.5).alias("t1"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """(session, idx, event_id, t, value, p, label, k): events, time in units of six hours, p in [0, 1)."""
    e = table(spark, d, "events").where("value is not null")
    days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
    part = F.hour("ts") * 3600 + F.minute("ts") * 60
    micros = days * 86_400_000_000 + part.cast("bigint") * 1_000_000 + (F.expr("extract(second from ts)") * 1_000_000).cast("bigint")
    timed = e.withColumn("us", micros)
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return timed.select(
        F.col("user_id").alias("session"), idx.cast("long").alias("idx"), "event_id", (F.col("us").cast("double") / 21_600_000_000.0).alias("t"),
        "value", (F.col("value") / (F.col("value") + 50.0)).alias("p"), F.col("event_type").alias("label"), (F.col("event_id") % 3).cast("int").alias("k"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(session, idx, vec_id, v, label): the embeddings in ten sessions."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("session"), F.floor(F.col("vec_id") / 10).alias("idx"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


SEG = """seg AS (SELECT conv_id AS session, turn AS seg_idx, role AS speaker, text, CAST(e - n AS DOUBLE) / CAST(15 AS DOUBLE) AS t0,
  CAST(e AS DOUBLE) / CAST(15 AS DOUBLE) AS t1 FROM (SELECT *, length(text) AS n,
  CAST(sum(length(text) + (turn * 7 + conv_id) % 12) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations))"""
WORDS = SEG + r""", words AS (SELECT *, CASE WHEN word_idx % 10 <> 3 THEN CAST((word_idx * 13 + session * 7) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS prob FROM (
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY seg_idx, k) - 1 AS word_idx, ws[k + 1] AS word, speaker, seg_idx,
  t0 + (t1 - t0) * k / n AS t0, t0 + (t1 - t0) * (k + 1) / n AS t1
  FROM (SELECT *, len(ws) AS n, unnest(range(len(ws))) AS k FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM seg))))"""
DUR = ", dur AS (SELECT session, max(t1) AS duration FROM seg GROUP BY 1)"
FRAMES = DUR + """, frames AS (SELECT session, i, CAST(i AS DOUBLE) / CAST(2 AS DOUBLE) AS t, CAST(b % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS vad,
  [w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2)] AS p FROM (SELECT *, CAST(1 + b % 97 AS DOUBLE) AS w0,
  CAST(1 + (b + 53) % 97 AS DOUBLE) AS w1, CAST(1 + (b + 106) % 97 AS DOUBLE) AS w2 FROM (SELECT session, i, i * 37 + session * 11 AS b FROM (
  SELECT session, unnest(range(CAST(floor(duration * 2) AS BIGINT))) AS i FROM dur))))"""
CHUNKS = ", chunks AS (SELECT session, c AS chunk_idx, c * CAST(0.75 AS DOUBLE) AS t0, c * CAST(0.75 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS t1 FROM (SELECT session, unnest(range(CAST(floor(duration / CAST(0.75 AS DOUBLE)) AS BIGINT))) AS c FROM dur))"
SIG = """sig AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id,
  CAST(epoch_us(ts) AS DOUBLE) / CAST(21600000000 AS DOUBLE) AS t, value, value / (value + CAST(50 AS DOUBLE)) AS p, event_type AS label,
  CAST(event_id % 3 AS INTEGER) AS k FROM events WHERE value IS NOT NULL)"""
VEC = "vec AS (SELECT vec_id % 10 AS session, vec_id // 10 AS idx, vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v, label FROM embeddings)"
