"""Small relational operators: top-k, sampling by position, neighbours in time, reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import touching

SESSION = "session"


def longest(segments: DataFrame, k: int) -> DataFrame:
    """O2: the k longest segments of each session, the earlier of equal ones."""
    w = Window.partitionBy(SESSION).orderBy(F.round(F.col("t1") - F.col("t0"), 9).desc(), "seg_idx")
    return segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def evenly_spaced(frames: DataFrame, n: int) -> DataFrame:
    """O3: the frames at floor(k last / (n - 1)) for k below n."""
    last = frames.groupBy(SESSION).agg(F.max("i").alias("_l"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(F.col("_l") * k / F.lit(float(max(n - 1, 1))))))
    return frames.join(last.select(SESSION, F.explode(at).alias("i")), [SESSION, "i"])


def time_neighbours(seeds: DataFrame, events: DataFrame, reach: float) -> DataFrame:
    """(session, a, b) of different events at most ``reach`` apart in time."""
    a = seeds.select(SESSION, F.col("event_id").alias("a"), F.col("t").alias("_t"), (F.col("t") - reach - 1e-6).alias("l0"), (F.col("t") + reach + 1e-6).alias("l1"))
    b = events.select(SESSION, F.col("event_id").alias("b"), F.col("t").alias("r0"), F.col("t").alias("r1"))
    return touching(a, b, max(2 * reach, 1.0)).where((F.col("a") != F.col("b")) & (F.abs(F.col("_t") - F.col("r0")) <= reach)).select(SESSION, "a", "b")


def gain_normalised(samples: DataFrame, value: str, level: float = 0.9, quantile: float = 0.995) -> DataFrame:
    """scaled so that the quantile of the absolute values is ``level``, clipped to 1; silence stays."""
    high = samples.groupBy(SESSION).agg(F.percentile(F.abs(F.col(value)), F.lit(quantile)).alias("_h"))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(value) * (level / (F.col("_h") + 1e-8))))
    return samples.join(high, SESSION).withColumn(value, F.when(F.col("_h") == 0, F.col(value)).otherwise(scaled)).drop("_h")


def reconstructed(words: DataFrame, separator: str = " ") -> DataFrame:
    """Each session's words in order as one text."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    return words.groupBy(SESSION).agg(F.array_join(listed, separator).alias("text"))
