"""Weights and temperatures that follow the posteriors over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bind, entropy_normalised, margin, shares, total
from .sequences import moving_average, onset_distances


def dominance_weights(frames: DataFrame, beta: float = 0.8, strength: float = 0.5, low: float = 0.5, high: float = 1.0,
                      edge_sec: float = 0.0, edge_ratio: float = 1.0, speech: float = 0.35) -> DataFrame:
    """``beta`` per frame, lower the more one speaker dominates and near the ends of speech, within beta times low and high."""
    p = shares(F.transform("p", lambda x: F.greatest(x, F.lit(1e-8))))
    k = F.size("p")
    clear = F.least(F.lit(1.0), margin(p) / F.greatest(F.lit(1e-6), 1 - 1 / k))
    dominance = F.when(k > 1, (1 - F.least(F.lit(1.0), entropy_normalised(p))) * clear).otherwise(0.0)
    ratio = F.least(F.lit(high), F.greatest(F.lit(low), 1 - strength * dominance))
    out = onset_distances(frames.withColumn("_ratio", ratio), F.col("vad") >= speech)
    edge = (F.col("since") <= edge_sec) | (F.col("until") <= edge_sec)
    scaled = F.when(edge & F.lit(edge_sec > 0), F.col("_ratio") * edge_ratio).otherwise(F.col("_ratio"))
    return out.withColumn("beta", beta * F.least(F.lit(high), F.greatest(F.lit(low), scaled))).drop("_ratio", "since", "until")


def local_temperatures(rows: DataFrame, width: int = 41, flat: float = 0.05, wide: float = 0.20, cold: float = 0.35, hot: float = 0.65) -> DataFrame:
    """Rows (session, i, s array) with ``tau``: the deviation within rows, averaged over ``width`` rows with repeated ends, of
    ``flat`` gives ``hot`` and of ``wide`` ``cold``, on the line between."""

    def deviation(v):
        return bind(total(v) / F.size(v), lambda m: F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))

    smooth = moving_average(rows.withColumn("_sd", deviation(F.col("s"))), "_sd", width, "repeat", "_mean")
    sd = F.least(F.lit(wide), F.greatest(F.lit(flat), F.col("_mean")))
    return smooth.withColumn("tau", hot - (sd - flat) * ((hot - cold) / (wide - flat))).drop("_sd", "_mean")
