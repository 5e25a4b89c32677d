"""Audio as tables: PCM wave decoding, resampling, windows, log-mel features. Compressed codecs need a decoder of their own."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
#: Fixed value: the largest upload that is read.
MOST_BYTES = 1_000_000_000


def decode_wave(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples within 1) of PCM wave bytes of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (np.concatenate((np.zeros((len(b), 1), np.uint8), b), axis=1).reshape(-1).view("<i4") >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation, after a moving average where the rate falls."""
    if rate == to or not len(x):
        return x
    if rate > to:
        k = max(1, round(rate / to))
        x = np.convolve(x, np.ones(k) / k, "same")
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def recordings(spark: SparkSession, path: str, to: int = RATE) -> DataFrame:
    """(session, sr, duration, samples array<float>) of the wave files under a path."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".wav") & (F.col("length") <= MOST_BYTES))

    def run(frames):
        for frame in frames:
            rows = [(p, to, x) for p, c in zip(frame["path"], frame["content"], strict=True) for x in [resample(*decode_wave(bytes(c))[::-1], to)]]
            yield pd.DataFrame({"session": [r[0] for r in rows], "sr": to, "duration": [len(r[2]) / to for r in rows], "samples": [r[2] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "session string, sr int, duration double, samples array<float>")


def chunk_starts(n: Column, hop: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(hop).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def chunks(recorded: DataFrame, window: int, hop: int) -> DataFrame:
    """S3: windows of samples at every hop; the last ones are short."""
    n = F.size("samples").cast("bigint")
    each = recorded.select("*", F.posexplode(chunk_starts(n, hop)).alias("chunk_idx", "_a"))
    return each.withColumn("chunk", F.slice("samples", (F.col("_a") + 1).cast("int"), F.lit(window))).select("session", "chunk_idx", F.col("_a").alias("start"), "chunk")


def full_windows(recorded: DataFrame, window: int, hop: int) -> DataFrame:
    """(session, a, b) of whole windows only; the whole recording if it is shorter than one."""
    n = F.size("samples").cast("bigint")
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - window, F.lit(0)), F.lit(hop).cast("bigint")), lambda a: F.struct(a.alias("a"), (a + window).alias("b")))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), n.alias("b")))
    return recorded.select("session", F.inline(F.when(n < window, one).otherwise(many)))


def range_frames(ranges: DataFrame, frame: float, hop: float, least: float = 0.3) -> DataFrame:
    """Ranges (..., t0, t1) -> the other columns with k, a, b: frames at every hop within each range, cut at its end; a tail
    under ``least`` of a frame goes. Empty ranges have none."""
    n = F.ceil((F.col("t1") - F.col("t0")) / hop)
    each = ranges.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    a = F.col("t0") + F.col("k") * hop
    cut = each.withColumns({"a": a, "b": F.least(a + frame, F.col("t1"))})
    return cut.where(F.col("b") - F.col("a") >= least * frame).drop("t0", "t1")


def range_grid(t0: float, t1: float, frame: float, hop: float, least: float = 0.3) -> list[tuple[float, float]]:
    """Frames within a range; a tail under ``least`` of a frame goes."""
    starts = np.arange(t0, t1, hop)
    spans = [(float(a), float(min(a + frame, t1))) for a in starts]
    return [s for s in spans if s[1] - s[0] >= least * frame]


def mel_filters(rate: int, n_fft: int, mels: int) -> np.ndarray:
    """Triangular filters of equal area, evenly spaced on a scale that is linear (200/3 Hz a step) up to 1 kHz and logarithmic above
    (27 steps for a factor of 6.4)."""
    knee, slope = 15.0, 27 / np.log(6.4)
    top = rate / 2 * 3 / 200 if rate <= 2000 else knee + slope * np.log(rate / 2000)
    steps = np.linspace(0, top, mels + 2)
    edges = np.where(steps < knee, steps * 200 / 3, 1000 * np.exp((steps - knee) / slope))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int = RATE, mels: int = 80, window_ms: float = 25, hop_ms: float = 10, mean: np.ndarray | None = None, std: np.ndarray | None = None, snip_edges: bool = True) -> np.ndarray | None:
    """log-mel features in dB below the maximum, a power window (0.5 - 0.5 cos) ** 0.85 in the middle of the transform's length,
    mean subtracted or globally normalised; None for fewer than twenty frames. Without ``snip_edges`` frames are centred at the hops
    and the ends are mirrored."""
    width, hop = (max(1, round(rate * ms / 1000)) for ms in (window_ms, hop_ms))
    n_fft = 1 << (width - 1).bit_length()
    if not snip_edges and len(x) > n_fft // 2:
        x = np.pad(x, n_fft // 2, mode="reflect")
    if len(x) < n_fft + 19 * hop:
        return None
    shape = np.zeros(n_fft)
    left = (n_fft - width) // 2
    shape[left : left + width] = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / max(1, width - 1))) ** 0.85
    rows = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * shape
    power = np.abs(np.fft.rfft(rows, n_fft)) ** 2 @ mel_filters(rate, n_fft, mels).T
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10))
    db = np.nan_to_num(np.maximum(db, db.max() - 80), posinf=80.0, neginf=-80.0)
    return (db - mean) / (std + 1e-8) if mean is not None and std is not None else db - db.mean(axis=0)


def instance_normalised(x: np.ndarray) -> np.ndarray:
    """each bin by its own mean and deviation."""
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)


def features(chunked: DataFrame, rate: int = RATE, mels: int = 80) -> DataFrame:
    """chunks (session, chunk_idx, chunk) with ``features``: an array of rows, null for short chunks."""

    def run(column: pd.Series) -> pd.Series:
        out = [log_mel(np.asarray(x, float), rate, mels) for x in column]
        return pd.Series([None if m is None else [row.tolist() for row in m] for m in out])

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return chunked.withColumn("features", F.pandas_udf(run, "array<array<double>>")("chunk"))


def energy_activity(recorded: DataFrame, window: int, hop: int, above_db: float = -35.0, least: float = 0.8, rate: int = RATE) -> DataFrame:
    """W3c: (session, a, b) in seconds of stretches whose windows' mean square lies over ``above_db``."""
    from pyspark.sql import Window

    each = chunks(recorded, window, hop)
    energy = F.aggregate("chunk", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.greatest(F.size("chunk"), F.lit(1))
    loud = each.withColumn("_hit", 10 * F.log10(energy + 1e-12) > above_db).withColumn("_end", F.col("start") + F.size("chunk"))
    w = Window.partitionBy("session").orderBy("chunk_idx")
    new = (F.col("_hit") != F.lag("_hit").over(w)) | F.lag("_hit").over(w).isNull()
    runs = loud.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_hit")
    spans = runs.groupBy("session", "_run").agg((F.min("start") / rate).alias("a"), (F.max("_end") / rate).alias("b"))
    return spans.where(F.col("b") - F.col("a") >= least).select("session", "a", "b")


def segment_samples(recorded: DataFrame, activity: DataFrame, least: float = 0.3, rate: int = RATE) -> DataFrame:
    """Recordings and activity (session, a, b in seconds) -> session, a, b, samples of every interval that holds ``least``
    seconds of sound; intervals are cut at the recording's end, empty ones go. A hot session's intervals go to its recording as one list."""
    spans = activity.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_spans"))
    each = recorded.join(spans, "session").select("session", "samples", F.inline("_spans"))
    start, stop = (F.col(c) * rate for c in ("a", "b"))
    start, stop = (x.cast("bigint") for x in (start, stop))  # whole samples, cut off and not rounded
    n = F.least(stop, F.size("samples").cast("bigint")) - start
    held = each.withColumns({"_start": start, "_n": n}).where((F.col("_n") > 0) & (F.col("_n") >= int(least * rate)))
    return held.select("session", "a", "b", F.slice("samples", (F.col("_start") + 1).cast("int"), F.col("_n").cast("int")).alias("samples"))


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """(session, i, t, p, duration) of the .npz files under a path, with the arrays frame_times and spk_probs; without a
    duration_sec the last frame's time stands for it. An array file is one recording and goes to one task."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".npz"))

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(bytes(content))) as held:
                    t, p = held["frame_times"].astype(np.float32).astype(float), held["spk_probs"].astype(np.float32).astype(float)
                    last = float(t[-1]) if len(t) else 0.0
                    yield pd.DataFrame({"session": name, "i": np.arange(len(t)), "t": t, "p": pd.Series(list(p), dtype=object), "duration": float(held["duration_sec"]) if "duration_sec" in held else last})

    return files.select("path", "content").mapInPandas(run, "session string, i long, t double, p array<double>, duration double")
