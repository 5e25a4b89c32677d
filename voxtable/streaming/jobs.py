"""Arriving files and sliding windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "session long, t timestamp, speaker string, seconds double"


def arriving(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """R2: run ``work`` on each batch of arrived rows and write what it gives below ``out``, one folder a batch, so that a
    batch that runs again replaces its own output; ends when what is there has been processed."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def switch_windows(stream: DataFrame, window: str = "30 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Number of turns and seconds of each speaker in sliding windows; rows later than ``late`` are left out."""
    return (
        stream.withWatermark("t", late)
        .groupBy("session", F.window("t", window, step), "speaker")
        .agg(F.count("*").alias("turns"), F.sum("seconds").alias("seconds"))
        .select("session", F.col("window.start").alias("a"), F.col("window.end").alias("b"), "speaker", "turns", "seconds")
    )


def first_warnings(stream: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("t", late).dropDuplicatesWithinWatermark([key])


def running_state(stream: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The causal parts of decoding as state per session: an average that moves with each value, the time since the
    speaker changed. Rows of a batch are taken in order of time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        ema, speaker, since = state.get if state.exists else (None, None, None)
        rows = pd.concat(frames).sort_values("t")
        out = []
        for t, who, value in zip(rows["t"], rows["speaker"], rows["seconds"], strict=True):
            ema = value if ema is None else alpha * value + (1 - alpha) * ema
            if who != speaker:
                speaker, since = who, t.timestamp()
            out.append((key[0], t, who, ema, t.timestamp() - since))
        state.update((float(ema), speaker, float(since)))
        yield pd.DataFrame(out, columns=["session", "t", "speaker", "ema", "run_seconds"])

    return stream.groupBy("session").applyInPandasWithState(
        step, "session long, t timestamp, speaker string, ema double, run_seconds double", "ema double, speaker string, since double", "append", GroupStateTimeout.NoTimeout
    )
