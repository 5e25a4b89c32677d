"""One stage of a run by itself, for timing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import audio

STAGES = ("asr", "vad", "diar")


def run_stage(stage: str, recorded: DataFrame, work: Callable[[DataFrame], DataFrame], window: float = 1.5, hop: float = 0.75, rate: int = audio.RATE) -> dict:
    """Runs ``work`` to its end on what the stage reads: recordings for asr and vad, their windows (window and hop in seconds) for diar.
    Nothing of the result is kept. ``ok`` is false for unknown stages, which do not run, and for a diar stage without windows."""
    if stage not in STAGES:
        return {"stage": stage, "ok": False}
    given = recorded
    if stage == "diar":
        given = audio.chunks(recorded, int(window * rate), int(hop * rate))
        if given.isEmpty():
            return {"stage": stage, "ok": False}
    work(given).write.format("noop").mode("overwrite").save()
    return {"stage": stage, "ok": True}
