"""Joins of exploded frames are not broadcast: their size is known only when they run, and a driver would have to hold them."""

import pytest

from voxtable.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["A6_segment_confidence", "J3_chunk_frame_mean", "J3b_chunk_or_nearest", "O6_event_union", "P3_speech_gated_chunks", "W7a_islands"])
def test_frames_are_not_broadcast(spark, name):
    df = catalog.queries()[name](spark, DATA)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _exploded_under_broadcasts(plan: str) -> list[str]:
    """The explodes that a broadcast takes in without a shuffle between, which would have told Spark their size."""
    found, broadcast, shuffle = [], None, None
    for line in plan.split("== Initial Plan ==")[0].splitlines():
        deep = len(line) - len(line.lstrip(" :+-"))
        broadcast = None if broadcast is not None and deep <= broadcast else broadcast
        shuffle = None if shuffle is not None and deep <= shuffle else shuffle
        if "BroadcastExchange" in line and shuffle is None:
            broadcast = deep
        elif "Exchange " in line and broadcast is not None and shuffle is None:
            shuffle = deep
        elif "Generate explode" in line and broadcast is not None and shuffle is None:
            found.append(line.strip())
    return found


def test_confidences_of_islands_broadcast_no_frames(spark):
    df = catalog.queries()["W7b_island_confidence"](spark, DATA)
    df.collect()
    assert _exploded_under_broadcasts(df._jdf.queryExecution().executedPlan().toString()) == []
