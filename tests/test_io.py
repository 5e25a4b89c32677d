"""Readers, writers and streams."""

import json
import wave

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from voxtable.config import RefineSettings
from voxtable.functions import text
from voxtable.plans import stages
from voxtable.sources import audio, frontend, sinks, transcripts
from voxtable.streaming import jobs


def test_transcript(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[00:00:05] SPEAKER_01:\nsecond\n\n[00:00:01.5] SPEAKER_00:\nfirst\nmore\n\nnot this\n")
    rows = transcripts.transcript(transcripts.lines(spark, str(tmp_path))).orderBy("seg_idx").collect()
    assert [(r.start, r.speaker, r.text) for r in rows] == [(1.005, "SPEAKER_00", "first more"), (5.0, "SPEAKER_01", "second")]


def test_tokens_and_header_times(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[00:00:01,000] SPEAKER_01: tok one\nnoise\n[00:00:02,000] SPEAKER_02: two")
    df = transcripts.lines(spark, str(tmp_path))
    assert [(r.pos, r.word, r.speaker) for r in transcripts.tokens(df).orderBy("pos").collect()] == [(0, "tok", "SPEAKER_01"), (1, "one", "SPEAKER_01"), (2, "two", "SPEAKER_02")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/b.txt").write_text("[00:00:01] SPEAKER_01:\nx\n[00:00:04] SPEAKER_02:\n[00:00:04] SPEAKER_00:")
    rows = transcripts.header_times(transcripts.lines(spark, str(tmp_path / "b")), 9.0).orderBy("start").collect()
    assert [(r.start, r.end, r.speaker) for r in rows] == [(1.0, 4.0, "SPEAKER_01"), (4.0, 9.0, "SPEAKER_00")]


def test_subtitles_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "SPEAKER_00", "hello", 0.5, 1.25), (1, 1, "SPEAKER_01", "you", 2.0, 3.0)], "session long, seg_idx long, speaker string, text string, t0 double, t1 double")
    sinks.write_texts(sinks.srt(s), str(tmp_path / "out"))
    rows = transcripts.subtitles(transcripts.lines(spark, str(tmp_path / "out" / "session=1"))).orderBy("n").collect()
    assert [(r.start, r.end, r.text) for r in rows] == [(0.5, 1.25, "SPEAKER_00:\nhello"), (2.0, 3.0, "SPEAKER_01:\nyou")]


def test_text_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "SPEAKER_00", "hello", 0.0, 1.0), (1, 1, "SPEAKER_01", "you", 2.0, 3.0)], "session long, seg_idx long, speaker string, text string, t0 double, t1 double")
    sinks.write_texts(sinks.txt(s), str(tmp_path / "out"))
    rows = transcripts.transcript(transcripts.lines(spark, str(tmp_path / "out" / "session=1"))).orderBy("seg_idx").collect()
    assert [(r.start, r.speaker, r.text) for r in rows] == [(0.0, "SPEAKER_00", "hello"), (2.0, "SPEAKER_01", "you")]


def test_events(spark, tmp_path):
    event = {"v": 2, "event_type": "switch", "frame": 7, "time": 0.14, "frames": [{"i": 6, "cp": 0.1}, {"i": 7, "cp": 0.9, "dp_cost_terms": {"vad": 1.5}}]}
    (tmp_path / "e.jsonl").write_text(json.dumps(event) + "\n")
    (r,) = transcripts.event_rows(transcripts.events(spark, str(tmp_path / "e.jsonl"))).collect()
    assert (r.found, r.cp, r.term_vad) == (True, 0.9, 1.5)
    sinks.write_events_tsv(transcripts.event_rows(transcripts.events(spark, str(tmp_path / "e.jsonl"))), ["event_type", "cp", "margin"], str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first().asDict() == {"event_type": "switch", "cp": "0.900000", "margin": "NA"}


def test_segment_lists_and_comparisons(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"start_sec": 1, "end_sec": 2}, {"start_sample": 5, "end_sample": 9}, {"start": 0.5, "end": 0.5}]))
    rows = transcripts.segment_lists(spark, str(tmp_path / "s.json")).collect()
    assert [(r.a, r.b) for r in rows] == [(16000, 32000), (5, 9)]
    (tmp_path / "c.json").write_text(json.dumps({"silero": {"times": [0.0, 0.1], "probs": [0.2, 0.3]}, "ten": {"times": [0.0], "probs": [0.9]}}))
    assert transcripts.comparisons(spark, str(tmp_path / "c.json")).count() == 3


def test_events_pass_over_other_values(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"frame": 3, "event_type": "switch"}\n\n[1, 2]\n"x"\n7\n {"frame": 4}\n')
    assert sorted(r.frame for r in transcripts.events(spark, str(tmp_path / "e.jsonl")).collect()) == [3, 4]
    (tmp_path / "bad.jsonl").write_text('{"frame": 3}\n{"frame": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        transcripts.events(spark, str(tmp_path / "bad.jsonl")).collect()


def test_presets():
    plain = RefineSettings()
    assert RefineSettings.preset("AGGRESSIVE").max_candidates == 60 and RefineSettings.preset("none such") == plain
    own = RefineSettings(window_sec=3.0)
    assert RefineSettings.preset("conservative", own) == own and RefineSettings.preset("conservative", plain).switch_scale == 0.5
    with pytest.raises(ValueError):
        RefineSettings(short_hop_sec=0.0)


def test_report_intervals(spark, tmp_path):
    (tmp_path / "r.txt").write_text("=== Wrong (HOST as GUEST) ===\n  count : 2\n 0 1.0 2.0 1.0\n 1 2.0 3.0 1.0\n=== Other section ===\n 0 7.0 8.0 1.0\n")
    rows = transcripts.report_intervals(transcripts.lines(spark, str(tmp_path)), "as GUEST").collect()
    assert [(r.t0, r.t1) for r in rows] == [(1.0, 3.0)]


def test_wave_and_windows(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(np.repeat((np.sin(np.arange(8000) / 5) * 20000).astype("<i2"), 2).tobytes())
    (r,) = audio.recordings(spark, str(tmp_path)).collect()
    assert r.sr == 16000 and len(r.samples) == 16000 and 0.5 < max(r.samples) < 0.7
    small = spark.createDataFrame([("a", list(map(float, range(5)))), ("b", [])], "session string, samples array<float>")
    assert [(c.start, c.chunk) for c in audio.chunks(small, 3, 2).orderBy("start").collect()] == [(0, [0, 1, 2]), (2, [2, 3, 4]), (4, [4])]
    assert [(c.session, c.a, c.b) for c in audio.full_windows(small, 2, 2).orderBy("session", "a").collect()] == [("a", 0, 2), ("a", 2, 4), ("b", 0, 0)]
    assert audio.range_grid(0.0, 2.1, 1.0, 1.0) == [(0.0, 1.0), (1.0, 2.0)]
    mel = audio.log_mel(np.sin(np.arange(16000) * 2 * np.pi * 1000 / 16000))
    assert mel.shape[1] == 80 and abs(mel.mean()) < 1e-9 and audio.log_mel(np.zeros(100)) is None


def _turns(tmp_path):
    rows = pd.DataFrame({"session": 1, "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(60), "s"), "speaker": ["a", "b"] * 30, "seconds": 1.0})
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows.iloc[k * 20 : k * 20 + 20].to_parquet(tmp_path / "in" / f"{k}.parquet", coerce_timestamps="us")
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = _turns(tmp_path)
    stream = jobs.arriving(spark, str(tmp_path / "in"), files_per_batch=1)
    jobs.process(stream, lambda df: df.groupBy("speaker").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy().sum("count").first()[0] == len(rows)
    q = jobs.switch_windows(stream).writeStream.format("memory").queryName("zones").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = jobs.switch_windows(spark.read.schema(jobs.EVENT_SCHEMA).parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("zones").collect())) == sorted(map(tuple, batch.collect()))


def test_running_state(spark, tmp_path):
    rows = _turns(tmp_path)
    q = jobs.running_state(jobs.arriving(spark, str(tmp_path / "in"), files_per_batch=1)).writeStream.format("memory").queryName("running").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").count() == len(rows)
    assert spark.table("running").where("abs(ema - 1) > 1e-9").count() == 0


def test_mel_filters():
    m = audio.mel_filters(16000, 512, 40)
    f = np.fft.rfftfreq(512, 1 / 16000)
    peaks = f[m.argmax(axis=1)]
    # linear below 1 kHz, a constant ratio above; areas are about one
    low, high = peaks[peaks < 900], peaks[peaks > 2500]
    assert np.ptp(np.diff(low)) <= 63 and np.allclose(high[1:] / high[:-1], np.median(high[1:] / high[:-1]), rtol=0.05)
    assert np.allclose(m[20:].sum(axis=1) * f[1], 1, atol=0.05)
    x = np.random.default_rng(3).normal(size=16000)
    assert len(audio.log_mel(x)) == 1 + (16000 - 512) // 160 and len(audio.log_mel(x, snip_edges=False)) == 101
    assert np.allclose(audio.log_mel(x, mean=np.zeros(80), std=np.full(80, 0.5)).max(), 0)


def test_segment_samples(spark):
    recorded = spark.createDataFrame([("x", [float(i) for i in range(100)]), ("y", [1.0])], "session string, samples array<float>")
    activity = spark.createDataFrame([("x", 0.0, 2.95), ("x", 9.5, 20.0), ("x", 9.8, 20.0), ("x", 3.0, 3.0), ("x", 50.0, 60.0), ("z", 0.0, 1.0)], "session string, a double, b double")
    out = audio.segment_samples(recorded, activity, rate=10).orderBy("a").collect()
    assert [(r.session, r.a, r.samples) for r in out] == [("x", 0.0, [float(i) for i in range(29)]), ("x", 9.5, [95.0, 96.0, 97.0, 98.0, 99.0])]


def test_posteriors(spark, tmp_path):
    p = np.array([[0.25, 0.75], [0.5, 0.5]])
    np.savez(tmp_path / "a.npz", frame_times=[0.0, 0.5], spk_probs=p, duration_sec=9.0)
    np.savez(tmp_path / "b.npz", frame_times=[0.0, 0.5], spk_probs=p)
    np.savez(tmp_path / "c.npz", frame_times=[], spk_probs=np.zeros((0, 2)))
    rows = audio.read_posteriors(spark, str(tmp_path))
    assert [(r.session[-5:], r.i, r.t, r.p, r.duration) for r in rows.orderBy("session", "i").collect()] == [
        ("a.npz", 0, 0.0, [0.25, 0.75], 9.0), ("a.npz", 1, 0.5, [0.5, 0.5], 9.0), ("b.npz", 0, 0.0, [0.25, 0.75], 0.5), ("b.npz", 1, 0.5, [0.5, 0.5], 0.5),
    ]
    sinks.write_posteriors(rows, str(tmp_path / "out"))
    assert sorted((r.i, r.t, r.duration) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0.0, 0.5), (0, 0.0, 0.5), (1, 0.5, 0.5), (1, 0.5, 0.5)]


def test_wide_wrap_and_log_lines(spark):
    df = spark.createDataFrame([("あいうab",), ("abcde",), ("",), (None,), ("aあ😀b",)], "t string")
    assert [r[0] for r in df.select(text.wrapped_wide(F.col("t"), 4)).collect()] == ["あい\nうab", "abcd\ne", "", None, "aあ😀\nb"]
    assert [r[0] for r in df.select(text.wrapped_wide(F.col("t"), 1)).collect()][:2] == ["\nあ\nい\nう\na\nb", "a\nb\nc\nd\ne"]
    assert df.select(text.wrapped_wide(F.col("t"), 0).alias("w")).first().w == "あいうab"
    lines = ["12:00:01-INFO-x: y", "2024-01-01 10:00:00,123 - ERROR - a: b", "2024-01-01T10:00:00 [WARNING] m: z", "[STDERR] e", "[SENTINEL] s", "plain", " [STDOUT] late", "12:00:01-NOTE-x: y"]
    told = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(text.is_log_line(F.col("x")))
    assert [r[0] for r in told.collect()] == [True] * 5 + [False] * 3
    kept = spark.createDataFrame([("[TRACE-ALIGNER] a",), ("a [TRACE-ALIGNER]",)], "x string")
    assert [tuple(r) for r in kept.select(text.is_kept(F.col("x")), text.is_kept(F.col("x"), True)).collect()] == [(False, True), (True, True)]


def test_upper_bound_report(spark):
    pairs = spark.createDataFrame([(1, "GUEST", "GUEST", 6.0), (1, "GUEST", "HOST", 2.0), (1, "HOST", "HOST", 12.0)], "session int, gold string, pred string, seconds double")
    mapping = spark.createDataFrame([(1, 1, "GUEST"), (1, 0, "HOST")], "session int, cluster int, role string")
    lines = sinks.upper_bound_report(pairs, mapping, 10.0).first().report.split("\n")
    assert lines[1:6] == ["- Frame step        : 0.100 sec (10.0 Hz)", "- Total frames      : 200  (20.0 sec)", "- Best cluster→role mapping (0=GUEST, 1=HOST): cluster_0→1 (HOST), cluster_1→0 (GUEST)", "", "Upper-bound accuracy: 0.9000"]
    assert lines[8:11] == ["  gold\\pred   GUEST       HOST", "  GUEST          6.0       2.0", "  HOST           0.0      12.0"]
    assert lines[13:] == ["  GUEST: 0.7500  (correct 6.0s / total 8.0s)", "  HOST : 1.0000  (correct 12.0s / total 12.0s)"]


def test_front_end(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert frontend.front_end(deep / "m.onnx") == (frontend.FrontEnd(), None)
    (tmp_path / "config.yaml").write_text("frontend:\n  fbank: {num_mel_bins: 40, snip_edges: false}\n")
    assert frontend.settings_file(deep) == tmp_path.resolve() / "config.yaml"
    assert frontend.settings_file(deep / "1" / "2" / "3" / "4") is None
    if frontend.yaml is not None:
        assert frontend.front_end(deep / "m.onnx")[0] == frontend.FrontEnd(num_mel_bins=40, snip_edges=False)
    assert frontend.global_norm(tmp_path) is None
    (tmp_path / "mean_std.json").write_text("{}")
    (tmp_path / "cmvn.json").write_text(json.dumps({"mean": [1, 2], "std": [3, 4]}))
    assert [list(x) for x in frontend.global_norm(tmp_path)] == [[1, 2], [3, 4]] and frontend.global_norm(tmp_path, wanted=False) is None


def test_stages(spark):
    recorded = spark.createDataFrame([("x", [0.5] * 40)], "session string, samples array<float>")
    seen = []
    work = lambda df: seen.append(df.columns) or df
    assert [stages.run_stage(s, recorded, work, rate=10)["ok"] for s in ("asr", "vad", "diar", "other")] == [True, True, True, False]
    assert seen == [["session", "samples"]] * 2 + [["session", "chunk_idx", "start", "chunk"]]
    assert stages.run_stage("diar", recorded.limit(0), work, rate=10) == {"stage": "diar", "ok": False}
