"""Settings of the operators, checked when made. A settings object is a plain value; to_dict() serialises it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie within {low} and {high}, not {value}")


@dataclass(frozen=True)
class AlignSettings:
    """Of the frame and word decoders. The defaults."""

    hz: float = 50.0
    alpha: float = 0.6
    beta: float = 0.8
    gamma: float = 0.5
    delta: float = 1.5
    run_threshold: float = 1.0
    run_cap: float = 8.0
    run_scale: float = 0.35
    silence_reset: bool = True
    silence_vad: float = 0.35
    silence_reset_sec: float = 0.20
    cp_k: float = 1.0
    cp_floor: float = 1.0
    uncertain_mult: float = 1.5
    uncertain_entropy: float = 0.99
    uncertain_margin: float = 0.10
    hysteresis_sec: float = 6.0
    hysteresis_mult: float = 5.0
    post_k: float = 2.0
    post_margin: float = 0.5
    ten_weight: float = 0.0
    negated_start: bool = True
    rollback_sec: float = 1.5
    rollback_margin: float = 0.015
    rollback_run_sec: float = 0.5
    word_switch_scale: float = 0.3
    word_gap_sec: float = 0.25
    word_gap_scale: float = 0.7
    log_emissions: bool = True

    def __post_init__(self):
        for name in ("alpha", "beta", "gamma", "delta", "cp_k", "cp_floor", "post_k", "run_scale"):
            _within(name, getattr(self, name), 0.0, 100.0)
        _within("hz", self.hz, 0.1, 1000.0)
        _within("post_margin", self.post_margin, 0.0, 1.0)


@dataclass(frozen=True)
class ClusterSettings:
    min_speakers: int = 2
    max_speakers: int = 8
    target_speakers: int | None = None
    em_schedule: tuple[float, ...] = (10.0, 5.0, 3.0)
    least_mass: float = 0.05
    merge_similarity: float = 0.90
    seed: int = 42
    restarts: int = 10

    def normalised(self) -> ClusterSettings:
        """A target fixes both bounds; the upper bound is never under the lower."""
        from dataclasses import replace

        if self.target_speakers is not None:
            n = max(1, int(self.target_speakers))
            return replace(self, min_speakers=n, max_speakers=n, target_speakers=n)
        return replace(self, max_speakers=max(self.min_speakers, self.max_speakers))


@dataclass(frozen=True)
class TimelineSettings:
    coverage: float = 0.97
    merge_gap: float = 0.3
    longest_island: float = 3.0
    island_margin: float = 0.05
    zone_window: float = 30.0
    zone_step: float = 10.0
    zones: bool = False

    def __post_init__(self):
        _within("coverage", self.coverage, 0.0, 1.0)
        _within("zone_window", self.zone_window, 1.0, 3600.0)


@dataclass(frozen=True)
class RefineSettings:
    """Of the refinement around candidate boundaries (U6). The defaults and the presets."""

    max_candidates: int = 40
    merge_sec: float = 0.5
    merge_widest_sec: float = 2.0
    window_sec: float = 1.0
    use_switches: bool = True
    use_marks: bool = True
    marks: str = "?？。."
    short_window_sec: float = 0.5
    short_hop_sec: float = 0.25
    local_decoding: bool = True
    switch_scale: float = 0.3
    least_frames: int = 3

    def __post_init__(self):
        for name in ("merge_widest_sec", "window_sec", "short_window_sec", "short_hop_sec"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be over 0, not {getattr(self, name)}")
        for name, least in (("merge_sec", 0), ("switch_scale", 0), ("max_candidates", 1), ("least_frames", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} at least, not {getattr(self, name)}")

    @classmethod
    def preset(cls, name: str | None = "default", own: RefineSettings | None = None) -> RefineSettings:
        """The settings in force: ``own`` as a whole, unless it is missing, or nothing but the defaults beside another preset.
        Names are read without regard to case; unknown ones mean the default."""
        known = (name or "default").lower()
        if own is not None and (known == "default" or own != cls()):
            return own
        return cls(**PRESETS.get(known, {}))


PRESETS = {
    "default": {},
    "conservative": {"max_candidates": 20, "merge_sec": 0.4, "merge_widest_sec": 1.5, "window_sec": 0.8, "short_window_sec": 0.4, "short_hop_sec": 0.2, "switch_scale": 0.5},
    "aggressive": {"max_candidates": 60, "merge_sec": 0.6, "merge_widest_sec": 2.5, "window_sec": 1.2, "short_window_sec": 0.6, "short_hop_sec": 0.3, "switch_scale": 0.2},
}


@dataclass(frozen=True)
class Settings:
    align: AlignSettings = field(default_factory=AlignSettings)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)
    timeline: TimelineSettings = field(default_factory=TimelineSettings)
    refine: RefineSettings = field(default_factory=RefineSettings)

    def to_dict(self) -> dict:
        return asdict(self)
