"""Settings of an acoustic front end, found beside a model: driver-side, once a model."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np

try:
    import yaml
except ImportError:  # settings files are then not read
    yaml = None


# The defaults and the names of the fields in a settings file.
@dataclass(frozen=True)
class FrontEnd:
    sample_rate: int = 16_000
    frame_length: float = 25.0
    frame_shift: float = 10.0
    num_mel_bins: int = 80
    window_type: str = "povey"
    snip_edges: bool = True
    dither: float = 1.0  # read for other front ends; log_mel adds no noise


def settings_file(folder: Path) -> Path | None:
    """The nearest config.yaml in a folder or its four nearest parents."""
    folder = Path(folder).resolve()
    return next((at / "config.yaml" for at in (folder, *folder.parents)[:5] if (at / "config.yaml").exists()), None)


def front_end(model: Path) -> tuple[FrontEnd, Path | None]:
    """The settings for a model file and where they stand; the defaults and None if no file is found or it cannot be read."""
    found = settings_file(Path(model).parent)
    if found is None or yaml is None:
        return FrontEnd(), None
    try:
        given = (yaml.safe_load(found.read_text(encoding="utf-8")).get("frontend") or {}).get("fbank") or {}
        return FrontEnd(**{f.name: type(f.default)(given[f.name]) for f in fields(FrontEnd) if f.name in given}), found
    except (AttributeError, OSError, TypeError, ValueError, yaml.YAMLError):
        return FrontEnd(), None


def global_norm(folder: Path, wanted: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, std) of mean_std.json, else cmvn.json; None (each clip by its own mean) if neither holds two lists."""
    for name in ("mean_std.json", "cmvn.json") if wanted else ():
        try:
            held = json.loads((Path(folder) / name).read_text(encoding="utf-8"))
            mean, std = (np.asarray(held[k], np.float32) for k in ("mean", "std"))
        except (KeyError, OSError, TypeError, ValueError):
            continue
        if mean.ndim == std.ndim == 1:
            return mean, std
    return None
