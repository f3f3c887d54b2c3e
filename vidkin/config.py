"""Settings of signature building and of comparison."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

# Fixed values of the data model.
HASH_BITS = 1000
FRAME_SIDE = 16
FRAMES = 16
KEPT = 10
CACHE_VERSION = 1
EXTENSIONS = "mp4 mkv avi mov wmv flv webm m4v mpg mpeg ts mts m2ts vob 3gp ogv rm rmvb divx".split()


@dataclass(frozen=True)
class Timeout:
    base: float = 10.0
    factor: float = 5.0
    min: float = 60.0
    max: float = 360.0

    def seconds(self, duration: float) -> float:
        low = max(self.min, 0.0)
        return min(max(duration * self.factor + self.base, low), max(self.max, low))


@dataclass(frozen=True)
class SignatureConfig:
    skip_secs: float = 15.0
    window_count: int = 5
    window_secs: float = 6.0
    cropdetect: bool = True
    audio_fingerprint: bool = False
    timeout: Timeout = field(default_factory=Timeout)

    def __post_init__(self) -> None:
        if self.window_count < 1:
            raise ValueError("window_count must be at least 1")


@dataclass(frozen=True)
class CompareConfig:
    tolerance: float = 0.30
    duration_tolerance_pct: float = 20.0
    min_matching_windows: float = 0.6
    subclip_min_match: float = 0.5
    use_audio: bool = False
    audio_max_difference: float = 3.0
    audio_min_segment_duration: float = 5.0
    hash_bits: int = HASH_BITS


@dataclass(frozen=True)
class Settings:
    """What a user keeps between runs; absent keys and unreadable files give defaults."""

    tolerance: float = 0.15
    duration_tolerance_pct: float = 20.0
    min_matching_windows: float = 0.6
    subclip_min_match: float = 0.5
    window_count: int = 5
    skip_secs: float = 15.0
    cropdetect: bool = True
    use_audio: bool = False
    audio_max_difference: float = 3.0
    audio_min_segment_duration: float = 5.0
    last_directory: str = ""
    dark_theme: bool = True

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        try:
            found = json.loads(Path(path).read_text())
            return cls(**{k: v for k, v in found.items() if k in {f.name for f in dataclasses.fields(cls)}})
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=2))

    def compare(self) -> CompareConfig:
        return CompareConfig(self.tolerance, self.duration_tolerance_pct, self.min_matching_windows, self.subclip_min_match, self.use_audio, self.audio_max_difference, self.audio_min_segment_duration)

    def signature(self) -> SignatureConfig:
        return SignatureConfig(self.skip_secs, self.window_count, cropdetect=self.cropdetect, audio_fingerprint=self.use_audio)
