"""Parameters of the detectors and rules; the defaults are fixed values of the sensors' field tests."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DipParams:
    """Dips of the feature table: below `baseline`; closer than `merge_gap_ms` is one dip; shorter ones are dropped."""

    baseline: float = 220.0
    merge_gap_ms: int = 300
    min_duration_ms: int = 200
    box_fill: float = 0.65
    flat_plateau: float = 0.05


@dataclass(frozen=True)
class EventParams:
    """Events of the batch counter: line = baseline - offset, an event closes once the gap is longer than `gap_ms`."""

    baseline: float = 225.0
    offset: float = 10.0
    gap_ms: int = 300
    min_seconds: float = 0.5
    max_seconds: float = 10.0
    min_height: float = 30.0
    max_variance: float = 4800.0
    max_gradient: float = 35.0

    @property
    def line(self) -> float:
        return self.baseline - self.offset


@dataclass(frozen=True)
class LiveParams(EventParams):
    """The live counter: a shorter gap, and a baseline from the most common distance while calibrating."""

    gap_ms: int = 200
    calibration_ms: int = 60_000
    bins: int = 5_000
    bin_limit: int = 65_535
    buffer: int = 5_000


@dataclass(frozen=True)
class CompactParams:
    """The compact detector: baseline = mean of the first samples, events are samples below the line alone."""

    calibration_samples: int = 50
    offset: float = 15.0
    min_duration_ms: int = 200
    max_variance: float = 3070.0
    capacity: int = 500


@dataclass(frozen=True)
class TrackParams:
    """Tracking and counting of boxes."""

    fps: float = 30.0
    retention_frames: int = 60
    similarity: float = 0.6
    vehicle_seconds: float = 1.0
    min_aspect: float = 0.3
    max_aspect: float = 3.0
    max_area_cv: float = 0.15
    person_seconds: float = 0.5
    other_seconds: float = 0.5


#: Classes of detections that count, by id.
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car"}
MIN_CONFIDENCE = 0.5
#: Published single-threshold rules for vehicles.
RULE_VARIANCE, RULE_GRADIENT = 3070.0, 21.08
#: The nine features of the tree models, in order.
FEATURES = ("dip_duration_seconds", "min_depth", "avg_depth", "line_integral", "avg_depth_gradient", "depth_variance", "dip_height", "fill_factor", "plateau_variance")
