"""Parameters of the engine: frozen records with the defaults of the original data set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KM_PER_MILE = 1.609344
METRES_PER_MILE = 1609.344
MILES_PER_KM = 0.621371
FEET_PER_METRE = 3.28084


@dataclass(frozen=True)
class Speed:
    """Walking speed by slope, and what scales it."""

    base_kmh: float = 6.0
    steepness: float = 3.5
    offset: float = 0.05
    off_trail: float = 0.60
    pace: float = 5.0 / (6.0 * MILES_PER_KM)
    least_kmh: float = 0.15


@dataclass(frozen=True)
class Topology:
    """Tolerances in metres."""

    snap: float = 18.0
    simplify: float = 0.5
    least_edge: float = 1.0
    road_reach: float = 250.0
    road_gap: float = 800.0
    least_road: float = 20.0


@dataclass(frozen=True)
class Elevation:
    """Metres."""

    sigma: float = 5.0
    step: float = 10.0
    buffer: float = 600.0
    resolution: float = 1.0


@dataclass(frozen=True)
class Race:
    """Budget in seconds; points per trail and mile, and their caps."""

    budget_s: float = 25_200.0
    per_trail: float = 1.0
    per_mile: float = 1.0
    trail_cap: float = 40.0
    mile_cap: float = 40.0


@dataclass(frozen=True)
class Params:
    speed: Speed = field(default_factory=Speed)
    topology: Topology = field(default_factory=Topology)
    elevation: Elevation = field(default_factory=Elevation)
    race: Race = field(default_factory=Race)

    def with_(self, **parts: dict) -> Params:
        """A copy with fields of its parts replaced: ``with_(race={"budget_s": 3600.0})``."""
        return replace(self, **{name: replace(getattr(self, name), **values) for name, values in parts.items()})
