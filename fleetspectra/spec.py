"""What a load spectrum is made of: axes, filters and weights, as plain data."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Axis:
    """Half-open bins ``[start + i*width, start + (i+1)*width)`` up to ``stop``."""

    signal: str
    start: float
    stop: float
    width: float

    def __post_init__(self) -> None:
        if self.width <= 0 or self.stop <= self.start:
            raise ValueError(f"axis {self.signal}: needs width > 0 and stop > start")

    @property
    def whole(self) -> bool:
        """True when every edge is an integer, so doubles bin exactly."""
        return float(self.start).is_integer() and float(self.width).is_integer()

    @property
    def bins(self) -> int:
        return math.ceil(round((self.stop - self.start) / self.width, 9))


@dataclass(frozen=True)
class SpectrumSpec:
    """One histogram over one or more signals.

    ``filters`` are SQL predicates; they are and-ed, and their texts joined
    with `` AND `` are the description kept in the metadata.
    ``out_of_range`` says what happens to a reading beyond the axis:
    ``"drop"`` it or ``"clip"`` it into the first or last bin.
    ``keep_null`` keeps rows without a reading in a bin of their own.
    """

    title: str
    axes: tuple[Axis, ...]
    filters: tuple[str, ...] = ()
    tag: str = ""
    out_of_range: str = "drop"
    keep_null: bool = False

    def __post_init__(self) -> None:
        if not self.axes:
            raise ValueError(f"spectrum {self.title}: needs at least one axis")
        if self.out_of_range not in ("drop", "clip"):
            raise ValueError(f"spectrum {self.title}: out_of_range is drop or clip")

    @property
    def description(self) -> str:
        return " AND ".join(self.filters)


@dataclass(frozen=True)
class CleanRule:
    """How one signal is cleaned.

    A reading is good when ``valid`` (a SQL predicate) holds. A bad one is
    replaced by the vehicle's last good reading if that is at most ``limit_s``
    seconds old, else by ``fill``. ``limit_s=0`` only masks.
    """

    signal: str
    valid: str
    limit_s: int = 10
    fill: float | None = None
    suffix: str = "_cleaned"

    @property
    def output(self) -> str:
        return self.signal + self.suffix


# The axes, filters and titles the fleet spectra are defined by.
def vehicle_specs(speed: str, weight: str, gradient: str) -> list[SpectrumSpec]:
    """Speed, gross weight and absolute road gradient, one axis each."""
    return [
        SpectrumSpec(
            "VehSpd - high resolution",
            (Axis(speed, 0, 160, 1),),
            (f"`{speed}` >= 0", f"`{speed}` <= 200"),
            "Entire vehicle",
        ),
        SpectrumSpec(
            "GroCmbVehWeight",
            (Axis(weight, 0, 100000, 1000),),
            (f"`{speed}` > 0",),
            "Entire vehicle",
        ),
        SpectrumSpec(
            "Road_gradient_absolute_value",
            (Axis(gradient, 0, 25, 1),),
            (f"`{speed}` > 0",),
            "Entire vehicle",
        ),
    ]


def engine_spec(rpm: str, torque: str, speed: str) -> SpectrumSpec:
    """Engine speed by torque."""
    return SpectrumSpec(
        "EngTrq – EngRPM",
        (Axis(rpm, 0, 5000, 50), Axis(torque, -3000, 3000, 50)),
        (f"`{speed}` > 0",),
        "Engine",
    )
