"""Thresholds of a run, derived from one tolerance."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The earth model that distances and areas are defined by.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE_LAT = 110_574.0
METRES_PER_DEGREE_LON = 111_320.0
MIN_COSINE = 0.01
MAX_LATITUDE = 89.999
EPSILON = 2.220446049250313e-16

# Limits of the checks.
CONTACT_M = 1e-6
OVERLAP_M2 = 1e-8
GAP_TOLERANCES = 3.0
GAP_MAX_WIDTH_M = 50.0
GAP_MAX_WIDTH_RATIO = 0.1
GAP_MIN_SHARED_RATIO = 0.5
GAP_MAX_ANGLE_DEG = 5.0
GAP_FULL_EDGE_RATIO = 0.98
LINE_MAX_ERROR_M = 100.0
LINE_MAX_ERROR_RATIO = 0.25
ENDPOINT_FRACTION = 1e-9
SPIKE_ANGLE_DEG = 10.0
SPIKE_LEG_RATIO = 3.0
SPIKE_STRONG_RATIO = 10.0
SLIVER_COMPACTNESS = 0.1
SLIVER_AREA_TOLERANCES = 10.0
NEIGHBOUR_M = 1e-4
PRECISION_PLACES = 9
MAX_SAFE_INTEGER = 9007199254740991


@dataclass(frozen=True)
class Options:
    """tolerance_mm: in (0, 100000]; places: decimal places of coordinates, 0 to 15."""

    tolerance_mm: float = 25.0
    places: int = PRECISION_PLACES

    def __post_init__(self) -> None:
        if not (math.isfinite(self.tolerance_mm) and 0 < self.tolerance_mm <= 100_000):
            raise ValueError("tolerance_mm must be above 0 and at most 100000")
        if not (isinstance(self.places, int) and 0 <= self.places <= 15):
            raise ValueError("places must be an integer from 0 to 15")

    @property
    def tolerance_m(self) -> float:
        return self.tolerance_mm / 1000

    @property
    def area_m2(self) -> float:
        """Below this a polygon is tiny or a sliver."""
        return (SLIVER_AREA_TOLERANCES * self.tolerance_m) ** 2

    @property
    def gap_m(self) -> float:
        return GAP_TOLERANCES * self.tolerance_m
