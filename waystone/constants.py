"""Thresholds and parameter tables of the trajectory operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
EARTH_KM = 6371.0088
MERCATOR_R = 6378137.0
MERCATOR_E = 20037508.342789244
MAX_LAT, MAX_LON = 85.05112878, 180.0
MILE = 0.621371192237334

OFFSET_SLACK_MS = 60_000
DIRECTION_MS = 36 * 3_600_000
EXCURSION_MS = 12 * 3_600_000
EXCURSION_KM, REJOIN_KM, EXCURSION_KMH, LONGEST_RUN = 500.0, 200.0, 1300.0, 3
SPIKE_MS, SPIKE_KM, SPIKE_REJOIN_KM, SPIKE_KMH = 20 * 60_000, 0.5, 0.2, 250.0
STATIONARY_MS, STATIONARY_KM = 10 * 60_000, 0.025
GAP_MS = 30 * 60_000
ACCURACY_M = 100.0

LOCAL_HOP_KM = 120.0
THRESHOLD_LOW_KM, THRESHOLD_HIGH_KM = 60.0, 120.0
DENSIFY_KM, DENSIFY_MOST = 75.0, 320
BLOCK_ROWS = 256
#: Points of a node of the camera's bounds, nodes of one on the next level, and levels above the points.
NODE_FAN, NODE_LEVELS = 4, 8
#: Rows of a journey that a camera's task holds in memory, others in a file, and journeys that are smoothed at once.
JOURNEY_HELD, JOURNEY_BATCH = 1 << 20, 128

POLAR_CORE, POLAR_CORRIDOR = 70.0, 50.0
DRAWN_PX = 1.35
OVERVIEW_EDGE, PREVIEW_EDGE = 1080, 240
#: The overlay's card on a grid of 720 by 720: its top, its bottom and the room left at its sides.
OVERLAY_EDGE, CARD_TOP, CARD_BOTTOM, CARD_INSET = 720, 28, 132, 34
STALE_MS = 7 * 24 * 3_600_000
REQUEST_VERSION, REQUEST_POINTS = 8, 2_000_000

CAMERA_SAMPLES = 480
CAMERA_ASPECT = 1.0
DEAD_ZONE = 0.20
FIXED_PERCENTILE = 0.80
ZOOM_HYSTERESIS = 0.15
ZOOM_LOW, ZOOM_HIGH = 2, 15
SPAN_MAX, SPAN_FLOOR, CONTENT_FLOOR = 0.72, 0.0003, 0.00015
OVERVIEW_PAD, OVERVIEW_SPAN_MAX = 1.22, 1.25
TRANSFER_PAD = 2.8
TILE_PX, TILES_MOST = 256, 25
TRAIL_S, TRAIL_LOW_KM, TRAIL_HIGH_KM = 2.5, 80.0, 2000.0
OUTRO_S, OUTRO_TRANSITION_S = 1.5, 1.0


@dataclass(frozen=True)
class Movement:
    """A camera movement profile."""

    fraction: float
    low_km: float
    high_km: float
    pad: float
    min_span: float
    zoom_out: float
    zoom_in: float
    leg_aware: bool
    fixed: bool


# Fixed values.
MOVEMENTS = {
    "fixed": Movement(0.10, 25, 350, 2.6, 0.00060, 0.0, 0.0, False, True),
    "steady": Movement(1.00, 650, 650, 2.8, 0.00060, 0.14, 0.035, False, False),
    "dynamic": Movement(0.10, 100, 350, 2.2, 0.00045, 0.24, 0.06, True, False),
    "close_up": Movement(0.035, 15, 120, 1.7, 0.00030, 0.30, 0.075, True, False),
}
PACING = {"off": 1.00, "balanced": 0.85, "strong": 0.75, "stronger": 0.65}
DETECTION = {"conservative": 1.35, "balanced": 1.00, "sensitive": 0.70}
FRAMING = {"off": None, "balanced": 1.00, "close": 0.78}
#: (aspect, resolution, width, height, frames a second, bits a second)
FORMATS = (
    ("square", "480", 480, 480, 24, 2_500_000),
    ("square", "720", 720, 720, 24, 5_000_000),
    ("square", "1080", 1080, 1080, 24, 8_000_000),
    ("portrait", "480", 480, 854, 24, 3_500_000),
    ("portrait", "720", 720, 1280, 24, 7_000_000),
    ("portrait", "1080", 1080, 1920, 30, 12_000_000),
    ("landscape", "480", 854, 480, 24, 3_500_000),
    ("landscape", "720", 1280, 720, 24, 7_000_000),
    ("landscape", "1080", 1920, 1080, 30, 12_000_000),
)
