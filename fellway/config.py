"""Constants of the cost model, the grid, the layers and the place search."""

import math

# Fixed values of the walking model.
STEEPNESS, DOWNHILL_BIAS, TOP_SPEED_KMH = 4.0, 0.05, 6.0
CROSS_SLOPE_WEIGHT = 2.0
STREAM_WEIGHT, STREAM_BUFFER_M = 1.5, 15.0
BRIDGE_BUFFER_M, BRIDGE_CENTRING = 8.0, 0.4
#: Places along a step at which water, streams and bridges are looked for.
SAMPLES = (0.25, 0.5, 0.75)
EARTH_KM, M_PER_DEGREE = 6371.0, 111_320.0

# Fixed values of the raster source.
MIN_ZOOM, MAX_ZOOM, TILE, PIXEL_M = 10, 15, 256, 156_543.03392

# Fixed values of grid planning and retries.
NODE_BUDGET, MIN_CELL_M, MAX_CELL_M, MIN_PAD_DEG = 2_000_000, 10.0, 1_000.0, 0.01
PADDING, GROWTH, ATTEMPTS, MAX_ATTEMPT_S = 0.3, 2.0, 3, 45.0

# Fixed values of the feature layers.
STREAM_CLASSES = ("river", "stream", "canal")
NO_FOOT_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link")
REGION = {"min_lat": -48.5, "min_lon": 165.0, "max_lat": -33.0, "max_lon": 180.0}
REGION_LAT = -41.0

# Fixed values of the place search.
MIN_CHARS, DEBOUNCE_MS, SHOWN, FETCHED, MAX_WAYPOINTS = 2, 350, 7, 12, 7
DEFAULT_ZOOM, HOUSE_ZOOM, STREET_ZOOM = 13, 17, 16

# The 16 directions (di, dj) in order of k, eight neighbours and then eight knight's moves.
DIRECTIONS = [
    (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1),
    (-2, -1), (-1, -2), (-2, 1), (-1, 2), (2, -1), (1, -2), (2, 1), (1, 2),
]

#: Degrees by which a stream corridor reaches out at a latitude: the smaller scale, in every direction.


def stream_buffer_deg(lat: float) -> float:
    return STREAM_BUFFER_M / (M_PER_DEGREE * min(1.0, math.cos(math.radians(lat))))
