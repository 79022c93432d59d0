"""Fixed-point coordinates and Web Mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1e7  # fixed units in a degree
ZOOM = 12  # of the index
MAX_LAT = 85.0511287798066  # where tile y reaches 0


def degrees(fixed: Column) -> Column:
    return fixed / F.lit(UNITS)


def fixed(deg: Column) -> Column:
    """Towards zero."""
    return (deg * F.lit(UNITS)).cast("int")


def x_tile(lon: Column, zoom: int | Column = ZOOM) -> Column:
    return F.floor((lon + 180) / 360 * _tiles(zoom)).cast("int")


def y_tile(lat: Column, zoom: int | Column = ZOOM) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * _tiles(zoom)).cast("int")


def _tiles(zoom: int | Column) -> Column:
    return F.lit(1 << zoom) if isinstance(zoom, int) else F.pow(F.lit(2), zoom)


def west(x: Column, zoom: int | Column) -> Column:
    return x / _tiles(zoom) * 360 - 180


def north(y: Column, zoom: int | Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() - 2 * F.pi() * y / _tiles(zoom))))


def rectangle(x: Column, y: Column, zoom: int | Column) -> Column:
    """West, south, width and height in degrees."""
    w, s = west(x, zoom), north(y + 1, zoom)
    return F.struct(w.alias("west"), s.alias("south"), (west(x + 1, zoom) - w).alias("width"), (north(y, zoom) - s).alias("height"))


def tile_of(lat: float, lon: float, zoom: int = ZOOM) -> tuple[int, int]:
    """One point's tile, for plans whose box is known; latitudes beyond the projection are clamped."""
    lat = min(MAX_LAT, max(-MAX_LAT, lat))
    r, n = math.radians(lat), 1 << zoom
    y = math.floor((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)
    return math.floor((lon + 180) / 360 * n), min(max(y, 0), n - 1)


def tile_range(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> tuple[int, int, int, int]:
    """min x, min y, max x, max y, inclusive; y runs from north to south."""
    if not (-90 <= min_lat < max_lat <= 90 and -180 <= min_lon < max_lon <= 180):
        raise ValueError(f"not a box: {min_lat},{min_lon},{max_lat},{max_lon}")
    x0, y0 = tile_of(max_lat, min_lon)
    x1, y1 = tile_of(min_lat, max_lon)
    return x0, y0, x1, y1


def is_box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Whether four columns are a box: within the globe, and not empty."""
    return F.coalesce((min_lat >= -90) & (min_lat < max_lat) & (max_lat <= 90) & (min_lon >= -180) & (min_lon < max_lon) & (max_lon <= 180), F.lit(False))


def parse_box(text: str) -> tuple[float, float, float, float]:
    """min lat, min lon, max lat, max lon, apart by commas or semicolons."""
    parts = text.replace(";", ",").split(",")
    if len(parts) != 4:
        raise ValueError("a box has four coordinates")
    box = tuple(float(p) for p in parts)
    tile_range(*box)
    return box  # type: ignore[return-value]
