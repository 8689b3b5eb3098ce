"""Column builders for points, boxes, rings and grid cells.

Longitudes and latitudes are doubles in degrees; a box is
``(west, south, east, north)`` and crosses the antimeridian when west > east.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8
# Fixed value: one nautical mile in metres.
NAUTICAL_MILE_M = 1852.0

# Cell edge in degrees per resolution. Powers of two, so that the arithmetic is
# exact and every cell nests in exactly one cell of the coarser levels.
CELL_DEGREES = {5: 1 / 8, 7: 1 / 64, 9: 1 / 512}


class Box(NamedTuple):
    west: float
    south: float
    east: float
    north: float

    def checked(self) -> Box:
        if not (-90 <= self.south <= self.north <= 90):
            raise ValueError(f"latitudes out of order or range: {self.south}, {self.north}")
        if not (-180 <= self.west <= 180 and -180 <= self.east <= 180):
            raise ValueError(f"longitude out of range: {self.west}, {self.east}")
        return self

    @property
    def crosses_antimeridian(self) -> bool:
        return self.west > self.east

    def split(self) -> list[Box]:
        """One box, or two when the box crosses the antimeridian."""
        if not self.crosses_antimeridian:
            return [self]
        return [self._replace(east=180.0), self._replace(west=-180.0)]

    def expand(self, degrees: float) -> list[Box]:
        """Grow on every side; split first so that no part is clamped away."""
        if degrees < 0:
            raise ValueError("degrees must not be negative")
        south, north = max(-90.0, self.south - degrees), min(90.0, self.north + degrees)
        width = (self.east - self.west) % 360 if self.crosses_antimeridian else self.east - self.west
        if width + 2 * degrees >= 360:
            return [Box(-180.0, south, 180.0, north)]
        west = (self.west - degrees + 180) % 360 - 180
        east = (self.east + degrees + 180) % 360 - 180
        return Box(west, south, east, north).split()


def in_box(lon: Column, lat: Column, box: Box) -> Column:
    """Edges are inside."""
    inside_lon = (
        (lon >= box.west) | (lon <= box.east)
        if box.crosses_antimeridian
        else lon.between(box.west, box.east)
    )
    return lat.between(box.south, box.north) & inside_lon


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_dphi = F.radians(lat2 - lat1) / 2
    half_dlam = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_dphi) * F.sin(half_dphi) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlam) * F.sin(half_dlam)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def implied_knots(distance_m: Column, seconds: Column) -> Column:
    return distance_m / seconds * 3600.0 / NAUTICAL_MILE_M


def normalize_bearing(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> Column:
    """Point reached from (lon, lat) on a great circle, as struct<lon,lat>."""
    ang = metres / EARTH_RADIUS_M
    phi, theta = F.radians(lat), F.radians(bearing)
    phi2 = F.asin(F.sin(phi) * F.cos(ang) + F.cos(phi) * F.sin(ang) * F.cos(theta))
    lam2 = F.radians(lon) + F.atan2(
        F.sin(theta) * F.sin(ang) * F.cos(phi), F.cos(ang) - F.sin(phi) * F.sin(phi2)
    )
    return F.struct(
        (F.pmod(F.degrees(lam2) + 180.0, F.lit(360.0)) - 180.0).alias("lon"),
        F.degrees(phi2).alias("lat"),
    )


def grid_row(lat: Column, size: float) -> Column:
    last = int(round(180 / size)) - 1
    return F.least(F.lit(last), F.floor((lat + 90.0) / size)).cast("long")


def grid_col(lon: Column, size: float) -> Column:
    return F.pmod(F.floor((lon + 180.0) / size).cast("long"), F.lit(int(round(360 / size))))


def grid_id(row: Column, col: Column, size: float) -> Column:
    return row.cast("long") * int(round(360 / size)) + col.cast("long")


def grid_cell(lon: Column, lat: Column, size: float) -> Column:
    """Cell number in a lon/lat grid with square cells of ``size`` degrees."""
    return grid_id(grid_row(lat, size), grid_col(lon, size), size)


def cell(lon: Column, lat: Column, res: int) -> Column:
    return grid_cell(lon, lat, CELL_DEGREES[res])


def parent_cell(cell_id: Column, res: int, parent_res: int) -> Column:
    """Coarser cell that contains ``cell_id``; pure arithmetic."""
    size, parent = CELL_DEGREES[res], CELL_DEGREES[parent_res]
    ratio = int(round(parent / size))
    cols = int(round(360 / size))
    row = F.floor(cell_id / cols).cast("long")
    col = cell_id % cols
    return grid_id(F.floor(row / ratio), F.floor(col / ratio), parent)


def cell_distance_m(lon: Column, lat: Column, cell_id: Column, size: float) -> Column:
    """A lower bound of the distance from a point to any point of a grid cell."""
    cols = int(round(360 / size))
    south = F.floor(cell_id / cols) * size - 90.0
    west = (cell_id % cols) * size - 180.0
    rise = F.greatest(south - lat, lat - south - size, F.lit(0.0))
    # Degrees eastward from the western edge; beyond the cell, to the nearer edge.
    east = F.pmod(lon - west, F.lit(360.0))
    turn = F.when(east <= size, 0.0).otherwise(F.least(east - size, 360.0 - east))
    # Nearest place of a meridian, or a pole where it is over a quarter turn away.
    across = F.when(turn >= 90.0, F.radians(90.0 - F.abs(lat))).otherwise(
        F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(turn))))
    )
    return F.greatest(F.radians(rise), across) * EARTH_RADIUS_M


def cover_circle(lon: Column, lat: Column, metres: Column, size: float) -> Column:
    """Every grid cell a circle touches, also at the poles and the antimeridian."""
    cols, rows = int(round(360 / size)), int(round(180 / size))
    # A hair wider than the circle, so that rounding never loses a cell.
    dlat = F.degrees(metres / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-9
    row_lo = F.greatest(F.lit(0), F.floor((lat - dlat + 90.0) / size)).cast("long")
    row_hi = F.least(F.lit(rows - 1), F.floor((lat + dlat + 90.0) / size)).cast("long")
    over_pole = (lat + dlat >= 90) | (lat - dlat <= -90)
    reach = F.sin(F.radians(F.least(dlat, F.lit(89.9)))) / F.cos(F.radians(lat))
    dlon = F.when(over_pole | (reach >= 1), F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), reach))) * (1 + 1e-9) + 1e-9
    )
    col_lo = F.floor((lon - dlon + 180.0) / size).cast("long")
    col_hi = F.least(F.floor((lon + dlon + 180.0) / size).cast("long"), col_lo + cols - 1)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(row_lo, row_hi),
                lambda r: F.transform(
                    F.sequence(col_lo, col_hi),
                    lambda c: grid_id(r, F.pmod(c, F.lit(cols)), size),
                ),
            )
        )
    )


def cover_box(west: Column, south: Column, east: Column, north: Column, size: float) -> Column:
    """Every grid cell a box (west <= east) touches."""
    cols = int(round(360 / size))
    col_lo = F.floor((west + 180.0) / size).cast("long")
    col_hi = F.least(F.floor((east + 180.0) / size).cast("long"), col_lo + cols - 1)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(grid_row(south, size), grid_row(north, size)),
                lambda r: F.transform(
                    F.sequence(col_lo, col_hi),
                    lambda c: grid_id(r, F.pmod(c, F.lit(cols)), size),
                ),
            )
        )
    )


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring ``array<struct<lon,lat>>``."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.when(
            (a["lat"] > lat) != (b["lat"] > lat),
            lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"],
        ).otherwise(F.lit(False)),
    )
    return F.size(F.filter(edges, lambda hit: hit)) % 2 == 1


def segment_distance_m(
    lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column
) -> Column:
    """Distance to a leg in a local plane around the point (short legs only)."""
    scale = math.pi / 180 * EARTH_RADIUS_M
    kx = F.cos(F.radians(lat)) * scale
    ax, ay = (lon1 - lon) * kx, (lat1 - lat) * scale
    bx, by = (lon2 - lon) * kx, (lat2 - lat) * scale
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / norm))
    )
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def box_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    def corner(x: Column, y: Column) -> Column:
        return F.concat_ws(" ", x.cast("string"), y.cast("string"))

    return F.concat(
        F.lit("POLYGON(("),
        F.concat_ws(
            ", ",
            corner(west, south),
            corner(east, south),
            corner(east, north),
            corner(west, north),
            corner(west, south),
        ),
        F.lit("))"),
    )
