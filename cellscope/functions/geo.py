"""Geographic column functions: cell codes, distances, segments, polygons, map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code alphabet by row (north first) and column, and the bounds of the code's area.
ALPHABET = "FC98J327K456LMPT"
SOUTH, NORTH, WEST, EAST = 2.5, 38.5, 63.5, 99.5
SPAN = 36.0
METRES_PER_DEGREE = 111_320.0


def cell_row(lat: Column, level: int) -> Column:
    """Row from the south at a level; the northern edge belongs to the last row."""
    return F.least(F.floor((lat - SOUTH) / F.lit(SPAN / 4**level)), F.lit(4**level - 1)).cast("long")


def cell_col(lon: Column, level: int) -> Column:
    return F.least(F.floor((lon - WEST) / F.lit(SPAN / 4**level)), F.lit(4**level - 1)).cast("long")


def code_of(row: Column, col: Column, level: int) -> Column:
    """Code without dashes from the integer index: a base-4 digit of each gives one character."""
    chars = []
    for shift in range(2 * (level - 1), -1, -2):
        r, c = F.shiftright(row, shift).bitwiseAND(F.lit(3)), F.shiftright(col, shift).bitwiseAND(F.lit(3))
        chars.append(F.substring(F.lit(ALPHABET), (4 * (3 - r) + c + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def format_code(code: Column) -> Column:
    """Dashes after three and six characters."""
    c = F.replace(code, F.lit("-"), F.lit(""))
    return F.concat_ws("-", *[F.when(F.length(part) > 0, part) for part in (F.substring(c, 1, 3), F.substring(c, 4, 3), F.substring(c, 7, 99))])


def in_area(lat: Column, lon: Column) -> Column:
    return lat.between(SOUTH, NORTH) & lon.between(WEST, EAST)


def encode(lat: Column, lon: Column, level: int = 10) -> Column:
    """Dashed code of a point; raises outside the area, null for null."""
    code = format_code(code_of(cell_row(lat, level), cell_col(lon, level), level))
    fail = F.raise_error(F.concat(F.lit("point outside the code's area: "), lat.cast("string"), F.lit(", "), lon.cast("string")))
    return F.when(lat.isNull() | lon.isNull(), F.lit(None)).when(in_area(lat, lon), code).otherwise(fail)


def decode(code: Column) -> Column:
    """``struct(lat, lon, south, north, west, east)`` of a code of any length; raises on other characters."""
    clean = F.upper(F.replace(code, F.lit("-"), F.lit("")))
    at = lambda ch: F.call_function("instr", F.lit(ALPHABET), ch) - 1
    index = F.aggregate(
        F.filter(F.split(clean, ""), lambda ch: ch != ""),
        F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("n")),
        lambda a, ch: F.struct((a["r"] * 4 + 3 - F.floor(at(ch) / 4)).alias("r"), (a["c"] * 4 + at(ch) % 4).cast("long").alias("c"), (a["n"] * 4).alias("n")),
    )
    step = F.lit(SPAN) / index["n"]
    south, west = F.lit(SOUTH) + index["r"] * step, F.lit(WEST) + index["c"] * step
    good = F.struct((south + step / 2).alias("lat"), (west + step / 2).alias("lon"), south.alias("south"), (south + step).alias("north"), west.alias("west"), (west + step).alias("east"))
    return F.when(clean.rlike(f"^[{ALPHABET}]+$"), good).otherwise(F.raise_error(F.concat(F.lit("no cell code: "), code)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    p, q = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(p) * F.sin(p) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(q) * F.sin(q)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment on the local plane of the point."""
    kx, ky = F.cos(F.radians(lat)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)
    ax, ay, bx, by = (lon1 - lon) * kx, (lat1 - lat) * ky, (lon2 - lon) * kx, (lat2 - lat) * ky
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def point_in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting against a constant ring: the number of crossings to the right is odd."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """The same for a ring column, ``array<struct<x,y>>``."""
    other = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), other.alias("b"))
    return F.aggregate(edges, F.lit(False), lambda s, e: s != (((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])))


def shoelace(points: Column) -> Column:
    """Unsigned area of ``array<struct<x,y>>`` in squared units; the ring closes itself."""
    other = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, other, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * 2**zoom).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    rad = F.radians(lat)
    return F.floor((F.lit(1.0) - F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / math.pi) / 2 * 2**zoom).cast("long")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """One digit per level: bit of x plus twice the bit of y."""
    bits = [F.shiftright(x, s).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, s).bitwiseAND(F.lit(1)) for s in range(zoom - 1, -1, -1)]
    return F.concat(*[b.cast("string") for b in bits])
