"""Text and box matches, street uses, filled fields, pixels and viewports as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo
from .num import let

# Street classes by use.
DRIVABLE = ("trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "living_street")
ACTIVE = ("footway", "pedestrian", "path", "steps", "living_street")
CYCLE = ("cycleway",)
MAIN = ("primary", "secondary", "tertiary", "trunk")
# Lowest zoom of each cell level, and the most cells of a viewport.
LEVEL_FROM_ZOOM = ((18, 8), (16, 7), (14, 6), (12, 5), (10, 4), (8, 3))
MOST_CELLS = 500


def mentions(fields: list[Column], *names: Column) -> Column:
    """Whether the fields, joined by spaces, hold one of the names, whatever the case; null and empty names match nothing."""
    blob = F.lower(F.concat_ws(" ", *[F.when(f != "", f) for f in fields]))
    hits = [F.coalesce((n != "") & F.contains(blob, F.lower(n)), F.lit(False)) for n in names]
    return F.exists(F.array(*hits), lambda x: x)


def drivable(road_class: Column) -> Column:
    return F.coalesce(road_class.isin(*DRIVABLE), F.lit(False))


def walking_use(road_class: Column, sidewalk: Column, cycleway: Column) -> Column:
    """``active``, ``cycle``, ``gap`` (a main road with neither side path) or null."""
    missing = lambda x: F.coalesce(x, F.lit("")) == ""
    gap = road_class.isin(*MAIN) & missing(sidewalk) & missing(cycleway)
    return F.when(road_class.isin(*ACTIVE), "active").when(road_class.isin(*CYCLE), "cycle").when(gap, "gap")


def touches_box(points: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether any vertex of ``array<struct<lat, lon>>`` lies in the box, edges included."""
    return F.coalesce(F.exists(points, lambda p: p["lat"].between(south, north) & p["lon"].between(west, east)), F.lit(False))


def filled(first: dict[str, Column], second: dict[str, Column]) -> list[Column]:
    """Each field of the first source, taken from the second only where it is null."""
    return [F.coalesce(v, second[k]).alias(k) if k in second else v.alias(k) for k, v in first.items()]


def pixel_place(row: Column, col: Column, t: tuple[float, ...]) -> Column:
    """``struct(x, y)`` of a pixel under the affine transform (a, b, c, d, e, f)."""
    a, b, x, d, e, y = map(F.lit, t)
    return F.struct((x + col * a + row * b).alias("x"), (y + col * d + row * e).alias("y"))


def pixel_at(lon: Column, lat: Column, t: tuple[float, ...], rows: int, cols: int) -> Column:
    """``struct(row, col)`` under an unrotated transform, fractions cut towards zero; null outside the raster."""
    col, row = ((lon - F.lit(t[2])) / F.lit(t[0])).cast("int"), ((lat - F.lit(t[5])) / F.lit(t[4])).cast("int")
    return F.when(row.between(0, rows - 1) & col.between(0, cols - 1), F.struct(row.alias("row"), col.alias("col")))


def viewport_level(zoom: Column) -> Column:
    """Cell level of a map zoom; null when the map is zoomed out too far."""
    return F.coalesce(*[F.when(zoom >= z, F.lit(level)) for z, level in LEVEL_FROM_ZOOM])


def viewport_cells(south: Column, west: Column, north: Column, east: Column, zoom: Column) -> Column:
    """``struct(level, rows, cols)`` of the cells under a viewport's sample points; empty rows beyond MOST_CELLS or far out.

    Rows and columns are told apart one by one: each row with each column is a cell, see ``cell_code``.
    """
    level = viewport_level(zoom)
    s, n = F.greatest(south, F.lit(geo.SOUTH)), F.least(north, F.lit(geo.NORTH))
    w, e = F.greatest(west, F.lit(geo.WEST)), F.least(east, F.lit(geo.EAST))
    step = F.lit(geo.SPAN) / F.pow(F.lit(4.0), level)
    high, wide = F.ceil((n - s) / step), F.ceil((e - w) / step)
    fine = F.lit(4.0) ** (F.lit(10) - level)

    def along(a: Column, b: Column, count: Column, cell) -> Column:
        at = let(step, lambda x: F.filter(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: a + x * (i + F.lit(0.5))), lambda v: v < b))
        return F.array_distinct(F.transform(at, lambda v: F.floor(cell(v, 10) / fine).cast("long")))

    fits = (s < n) & (w < e) & (high * wide <= MOST_CELLS)
    none = F.array().cast("array<bigint>")
    return F.struct(level.alias("level"), F.when(fits, along(s, n, high, geo.cell_row)).otherwise(none).alias("rows"), F.when(fits, along(w, e, wide, geo.cell_col)).otherwise(none).alias("cols"))


def cell_code(row: Column, col: Column, level: Column) -> Column:
    """Dashed code of a cell of ``level`` by its row and column there."""
    up = (F.lit(4.0) ** (F.lit(10) - level)).cast("long")
    return geo.format_code(F.substring(geo.code_of(row * up, col * up, 10), F.lit(1), level))
