"""Grid operators: cell enumeration, binning, disc kernels, dense grids, neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

METRES_PER_DEGREE = 111_320.0


def count_cells(south: float, west: float, north: float, east: float, level: int) -> tuple[int, int, int, int]:
    """Index ranges (first row, last row, first column, last column), inclusive, held to the area."""
    n, step = 4**level, geo.SPAN / 4**level
    hold = lambda v: max(0, min(n - 1, v))
    return (
        hold(math.floor((south - geo.SOUTH) / step)), hold(math.floor((north - geo.SOUTH) / step)),
        hold(math.floor((west - geo.WEST) / step)), hold(math.floor((east - geo.WEST) / step)),
    )


def cells_for_bbox(spark: SparkSession, south: float, west: float, north: float, east: float, level: int, max_cells: int | None = None) -> DataFrame:
    """``code, row, col, lat, lon`` of every cell that the box touches, made in parallel from its rows."""
    if not 3 <= level <= 10:
        raise ValueError("level must be 3 to 10")
    r0, r1, c0, c1 = count_cells(south, west, north, east, level)
    total = (r1 - r0 + 1) * (c1 - c0 + 1)
    if max_cells is not None and total > max_cells:
        raise ValueError(f"{total} cells are more than {max_cells}")
    step = geo.SPAN / 4**level
    rows = spark.range(r0, r1 + 1).select(F.col("id").alias("row"))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1).cast("long"))))
    return cells.select(
        geo.code_of(F.col("row"), F.col("col"), level).alias("code"), "row", "col",
        (F.lit(geo.SOUTH) + (F.col("row") + 0.5) * step).alias("lat"), (F.lit(geo.WEST) + (F.col("col") + 0.5) * step).alias("lon"),
    )


def indexed(points: DataFrame, level: int) -> DataFrame:
    return points.withColumns({"row": geo.cell_row(F.col("lat"), level), "col": geo.cell_col(F.col("lon"), level)})


def runs(first: Column, last: Column, most: int) -> Column:
    """Array of ``struct(j, i)``: the aligned blocks of 2**j columns that make up the columns first to last.

    A run of n columns takes at most 2 * log2(n) blocks; ``most`` bounds n and so the number of levels.
    """
    blocks = []
    for j in range(most.bit_length() + 1):
        low, high = F.ceil(first / (1 << j)).cast("long"), F.floor((last + 1) / (1 << j)).cast("long")
        block = lambda i, j=j: F.struct(F.lit(j).alias("j"), i.alias("i"))
        blocks += [F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), block(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), block(high - 1))]
    return F.filter(F.array(*blocks), lambda b: b.isNotNull())


def disc_counts(cells: DataFrame, points: DataFrame, by: str, level: int = 8, radius_m: float = 400.0, key: str = "k") -> DataFrame:
    """``key, by, cnt``: points by kind within a disc around each cell; kinds without points are absent.

    Points are first counted per fine bin, so what is joined is bins, however many points a bin has. A bin
    belongs to the disc when its centre does, with a degree of longitude as long as at the cell's own latitude,
    rounded to a degree. In each row of bins the disc is a run of columns; bins are summed up to aligned blocks
    of 1, 2, 4, ... columns beforehand, so a run meets a few blocks in an equi-join on (row, level, block). Cells that share a bin
    and a width share their disc, which is counted once; the runs, whose number no size estimate shows, are never broadcast.
    """
    step = geo.SPAN / 4**level * METRES_PER_DEGREE
    across = step * F.cos(F.radians(F.bround("lat", 0)))
    reach = math.ceil(radius_m / step)
    widest = math.ceil(radius_m / (step * math.cos(math.radians(geo.SOUTH + geo.SPAN)))) * 2 + 1
    bins = indexed(points, level).groupBy("row", "col", by).agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(widest.bit_length())))
    blocks = bins.withColumn("j", levels).groupBy("row", "j", F.floor(F.col("col") / F.pow(F.lit(2.0), F.col("j"))).alias("i"), by).agg(F.sum("n").alias("n"))
    placed = indexed(cells, level).select(key, "row", "col", across.alias("across"))
    discs = placed.select("row", "col", "across").distinct().withColumnsRenamed({"row": "at", "col": "mid"})
    rows = discs.withColumn("r", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    rows = rows.filter(F.abs("r") * step <= radius_m).withColumn("w", F.floor(F.sqrt(F.lit(radius_m**2) - (F.col("r") * step) * (F.col("r") * step)) / F.col("across")))
    covered = rows.select("at", "mid", "across", (F.col("at") + F.col("r")).alias("row"), F.explode(runs(F.col("mid") - F.col("w"), F.col("mid") + F.col("w"), widest)).alias("b")).select("at", "mid", "across", "row", "b.j", "b.i")
    counts = covered.hint("merge").join(blocks, ["row", "j", "i"]).groupBy(F.col("at").alias("row"), F.col("mid").alias("col"), "across", by).agg(F.sum("n").alias("n"))
    return placed.join(counts.hint("merge"), ["row", "col", "across"]).groupBy(key, by).agg(F.sum("n").cast("long").alias("cnt"))


def dense_index(points: DataFrame, south: float, west: float, north: float, east: float, ny: int, nx: int) -> DataFrame:
    """Add ``idx`` = y * nx + x with row 0 in the north; points outside [w, e) x [s, n) are dropped."""
    inside = points.filter((F.col("lon") >= west) & (F.col("lon") < east) & (F.col("lat") >= south) & (F.col("lat") < north))
    x = F.floor((F.col("lon") - west) / ((east - west) / nx))
    y = F.lit(ny - 1) - F.floor((F.col("lat") - south) / ((north - south) / ny))
    hold = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    return inside.withColumn("idx", (hold(y, ny) * nx + hold(x, nx)).cast("long"))


def neighbourhood_sum(grid: DataFrame, value: str, ny: int, nx: int, reach: int = 1) -> DataFrame:
    """``idx, total``: each present cell's sum over the square around it; the border has no neighbours outside.

    Each cell sends its value to the cells that it reaches, so the shuffle is linear in cells.
    """
    moves = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    yx = grid.select(F.floor(F.col("idx") / nx).alias("y"), (F.col("idx") % nx).alias("x"), F.col(value).alias("v"), F.explode(moves).alias("m"))
    sent = yx.select((F.col("y") + F.col("m.y")).alias("y"), (F.col("x") + F.col("m.x")).alias("x"), "v", ((F.col("m.y") == 0) & (F.col("m.x") == 0)).alias("own"))
    kept = sent.filter(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))
    return kept.groupBy((F.col("y") * nx + F.col("x")).cast("long").alias("idx")).agg(F.sum("v").alias("total"), F.bool_or("own").alias("own")).filter("own").drop("own")


def sample(points: DataFrame, grid: DataFrame, south: float, west: float, north: float, east: float, ny: int, nx: int) -> DataFrame:
    """Left lookup join: the grid's values at each point, null outside or where the grid has no cell."""
    return points.join(dense_index(points, south, west, north, east, ny, nx).select("k", "idx"), "k", "left").join(grid, "idx", "left")
