"""Raster operators on long tables ``row, col, v``: focal sums, slope, drainage, change, urban growth.

Neighbours meet by sending each cell's value to the cells around it (an explode and one aggregation),
never by a self-join on inequalities; a raster of any size shuffles a constant multiple of its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import chains

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _sent(r: DataFrame, moves: list[tuple[int, int]]) -> DataFrame:
    """``row, col, dr, dc, v``: v is the value of the cell at (row + dr, col + dc).

    Joins with it are merge joins: no size estimate shows what the explode adds, so it would be broadcast.
    """
    m = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in moves]))
    return r.select("row", "col", "v", m.alias("m")).select((F.col("row") - F.col("m.dr")).alias("row"), (F.col("col") - F.col("m.dc")).alias("col"), "m.dr", "m.dc", "v").hint("merge")


def slope(r: DataFrame, cell: float) -> DataFrame:
    """``row, col, slope``: central differences, one-sided where a neighbour is missing; degrees."""
    four = _sent(r, [(-1, 0), (1, 0), (0, -1), (0, 1), (0, 0)])
    at = lambda a, b: F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("v")))
    g = four.groupBy("row", "col").agg(at(0, 0).alias("o"), at(-1, 0).alias("n"), at(1, 0).alias("s"), at(0, -1).alias("w"), at(0, 1).alias("e")).filter("o is not null")

    def diff(a: str, b: str) -> Column:
        low, high = F.coalesce(F.col(a), F.col("o")), F.coalesce(F.col(b), F.col("o"))
        steps = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
        return F.when(steps > 0, (high - low) / (steps * cell)).otherwise(F.lit(0.0))

    gy, gx = diff("n", "s"), diff("w", "e")
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"))


def neighbour_fraction(r: DataFrame) -> DataFrame:
    """``row, col, frac``: the sum of the eight neighbours over 8, whatever is missing counts 0."""
    around = _sent(r, EIGHT).groupBy("row", "col").agg(F.sum("v").alias("s"))
    return r.select("row", "col").join(around, ["row", "col"], "left").select("row", "col", (F.coalesce(F.col("s"), F.lit(0.0)) / 8).alias("frac"))


def flow_direction(r: DataFrame, least_drop: float = -1.0) -> DataFrame:
    """``row, col, dr, dc``: the first of the steepest drops over 8 directions above ``least_drop``; else null."""
    number = F.element_at(F.create_map(*[x for i, (a, b) in enumerate(EIGHT) for x in (F.lit(a * 3 + b), F.lit(i))]), F.col("dr") * 3 + F.col("dc"))
    s = _sent(r, EIGHT).withColumn("i", number).withColumnRenamed("v", "n")
    drop = (F.col("v") - F.col("n")) / F.when((F.col("dr") != 0) & (F.col("dc") != 0), F.lit(2.0**0.5)).otherwise(F.lit(1.0))
    j = r.join(s, ["row", "col"], "left").withColumn("drop", drop)
    best = F.max(F.when(F.col("drop") > least_drop, F.struct(F.col("drop"), (-F.col("i")).alias("o"), F.col("dr"), F.col("dc"))))
    return j.groupBy("row", "col").agg(best.alias("b")).select("row", "col", "b.dr", "b.dc")


def local_minima(r: DataFrame, reach: int = 1) -> DataFrame:
    """``row, col``: cells lower than all others within ``reach``."""
    moves = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) != (0, 0)]
    around = _sent(r, moves).groupBy("row", "col").agg(F.min("v").alias("m"))
    return r.join(around, ["row", "col"]).filter("v < m").select("row", "col")


def flow_accumulation(direction: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``row, col, cells``: how many cells drain through each cell, itself included; with ``weights(row, col, w)`` their sum.

    Sums are made by pointer doubling over the forest of directions, so rounds grow with the logarithm of the longest
    path. A cell that points out of the raster is an outlet. Directions that run in a circle are an error.
    """
    at = lambda r, c: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"))
    cells = direction.select("row", "col", at(F.col("row"), F.col("col")).alias("node"), at(F.col("row") + F.col("dr"), F.col("col") + F.col("dc")).alias("down"), (F.col("dr").isNotNull() & F.col("dc").isNotNull()).alias("runs"))
    inside = cells.select(F.col("node").alias("down"), F.lit(True).alias("inside"))
    own = cells.join(inside.hint("merge"), "down", "left").select("row", "col", "node", F.when(F.col("runs") & F.col("inside"), F.col("down")).alias("down"))
    w = F.lit(1).cast("long")
    if weights is not None:
        own, w = own.join(weights.hint("merge"), ["row", "col"], "left"), F.coalesce("w", F.lit(0.0))
    own = durable(own.withColumn("w", w))
    sums = chains.upstream_sums(own.select("node", "down", "w"))
    return own.select("row", "col", "node").join(sums.hint("merge"), "node").select("row", "col", F.col("total").alias("cells"))


def ca_step(r: DataFrame, potential: DataFrame, demand: int, neighbour_weight: float = 0.5) -> DataFrame:
    """One step of growth: of the cells that are not urban, the ``demand`` with the highest suitability turn.

    Suitability is potential x (1 + neighbour_weight x neighbour fraction), so a cell without urban neighbours can turn
    too; a cell of no potential can't. Ties go by row and column.
    """
    s = neighbour_fraction(r).join(potential, ["row", "col"]).join(r, ["row", "col"])
    score = F.when(F.col("v") == 0, F.col("p") * (F.lit(1.0) + F.lit(float(neighbour_weight)) * F.col("frac")))
    chosen = s.filter((F.col("v") == 0) & (score > 0)).orderBy(score.desc(), "row", "col").limit(max(0, demand)).select("row", "col", F.lit(1.0).alias("new"))
    return r.join(chosen, ["row", "col"], "left").select("row", "col", F.coalesce("new", "v").alias("v"))


def markov_demand(masks: DataFrame) -> DataFrame:
    """One row, ``demand``: the mean number of cells that turn urban from one mask to the next, halves to the even number.

    ``masks(year, row, col, v)`` has 1 for urban; years needn't be consecutive. Fewer than two masks give 0.
    """
    before = F.lag("v").over(Window.partitionBy("row", "col").orderBy("year"))
    gained = masks.select("year", "v", before.alias("before")).agg(F.count_if((F.col("v") == 1) & (F.col("before") == 0)).alias("gain"), F.countDistinct("year").alias("years"))
    return gained.select(F.when(F.col("years") > 1, F.bround(F.col("gain") / (F.col("years") - 1), 0)).otherwise(0).cast("long").alias("demand"))


def agreement(before: DataFrame, simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: figure of merit (hits over hits, misses and false alarms) and Cohen's kappa."""
    j = before.withColumnRenamed("v", "b").join(simulated.withColumnRenamed("v", "s"), ["row", "col"]).join(observed.withColumnRenamed("v", "o"), ["row", "col"])
    n = F.count("*").cast("double")
    hit = F.count_if((F.col("b") == 0) & (F.col("s") == 1) & (F.col("o") == 1))
    any_change = F.count_if((F.col("b") == 0) & ((F.col("s") == 1) | (F.col("o") == 1)))
    same = F.count_if(F.col("s") == F.col("o")) / n
    s1, o1 = F.sum("s") / n, F.sum("o") / n
    chance = s1 * o1 + (F.lit(1.0) - s1) * (F.lit(1.0) - o1)
    return j.agg(F.when(any_change > 0, hit / any_change).otherwise(F.lit(0.0)).alias("merit"), F.when(chance < 1, (same - chance) / (F.lit(1.0) - chance)).otherwise(F.lit(1.0)).alias("kappa"))


def mosaic(bands: DataFrame, missing: float = -99.0) -> DataFrame:
    """``row, col, v``: mean of valid tile values held to 0..1; 0 where no tile is valid."""
    valid = F.when(F.col("v") != missing, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))))
    return bands.groupBy("row", "col").agg(F.coalesce(F.avg(valid), F.lit(0.0)).alias("v"))


def downstream_rank(acc: DataFrame) -> DataFrame:
    return acc.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cells"), "row", "col")))


def upsample(r: DataFrame, size: int, to: int) -> DataFrame:
    """``row, col, v``: a size x size raster drawn out to ``to`` x ``to`` by bilinear interpolation, corners kept.

    Each source cell sends its value to the targets less than one cell away; a target adds up to four of them.
    """
    scale = (size - 1) / (to - 1)
    span = lambda x: F.sequence(F.greatest(F.lit(0), F.ceil((x - 1) / scale)).cast("int"), F.least(F.lit(to - 1), F.floor((x + 1) / scale)).cast("int"))
    near = lambda x, t: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(t * F.lit(scale) - x))
    sent = r.withColumn("ty", F.explode(span(F.col("row")))).withColumn("tx", F.explode(span(F.col("col"))))
    return sent.groupBy(F.col("ty").alias("row"), F.col("tx").alias("col")).agg(F.sum(F.col("v") * near(F.col("row"), F.col("ty")) * near(F.col("col"), F.col("tx"))).alias("v"))


def coarsen(r: DataFrame, factor: int) -> DataFrame:
    """``row, col, v``: means over squares of ``factor`` cells; missing cells take no part."""
    return r.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("v").alias("v"))


def aligned(r: DataFrame, grid: tuple[float, float, float, float], to: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """``row, col, v`` on a grid of ``height`` x ``width`` cells: the mean of the source's cells there, by the area that they share.

    Grids are (west, north, cell width, cell height), rows going south, in the same coordinates. A source cell is sent to the few cells that
    it overlaps. Source cells without a value take no part; where there is none, and for a source without any, v is 0.
    """
    west, north, wide, high = grid
    west2, north2, wide2, high2 = to
    left, top = west + F.col("col") * wide, (F.lit(north) - F.col("row") * high)
    span = lambda low, upto, most: F.sequence(F.greatest(F.lit(0), F.floor(low)).cast("long"), F.least(F.lit(most - 1), F.ceil(upto) - 1).cast("long"))
    hit = r.filter("v is not null").withColumns({"l": left, "t": top})
    inside = (F.col("l") < west2 + width * wide2) & (F.col("l") + wide > west2) & (F.col("t") > north2 - height * high2) & (F.col("t") - high < north2)
    sent = hit.filter(inside).withColumn("r2", F.explode(span((F.lit(north2) - F.col("t")) / high2, (F.lit(north2) - F.col("t") + high) / high2, height)))
    sent = sent.withColumn("c2", F.explode(span((F.col("l") - west2) / wide2, (F.col("l") + wide - west2) / wide2, width)))
    across = F.least(F.col("l") + wide, west2 + (F.col("c2") + 1) * wide2) - F.greatest(F.col("l"), west2 + F.col("c2") * wide2)
    down = F.least(F.col("t"), F.lit(north2) - F.col("r2") * high2) - F.greatest(F.col("t") - high, F.lit(north2) - (F.col("r2") + 1) * high2)
    shared = sent.withColumn("w", F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)).filter("w > 0")
    means = shared.groupBy(F.col("r2").alias("row"), F.col("c2").alias("col")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    every = r.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    return every.join(means, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def window_mean(points: DataFrame, r: DataFrame, reach: int) -> DataFrame:
    """``k, v``: the mean of the raster around each point (k, row, col); 0 where no cell of the window is there."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = points.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    met = around.select("k", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).join(r, ["row", "col"])
    means = met.groupBy("k").agg(F.avg("v").alias("v"))
    return points.select("k").join(means, "k", "left").select("k", F.coalesce("v", F.lit(0.0)).alias("v"))


def regions(mask: DataFrame, least_cells: int, width: int) -> DataFrame:
    """``region, cells, south, west, north, east``: connected cells (by edges) of a mask (row, col) as boxes of cells.

    ``width`` is the raster's number of columns; a region is named by its smallest row * width + col.
    """
    from . import graph

    node = F.col("row").cast("long") * width + F.col("col")
    own = durable(mask.select("row", "col", node.alias("node")).distinct())
    steps = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c"))))
    to = own.select(F.col("node").alias("a"), "row", "col", steps.alias("s")).select("a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    edges = to.join(own, ["row", "col"]).select("a", F.col("node").alias("b"), F.lit(1.0).alias("w"))
    named = own.join(graph.components(edges), "node", "left").withColumn("region", F.coalesce("component", "node"))
    box = named.groupBy("region").agg(F.count("*").alias("cells"), F.min("row").alias("south"), F.min("col").alias("west"), F.max("row").alias("north"), F.max("col").alias("east"))
    return box.filter(F.col("cells") >= least_cells)


# The four sides of a cell, counter-clockwise with rows up: start corner, end corner, and the direction's number.
SIDES = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))


def outlines(mask: DataFrame, width: int, least_cells: int = 1) -> DataFrame:
    """``region, ring, hole, area, points`` of the connected regions (by edges) of a mask (row, col): their rings.

    Every cell has four directed sides with the cell to the left; sides of neighbours cancel. What is left is
    chained into rings: at a corner where two rings meet, a side goes on along its own cell. Rings are found and ordered by
    pointer doubling, so a region of any size is spread over tasks until its rings are written; no join gathers a side for a broadcast. ``points`` are corners
    (row, col) where the ring turns, outer rings counter-clockwise, holes clockwise; ``area`` is signed, and a region's areas
    add up to its cells. ``width`` is the raster's number of columns; a region is named as by ``regions``.
    """
    from . import graph

    node = F.col("row").cast("long") * width + F.col("col")
    own = durable(mask.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct().withColumn("node", node))
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0))]))
    to = own.select(F.col("node").alias("a"), "row", "col", step.alias("s")).select("a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    links = to.join(own.hint("merge"), ["row", "col"]).select("a", F.col("node").alias("b"))
    named = own.join(graph.components(links), "node", "left").withColumn("region", F.coalesce("component", "node"))
    if least_cells > 1:
        named = named.join(named.groupBy("region").count().filter(F.col("count") >= least_cells).select("region").hint("merge"), "region", "left_semi")
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("r1", "c1", "r2", "c2", "turn"), (*x, i), strict=True)]) for i, x in enumerate(SIDES)]))
    sides = named.select("region", "row", "col", side.alias("s")).select("region", *[(F.col(a) + F.col(f"s.{b}{i}")).alias(f"{b}{i}") for i in (1, 2) for a, b in (("row", "r"), ("col", "c"))], "s.turn")
    # Opposing sides lie on the same edge of the grid: its lower left corner, and whether it runs along the row.
    kept = sides.withColumns({"er": F.least("r1", "r2"), "ec": F.least("c1", "c2"), "flat": F.col("r1") == F.col("r2")}).groupBy("er", "ec", "flat").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("region", "r1", "c1", "r2", "c2", "turn")],
    )
    ident = F.struct(F.col("r1").alias("r"), F.col("c1").alias("c"), F.col("turn").alias("t"))
    kept = durable(kept.filter("n = 1").select("region", "r1", "c1", "r2", "c2", "turn", ident.alias("node")))
    onward = kept.select(F.col("r1").alias("r2"), F.col("c1").alias("c2"), F.col("node").alias("next"), F.col("turn").alias("then"))
    # Of two sides that leave a corner the left turn stays with the own cell.
    left = F.pmod(F.col("then") - F.col("turn") + 3, F.lit(4))  # 0: left, 3: straight on, 2: right
    order = F.when(left == 0, 0).when(left == 3, 1).otherwise(2)
    linked = durable(kept.join(onward.hint("merge"), ["r2", "c2"]).groupBy("node").agg(F.min_by(F.struct("next", "then"), order).alias("to"), *[F.first(c).alias(c) for c in ("region", "r1", "c1", "r2", "c2", "turn")]).select("node", "to.next", "to.then", "region", "r1", "c1", "r2", "c2", "turn"))
    led = durable(chains.ring_leaders(linked.select("node", "next")).join(linked.hint("merge"), "node"))
    cut = led.select("node", F.when(F.col("next") != F.col("leader"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("rest"))
    placed = chains.along(cut, {"rest": lambda a, b: a + b}).join(led.hint("merge"), "node")
    corner = F.when(F.col("then") != F.col("turn"), F.struct(-F.col("rest"), F.col("r2").alias("row"), F.col("c2").alias("col")))
    rings = placed.groupBy("region", F.concat_ws("/", "leader.r", "leader.c", "leader.t").alias("ring")).agg(
        (F.sum(F.col("c1") * F.col("r2") - F.col("c2") * F.col("r1")) / 2).alias("area"), F.array_sort(F.collect_list(corner)).alias("p"),
    )
    return rings.select("region", "ring", (F.col("area") < 0).alias("hole"), "area", F.transform("p", lambda x: F.struct(x["row"], x["col"])).alias("points"))
