"""Delaunay triangles, Voronoi cells and contiguity of points, made tile by tile.

Tiles are the leaves of a count-balanced quadtree. A tile triangulates its own points together with those of the tiles
around it. A triangle with one of its own points holds for all points if no other tile's box reaches into its
circumcircle; an outer edge holds if no other tile's box reaches beyond it. Tiles whose boxes do are fetched, and the tile tries
again, until nothing can change: a round is one join for the tiles that are not done yet. The boxes are a few numbers a tile and
are broadcast; the tile size grows with the points so that their number stays bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable
from .nearest import MOST_LEAVES, _curve, leaves_of

TILE = 512
OUT = -1  # the vertex beyond every outer edge
# Points are moved by at most this share of the extent, by a hash of their id: no four of them lie on one circle then, in any tile.
MOVE = 1e-9


def delaunay(xs: list[float], ys: list[float]) -> dict[tuple[int, int], int]:
    """The triangulation of points in general position: each directed edge with the vertex to its left.

    Points are added one by one; the triangles whose circle holds the new point are cleared, and it is joined to the
    edges around them. Beyond an outer edge stands a triangle with OUT, whose circle is the half-plane.
    """
    left: dict[tuple[int, int], int] = {}
    n = len(xs)

    def side(a: int, b: int, p: int) -> float:
        return (xs[b] - xs[a]) * (ys[p] - ys[a]) - (ys[b] - ys[a]) * (xs[p] - xs[a])

    def add(a: int, b: int, c: int) -> None:
        left[a, b], left[b, c], left[c, a] = c, a, b

    def holds(a: int, b: int, c: int, p: int) -> bool:
        if c == OUT:
            return side(a, b, p) > 0
        if a == OUT:
            return side(b, c, p) > 0
        if b == OUT:
            return side(c, a, p) > 0
        ax, ay, bx, by, cx, cy = xs[a] - xs[p], ys[a] - ys[p], xs[b] - xs[p], ys[b] - ys[p], xs[c] - xs[p], ys[c] - ys[p]
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def conflict(p: int, at: tuple[int, int]) -> tuple[int, int, int]:
        """A triangle whose circle holds p: walk towards it."""
        a, b = at
        for _ in range(4 * n + 64):
            c = left[a, b]
            if OUT in (a, b, c):
                if holds(a, b, c, p):
                    return a, b, c
                break
            if side(a, b, p) < 0:
                a, b = b, a
            elif side(b, c, p) < 0:
                a, b = c, b
            elif side(c, a, p) < 0:
                a, b = a, c
            else:
                return a, b, c
        return next((a, b, c) for (a, b), c in left.items() if holds(a, b, c, p))

    if n < 3:
        return left
    turn = side(0, 1, 2)
    a, b, c = (0, 1, 2) if turn > 0 else (1, 0, 2)
    for u, v, w in ((a, b, c), (b, a, OUT), (c, b, OUT), (a, c, OUT)):
        add(u, v, w)
    last = (a, b)
    for p in range(3, n):
        a, b, c = conflict(p, last)
        del left[a, b], left[b, c], left[c, a]
        stack, rim = [(a, b), (b, c), (c, a)], []
        while stack:
            a, b = stack.pop()
            c = left.get((b, a))
            if c is None:
                continue
            if holds(b, a, c, p):
                del left[b, a], left[a, c], left[c, b]
                stack += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            add(a, b, p)
            if a != OUT and b != OUT:
                last = (a, b)
    return left


def circles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and squared radii of the circles through triangles (m, 3)."""
    bx, by, cx, cy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return x[:, 0] + ux, y[:, 0] + uy, ux * ux + uy * uy


def _reached(triangles: np.ndarray, outer: np.ndarray, x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Which boxes (west, south, east, north) reach into a triangle's circle or beyond an outer edge."""
    out = np.zeros(len(boxes), bool)
    cx, cy, r2 = circles(x[triangles], y[triangles])
    for i in range(0, len(triangles), 256):
        s = slice(i, i + 256)
        dx = np.maximum(0.0, np.maximum(boxes[None, :, 0] - cx[s, None], cx[s, None] - boxes[None, :, 2]))
        dy = np.maximum(0.0, np.maximum(boxes[None, :, 1] - cy[s, None], cy[s, None] - boxes[None, :, 3]))
        out |= (dx * dx + dy * dy <= r2[s, None] * (1 + 1e-9)).any(axis=0)
    for a, b in outer:
        ex, ey = x[b] - x[a], y[b] - y[a]
        # The corner of the box that is farthest to the left of the edge.
        far = ex * (np.where(ex > 0, boxes[:, 3], boxes[:, 1]) - y[a]) - ey * (np.where(ey > 0, boxes[:, 0], boxes[:, 2]) - x[a])
        out |= far > 0
    return out


def triangles(points: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b, c`` with a < b < c: the Delaunay triangles of ``points(k, x, y)``.

    Points without a place take no part; of points at one place only the smallest id does. Four points on one
    circle give the triangles of slightly moved ones. Fewer than three points, or all on one line, give none that have an area.
    """
    spark, kind = points.sparkSession, points.schema["k"].dataType.simpleString()
    own = durable(points.filter("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("k").alias("t")))
    n, west, east, south, north = own.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 3:
        return own.select(F.col("t").alias("a"), F.col("t").alias("b"), F.col("t").alias("c")).limit(0)
    span = max(east - west, north - south)
    moved = lambda c, seed: (F.col(c) + F.xxhash64("t", F.lit(seed)) / 2.0**63 * (MOVE * span)).alias("tlat" if c == "y" else "tlon")
    margin = MOVE * span
    placed = leaves_of(own.select("t", moved("y", 1), moved("x", 2)), max(tile, n // MOST_LEAVES), (south - margin, west - margin, north + margin, east + margin))
    placed = placed.select("t", F.col("tlon").alias("x"), F.col("tlat").alias("y"), "leaf")
    bounds = placed.groupBy("leaf").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toPandas()  # bounded: see MOST_LEAVES
    names, boxes = bounds["leaf"].to_numpy(str), bounds.iloc[:, 1:].to_numpy(float)
    shared = spark.sparkContext.broadcast((names, boxes))

    def around(leaves: pd.Series) -> pd.Series:
        names, boxes = shared.value
        place = {name: i for i, name in enumerate(names)}
        out = []
        for leaf in leaves:
            b = boxes[place[leaf]]
            reach = max(b[2] - b[0], b[3] - b[1])
            near = (boxes[:, 0] <= b[2] + reach) & (boxes[:, 2] >= b[0] - reach) & (boxes[:, 1] <= b[3] + reach) & (boxes[:, 3] >= b[1] - reach)
            out.append(names[near].tolist())
        return pd.Series(out)

    def attempt(group: pd.DataFrame) -> pd.DataFrame:
        """Triangles whose smallest point is the tile's own, or the tiles to fetch besides those that are here."""
        names, boxes = shared.value
        mine = group["tile"].iloc[0]
        group = group.iloc[np.argsort(_curve((group["y"].to_numpy() - south) / (span or 1) * 90, (group["x"].to_numpy() - west) / (span or 1) * 90), kind="stable")]
        x, y, ids, owned = group["x"].to_numpy(), group["y"].to_numpy(), group["t"].to_numpy(), (group["leaf"] == mine).to_numpy()
        left = delaunay(x.tolist(), y.tolist())
        star, outer = [], []
        for (a, b), c in left.items():
            if c == OUT and (owned[a] or owned[b]):
                outer.append((a, b))
            elif 0 <= a < b and a < c and b >= 0 and (owned[a] or owned[b] or owned[c]):
                star.append((a, b, c))
            elif 0 <= a < c < b and (owned[a] or owned[b] or owned[c]):
                star.append((a, b, c))
        tri = np.array(star, np.int64).reshape(-1, 3)
        rest = ~np.isin(names, group["leaf"].unique())
        more = names[rest][_reached(tri, np.array(outer, np.int64).reshape(-1, 2), x, y, boxes[rest])] if rest.any() else names[:0]
        if len(group) < 3:
            more = names[rest]
        if len(more):
            return pd.DataFrame({"tile": mine, "fetch": more, "a": None, "b": None, "c": None})
        corners = np.sort(ids[tri], axis=1) if len(tri) else np.zeros((0, 3), ids.dtype)
        first = np.isin(corners[:, 0], ids[owned])
        return pd.DataFrame({"tile": mine, "fetch": None, "a": corners[first, 0], "b": corners[first, 1], "c": corners[first, 2]})

    wanted = durable(placed.select(F.col("leaf").alias("tile")).distinct().withColumn("leaf", F.explode(F.pandas_udf(around, "array<string>")("tile"))))
    parts = []
    while True:
        tried = durable(wanted.join(placed, "leaf").groupBy("tile").applyInPandas(attempt, f"tile string, fetch string, a {kind}, b {kind}, c {kind}"))
        parts.append(tried.filter("fetch is null").select("a", "b", "c"))
        more = tried.filter("fetch is not null").select("tile", F.col("fetch").alias("leaf"))
        if more.isEmpty():
            break
        after = durable(wanted.join(more.select("tile").distinct(), "tile", "left_semi").unionByName(more))
        discard(wanted)
        wanted = after
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contiguity(made: DataFrame) -> DataFrame:
    """``a, b`` with a < b: points whose cells touch, from ``triangles``."""
    pairs = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("ab", "bc", "ac")])
    return made.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def _clipped(x: float, y: float, others: list, ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """``ring`` cut to what is nearer to (x, y) than to any of the others."""
    for ox, oy in others:
        dx, dy, mid = ox - x, oy - y, (ox * ox + oy * oy - x * x - y * y) / 2
        beyond = [px * dx + py * dy - mid for px, py in ring]
        cut = []
        for i, (p, d) in enumerate(zip(ring, beyond, strict=True)):
            q, e = ring[i - 1], beyond[i - 1]
            if (d > 0) != (e > 0):
                t = e / (e - d)
                cut.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d <= 0:
                cut.append(p)
        ring = cut
        if not ring:
            break
    return ring


def voronoi(points: DataFrame, made: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``k, neighbours, area, ring`` of the points' Voronoi cells within ``box`` (west, south, east, north).

    The cell of a point is the box less what is nearer to one of the points whose cells touch its own. ``ring`` is an array
    of (x, y), counter-clockwise, the first corner not repeated. A point whose place a smaller id has too has no cell of its own.
    """
    west, south, east, north = box
    pairs = contiguity(made)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = points.select(F.col("k").alias("b"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("o"))
    near = both.join(at, "b").groupBy(F.col("a").alias("k")).agg(F.collect_list("o").alias("others"))

    def run(batches):
        for b in batches:
            rings = [_clipped(r.x, r.y, [(o["x"], o["y"]) for o in r.others], [(west, south), (east, south), (east, north), (west, north)]) for r in b.itertuples()]
            area = [sum(r[i - 1][0] * r[i][1] - r[i][0] * r[i - 1][1] for i in range(len(r))) / 2 for r in rings]
            yield pd.DataFrame({"k": b["k"], "neighbours": b["others"].map(len), "area": area, "ring": [[{"x": p[0], "y": p[1]} for p in r] for r in rings]})

    kind = points.schema["k"].dataType.simpleString()
    joined = near.join(points.select("k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "k")
    return joined.mapInPandas(run, f"k {kind}, neighbours int, area double, ring array<struct<x: double, y: double>>")
