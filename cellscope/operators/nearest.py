"""Nearest neighbours by a count-balanced quadtree, for points however unevenly spread.

1. Targets fall into quadtree cells, split two levels a round from counts until a cell holds a bounded number: its
   leaf. Targets that share one place beyond that are cut into slices by id. Only rows of overfull cells are counted again.
2. Leaves are known by their number of targets and by the box of their targets' unit vectors, in which straight-line
   distance orders as distance on the globe does, poles and the date line included. The leaf size grows with
   the targets so that there are never more than MOST_LEAVES full ones; their bounds are broadcast.
3. A point's upper bound is the least distance within which leaves surely hold k targets. It is sent to the leaves that
   reach within that bound, and to no other.
4. A leaf's targets and the points sent to it meet in one group, in slices where many points are sent; each point keeps a
   few of the best there, and one window ranks what its leaves returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import discard, durable

LEAF, MOST_LEAVES, DEPTH = 256, 50_000, 26
# Points of a group, and points that are held against the leaves together.
POINTS, TILE = 20_000, 64
# Kept beside the k best of a leaf: distances that differ in the last digit are ordered at the end, by one formula.
SPARE = 4
RADIUS = 6371.0


GLOBE = (-90.0, -180.0, 90.0, 180.0)


def _place(low: float, high: float, c: str) -> Column:
    share = (F.col(c) - low) / (high - low) if high > low else F.lit(0.0)
    return F.least(F.floor(share * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")


def leaves_of(targets: DataFrame, size: int, box: tuple[float, float, float, float] = GLOBE) -> DataFrame:
    """``t, tlat, tlon, leaf`` of all targets: the quadtree cell of ``box`` (south, west, north, east), and slice of it, that each is in."""
    open_, parts, depth = targets.withColumns({"x": _place(box[1], box[3], "tlon"), "y": _place(box[0], box[2], "tlat")}), [], 0
    while True:
        depth = min(DEPTH, depth + 2)
        cell = F.concat_ws("/", F.lit(depth), F.shiftright("x", DEPTH - depth), F.shiftright("y", DEPTH - depth))
        placed = open_.withColumn("cell", cell)
        one_place = (F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))
        full = placed.groupBy("cell").agg(F.count("*").alias("n"), one_place.alias("whole")).filter(F.col("n") > size)
        marked = durable(placed.join(F.broadcast(full), "cell", "left"))  # at most one row for each ``size`` targets
        slice_ = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / size))).cast("string")
        last = depth == DEPTH
        parts.append((marked if last else marked.filter("n is null or whole")).select("t", "tlat", "tlon", F.concat_ws("/", "cell", slice_).alias("leaf")))
        open_ = marked.filter("n is not null and not whole").select("t", "tlat", "tlon", "x", "y")
        if last or open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return durable(out)


def _unit(lat: Column, lon: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def box_distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between boxes ``low..high`` (m, 3) and ``lows..highs`` (n, 3)."""
    gap = np.maximum(0.0, np.maximum(low[:, None] - highs[None], lows[None] - high[:, None]))
    far = np.maximum(np.abs(high[:, None] - lows[None]), np.abs(highs[None] - low[:, None]))
    return (gap * gap).sum(axis=2), (far * far).sum(axis=2)


def sure_reach(far: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per row the least of ``far`` within which the counts add up to k; infinite where they don't."""
    order = np.argsort(far, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k
    at = enough.argmax(axis=1)
    reach = np.take_along_axis(far, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
    return np.where(enough.any(axis=1), reach, np.inf)


class Leaves:
    """Bounds and counts of all leaves, in blocks of neighbouring leaves with bounds of their own."""

    def __init__(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> None:
        self.low, self.high, self.counts = low, high, counts
        step = max(1, int(len(counts) ** 0.5))
        self.cuts = np.arange(0, len(counts), step)
        self.ends = np.minimum(self.cuts + step, len(counts))
        self.block_low, self.block_high = np.minimum.reduceat(low, self.cuts), np.maximum.reduceat(high, self.cuts)
        self.block_counts = np.add.reduceat(counts, self.cuts)

    def candidates(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, leaf) where the leaf may hold one of the point's k nearest; the points lie near each other."""
        low, high = points.min(axis=0, keepdims=True), points.max(axis=0, keepdims=True)
        near, far = box_distances(low, high, self.block_low, self.block_high)
        blocks = np.flatnonzero(near[0] <= _slack(sure_reach(far, self.block_counts, k))[0])
        own = np.concatenate([np.arange(self.cuts[b], self.ends[b]) for b in blocks])
        near, far = box_distances(low, high, self.low[own], self.high[own])
        own = own[near[0] <= _slack(sure_reach(far, self.counts[own], k))[0]]
        near, far = box_distances(points, points, self.low[own], self.high[own])
        at, leaf = np.nonzero(near <= _slack(sure_reach(far, self.counts[own], k))[:, None])
        return at, own[leaf]


def _slack(squared: np.ndarray) -> np.ndarray:
    """A little more than a squared distance, for what rounding may take."""
    return squared * (1 + 1e-9) + 1e-18


def haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def nearest_k(points: DataFrame, targets: DataFrame, k: int = 1) -> DataFrame:
    """``k, rank, t, d`` of each point's k nearest targets (both ``k, lat, lon``), ties to the smaller id; fewer if there are fewer.

    Points and targets without a place take no part. Ids may repeat among the points, which then are one point with
    as many places. Kilometres on a sphere.
    """
    placed = targets.filter("lat is not null and lon is not null").select(F.col("k").alias("t"), F.col("lat").cast("double").alias("tlat"), F.col("lon").cast("double").alias("tlon"))
    asked = points.filter("lat is not null and lon is not null").select("k", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    spark, kinds = points.sparkSession, {"k": asked.schema["k"].dataType.simpleString(), "t": placed.schema["t"].dataType.simpleString()}
    own = leaves_of(placed, max(LEAF, placed.count() // MOST_LEAVES))
    unit = [c.alias(n) for c, n in zip(_unit(F.col("tlat"), F.col("tlon")), "xyz", strict=True)]
    bounds = own.select("leaf", *unit).groupBy("leaf").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])
    rows = bounds.orderBy("leaf").toPandas()  # bounded: see MOST_LEAVES
    if rows.empty:
        return asked.limit(0).select("k", F.lit(0).alias("rank"), F.lit(None).cast(kinds["t"]).alias("t"), F.lit(0.0).alias("d"))
    box = lambda f: rows[[f"{f}_{c}" for c in "xyz"]].to_numpy(float)
    shared = spark.sparkContext.broadcast((Leaves(box("min") - 1e-12, box("max") + 1e-12, rows["n"].to_numpy()), rows["leaf"].to_numpy(str)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves, names = shared.value
        for batch in batches:
            lat, lon = batch["lat"].to_numpy(), batch["lon"].to_numpy()
            units = unit_vectors(lat, lon)
            order = np.argsort(_curve(lat, lon))
            found = []
            for i in range(0, len(order), TILE):
                tile = order[i : i + TILE]
                at, leaf = leaves.candidates(units[tile], k)
                found.append((tile[at], leaf))
            at, leaf = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            yield batch.iloc[at].assign(leaf=names[leaf])

    sent = durable(asked.mapInPandas(send, f"k {kinds['k']}, lat double, lon double, leaf string"))
    hot = sent.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > POINTS).select("leaf", F.ceil(F.col("n") / POINTS).cast("int").alias("slices"))
    hot = F.broadcast(hot)  # at most one row for each POINTS rows that are sent
    slices = F.coalesce("slices", F.lit(1))
    left = sent.join(hot, "leaf", "left").withColumn("slice", F.pmod(F.xxhash64("k", "lat", "lon"), slices).cast("int"))
    right = own.join(hot, "leaf", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))

    def meet(near: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("t", kind="stable")
        lat, lon = held["tlat"].to_numpy(), held["tlon"].to_numpy()
        keep, parts = min(k + SPARE, len(held)), []
        for i in range(0, len(near) if keep else 0, 512):
            part = near.iloc[i : i + 512]
            d = haversine(part["lat"].to_numpy()[:, None], part["lon"].to_numpy()[:, None], lat[None], lon[None])
            best = np.argsort(d, axis=1, kind="stable")[:, :keep]
            parts.append(pd.concat([part.iloc[np.repeat(np.arange(len(part)), keep)][["k", "lat", "lon"]].reset_index(drop=True), held.iloc[best.ravel()][["t", "tlat", "tlon"]].reset_index(drop=True)], axis=1))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["k", "lat", "lon", "t", "tlat", "tlon"])

    pairs = left.drop("slices").groupBy("leaf", "slice").cogroup(right.drop("slices").groupBy("leaf", "slice")).applyInPandas(meet, f"k {kinds['k']}, lat double, lon double, t {kinds['t']}, tlat double, tlon double")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"), RADIUS)
    ranked = pairs.select("k", "t", d.alias("d")).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("d", "t")))
    out = durable(ranked.filter(F.col("rank") <= k).select("k", "rank", "t", "d"))
    discard(sent)
    shared.unpersist()
    return out


def _curve(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places along a curve that visits quadtree cells one after the other."""
    out = np.zeros(len(lat), np.int64)
    x, y = (((lon + 180) / 360) * (1 << 26)).astype(np.int64), (((lat + 90) / 180) * (1 << 26)).astype(np.int64)
    for i in range(26):
        out |= (x >> i & 1) << (2 * i) | (y >> i & 1) << (2 * i + 1)
    return out
