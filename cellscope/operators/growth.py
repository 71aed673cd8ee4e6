"""Learned urban transitions, projections and regressions whose aggregates are made in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable
from . import network, raster


def ridge(samples: DataFrame, factors: list[str], target: str, penalty: float = 1.0) -> dict | None:
    """Weights of 0-to-100 factors (missing: 50) for a target, the intercept free of the penalty.

    The normal equations are sums over the rows, made in one aggregation of p(p+1)/2 numbers; only these
    reach the driver. Rows without a finite target take no part; None under two rows or if singular.
    """
    y = F.col(target).cast("double")
    x = [F.lit(1.0), *[F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), 50.0).otherwise(F.col(f)) / 100 for f in factors]]
    ok = samples.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    p = len(x)
    rows = ok.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], y.alias("y"))
    cross = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
    moments = [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)]
    got = rows.agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y")), *cross, *moments).first()
    n, sum_y, sum_yy = got[0], got[1], got[2]
    if n < 2:
        return None
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = got[3 : 3 + len(cross)]
    a = a + a.T - np.diag(np.diag(a))
    b = np.array(got[3 + len(cross) :], float)
    try:
        w = np.linalg.solve(a + penalty * np.diag([0.0] + [1.0] * (p - 1)), b)
    except np.linalg.LinAlgError:
        return None
    residual, total = sum_yy - 2 * w @ b + w @ a @ w, sum_yy - sum_y * sum_y / n
    r2 = max(0.0, min(1.0, 1 - residual / total)) if total > 0 else 1.0
    return {"intercept": float(w[0]), "weights": dict(zip(factors, w[1:].tolist(), strict=True)), "r2": float(r2), "n": n}


def transition_potential(cells: DataFrame, drivers: list[str], trees: int = 200, depth: int = 12, least: int = 5, seed: int = 42) -> DataFrame:
    """``row, col, potential`` from a forest fitted on cells that were not urban: did they become so?

    ``cells(row, col, was, now, drivers...)``; classes are weighted to equal totals. Cells that were urban
    have no potential; neither has any cell if nothing, or everything, changed.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    free = cells.filter(~F.col("was")).withColumn("label", F.col("now").cast("double"))
    n, changed = free.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < changed < n:
        return cells.select("row", "col", F.lit(0.0).alias("potential"))
    vectors = VectorAssembler(inputCols=drivers, outputCol="features")
    weight = F.when(F.col("label") == 1, n / (2 * changed)).otherwise(n / (2 * (n - changed)))
    fit = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, weightCol="w", seed=seed, maxMemoryInMB=512)
    model = fit.fit(vectors.transform(free.withColumn("w", weight)).select("features", "label", "w"))
    out = model.transform(vectors.transform(cells))
    return out.select("row", "col", F.when(F.col("was"), 0.0).otherwise(vector_to_array("probability")[1]).alias("potential"))


def project(urban: DataFrame, potential: DataFrame, demand: int, steps: int) -> DataFrame:
    """``row, col, p``: 1 for cells that are urban, less for cells that turn so later, 0.4 of the potential for the rest.

    ``urban(row, col, v)`` has 1 for urban. Each step's state is written out, so lineage stays short.
    """
    state, p = durable(urban.select("row", "col", F.col("v").cast("double").alias("v"))), potential.select("row", "col", F.col("potential").alias("p"))
    out = state.select("row", "col", F.when(F.col("v") == 1, 1.0).otherwise(0.0).alias("p"))
    for s in range(steps):
        after = durable(raster.ca_step(state, p, demand))
        new = after.filter("v = 1").join(state.filter("v = 1").select("row", "col"), ["row", "col"], "left_anti").select("row", "col", F.lit(1.0 - s / max(1, steps) * 0.6).alias("q"))
        out = durable(out.join(new, ["row", "col"], "left").select("row", "col", F.greatest("p", F.coalesce("q", F.lit(0.0))).alias("p")))
        state = after
    floor = potential.select("row", "col", (F.col("potential") * 0.4).alias("low"))
    return out.join(floor, ["row", "col"], "left").select("row", "col", F.greatest("p", F.coalesce("low", F.lit(0.0))).alias("p"))


def simulate(urban: DataFrame, potential: DataFrame, demand: int, steps: int) -> DataFrame:
    """``row, col, v`` after ``steps`` steps of growth; each step's state is written out and the one before it deleted."""
    state, p = durable(urban.select("row", "col", F.col("v").cast("double").alias("v"))), potential.select("row", "col", F.col("potential").alias("p"))
    for _ in range(max(0, steps)):
        after = durable(raster.ca_step(state, p, demand))
        discard(state)
        state = after
    return state


def hindcast(cells: DataFrame, drivers: list[str], steps: int = 3, trees: int = 200, depth: int = 12, least: int = 5) -> DataFrame:
    """One row, ``merit, kappa, demand``: how well growth learned on a first period foretells a second one.

    ``cells(row, col, first, middle, last, drivers...)`` says whether a cell was urban at three times. A forest learns the transition
    from first to middle; the demand of a step is what that period gained; ``steps`` steps from the
    middle are held against the last state.
    """
    potential = durable(transition_potential(cells.select("row", "col", F.col("first").alias("was"), F.col("middle").alias("now"), *drivers), drivers, trees, depth, least))
    state = lambda c: cells.select("row", "col", F.col(c).cast("double").alias("v"))
    demand = raster.markov_demand(state("first").withColumn("year", F.lit(0)).unionByName(state("middle").withColumn("year", F.lit(1)))).first()[0]
    grown = simulate(state("middle"), potential, demand, steps)
    return raster.agreement(state("middle"), grown, state("last")).withColumn("demand", F.lit(demand).cast("long"))


def rasterise(lines: DataFrame, south: float, west: float, cell: float) -> DataFrame:
    """``row, col``: cells that lines (lat1, lon1, lat2, lon2) touch, marked at steps of half a cell."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1"))) / (cell / 2)).cast("int"))
    at = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    on = lambda a, b, low: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") - low) / cell)
    return at.select(on("lat1", "lat2", south).alias("row"), on("lon1", "lon2", west).alias("col")).distinct()


def dual(edges: DataFrame) -> DataFrame:
    """``a, b``: pairs a < b of edges (k, u, v) that share a node, once each; a node of a street graph has few edges.

    A pair comes from the least node that both touch, so pairs are neither shuffled nor made distinct.
    """
    return network.metapaths(edges.select(F.col("k").alias("thing"), F.explode(F.array("u", "v")).alias("street")))
