"""Relational operators: order statistics, allocation, normalisation, ranking, set operations, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import trend
from ..session import durable


def _ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, v, m, i, n``: each group's different values in order, how often each stands, the rank of its first, and the group's size.

    Values are counted where they are read and cut into ranges over all groups; a range's first rank is the count of
    what comes before it, so that no task holds a group. Nulls come first, as in Spark's order.
    """
    counts = df.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("m"))
    held = durable(counts.repartitionByRange(by, "v").withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy(by, "__p").agg(F.sum("m").alias("__m"))  # a row for each range and group
    first = parts.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__at"), F.sum("__m").over(Window.partitionBy(by)).alias("n"))
    own = Window.partitionBy("__p", by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("__n", F.coalesce(F.sum("m").over(own), F.lit(0)))
    return ranked.join(first, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__q"))).select(by, "v", "m", (F.col("__at") + F.col("__n")).alias("i"), "n")


def _at(at: Column) -> Column:
    """The value at a rank counted from 0, among rows of ``_ranked``."""
    return F.max(F.when((F.col("i") <= at) & (at < F.col("i") + F.col("m")), F.col("v")))


def positional_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: n, min, max, mean, upper median s[n // 2], s[int(.9 n)], s[int(.95 n)], and n - 1 variation.

    Order statistics come from the ranks of counted values; no task holds a group.
    """
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    picked = _ranked(df, by, value).groupBy(by).agg(_at(F.floor(F.col("n") / 2)).alias("upper_median"), _at(at(0.9)).alias("p90"), _at(at(0.95)).alias("p95"))
    plain = df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.avg(value)).alias("variation")
    )
    picked = picked.withColumnRenamed(by, "__by")
    return plain.join(picked, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", "low", "high", "mean", "upper_median", "p90", "p95", "variation")


def nearest_rank(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """``by, v``: the value at index round-half-even(share * (n - 1)) of each group."""
    at = F.bround(F.lit(share) * (F.col("n") - 1), 0).cast("long")
    return _ranked(df, by, value).filter((F.col("i") <= at) & (at < F.col("i") + F.col("m"))).select(by, "v")


def linear_percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the percentiles named in ``shares``, between the two values around a rank; nulls take no part."""
    place = lambda share: F.lit(share) * (F.col("n") - 1)
    ranked = _ranked(df.filter(F.col(value).isNotNull()), by, value)
    ends = ranked.groupBy(by).agg(F.first("n").alias("n"), *[_at(f(place(s))).alias(f"__{n}_{f.__name__}") for n, s in shares.items() for f in (F.floor, F.ceil)])

    def between(n: str, share: float) -> Column:
        low, high, at = F.col(f"__{n}_floor"), F.col(f"__{n}_ceil"), place(share)
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    found = ends.select(by, *[between(n, s).alias(n) for n, s in shares.items()])
    everyone = df.select(F.col(by).alias("__by")).distinct()
    return everyone.join(found, F.col("__by").eqNullSafe(F.col(by)), "left").select(F.col("__by").alias(by), *shares)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``key, share``: whole shares of ``total`` by weight that add up to it; the largest fractions round up."""
    everything = Window.partitionBy()
    raw = F.col(weight) / F.sum(weight).over(everything) * total
    parts = weights.select(key, raw.alias("raw")).select(key, F.floor("raw").cast("long").alias("base"), (F.col("raw") - F.floor("raw")).alias("frac"))
    left = F.lit(total) - F.sum("base").over(everything)
    order = F.row_number().over(everything.orderBy(F.desc("frac"), key))
    return parts.select(key, "base", "frac", left.alias("left"), order.alias("o")).select(key, (F.col("base") + (F.col("o") <= F.col("left")).cast("long")).alias("share"))


def min_max(df: DataFrame, values: list[str], constant: float) -> DataFrame:
    """Scale columns to 0..1 over all rows; a constant column becomes ``constant``. One row of bounds is joined."""
    bounds = df.agg(*[f(c).alias(f"{c}__{n}") for c in values for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(bounds))
    for c in values:
        span = F.col(f"{c}__hi") - F.col(f"{c}__lo")
        out = out.withColumn(c, F.when(span == 0, F.lit(constant)).otherwise((F.col(c) - F.col(f"{c}__lo")) / span))
    return out.drop(*bounds.columns)


def top_per_key(df: DataFrame, key: str, score: str, tie: str, n: int, ascending: bool = False) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.asc(score) if ascending else F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return new.join(seen.select(key), key, "left_anti")


def compare_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, n_a, n_b, delta`` of two count tables; a missing key counts 0."""
    both = a.select(key, F.col("n").alias("n_a")).join(b.select(key, F.col("n").alias("n_b")), key, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("delta", F.col("n_a") - F.col("n_b"))


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def series(df: DataFrame, key: str, time: str, value: Column) -> DataFrame:
    """``key, series``: values in time order, one per distinct time."""
    by_time = df.groupBy(key, time).agg(value.alias("v"))
    return by_time.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time, "v"))).alias("s")).select(key, F.transform("s", lambda x: x["v"]).alias("series"))


def trends(s: DataFrame, key: str) -> DataFrame:
    t = trend(F.col("series"))
    return s.select(key, t.alias("t")).select(key, "t.slope", "t.intercept", "t.r2")


def sequential_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Number rows 0, 1, ... by ``order`` (which must tell all rows apart) without sorting in one task.

    Rows are cut into ranges and written out; a range's first number is the count of all rows before it.
    """
    held = durable(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    first = held.groupBy("__p").count().withColumn("__at", F.sum("count").over(Window.orderBy("__p")) - F.col("count")).select("__p", "__at")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return held.withColumn("__n", own).join(F.broadcast(first), "__p").withColumn(name, F.col("__n") + F.col("__at")).drop("__p", "__n", "__at")
