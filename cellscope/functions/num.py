"""Numeric column functions: rounding regimes, log normalisation, clamps, bands, series statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def half_up_int(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity (-2.5 -> -2)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null stays null, where greatest and least alone would drop it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def norm_log(x: Column, anchor: Column | float) -> Column:
    """0..100 on a log scale that reaches 100 at ``anchor``; 0 for values that are not positive."""
    scaled = half_up_int(F.ln(F.lit(1.0) + x) / F.ln(F.lit(1.0) + lit(anchor)) * 100)
    return F.when(x > 0, F.least(F.lit(100), scaled)).otherwise(F.lit(0)).cast("int")


def band(x: Column, cuts: list[tuple[float, object]], last: object, op: str = "<=") -> Column:
    """Label of the first cut that x is within (``<=`` or ``<``), or ``last``; null for null."""
    out = F.when(x.isNull(), F.lit(None))
    for cut, label in cuts:
        out = out.when(x <= cut if op == "<=" else x < cut, F.lit(label))
    return out.otherwise(F.lit(last))


def band_desc(x: Column, cuts: list[tuple[float, object]], last: object) -> Column:
    """Label of the first cut that x reaches, largest cut first."""
    out = F.when(x.isNull(), F.lit(None))
    for cut, label in cuts:
        out = out.when(x >= cut, F.lit(label))
    return out.otherwise(F.lit(last))


def piecewise(x: Column, bands: list[tuple[float, float, float, float]], top: float) -> Column:
    """Linear within (low, high, out_low, out_high); the first band that holds x counts; capped above."""
    out = F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(None))
    for low, high, a, b in bands:
        out = out.when((x >= low) & (x <= high), half_up_int(F.lit((b - a) / (high - low)) * (x - low) + a))
    return out.otherwise(F.lit(int(top))).cast("int")


def last_valid(series: Column) -> Column:
    """The last element that is not null."""
    valid = F.filter(series, lambda v: v.isNotNull())
    return F.get(valid, F.size(valid) - 1)


def let(value: Column, use) -> Column:
    """Bind ``value`` once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trend(series: Column) -> Column:
    """Least-squares ``struct(slope, intercept, r2)`` over positions 0..n-1; null under three points.

    The mean and the sums are worked out once for a series.
    """
    n = F.size(series)
    mean_x = (n - 1) / F.lit(2.0)

    def sums(mean_y: Column) -> Column:
        centred = F.transform(series, lambda v, i: F.struct((i - mean_x).alias("x"), (v - mean_y).alias("y")))
        return F.aggregate(
            centred,
            F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
            lambda a, p: F.struct((a["xy"] + p["x"] * p["y"]).alias("xy"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["yy"] + p["y"] * p["y"]).alias("yy")),
        )

    def line(mean_y: Column, s: Column) -> Column:
        slope = s["xy"] / s["xx"]
        r2 = F.when(s["yy"] == 0, F.lit(1.0)).otherwise(clamp(s["xy"] * s["xy"] / (s["xx"] * s["yy"]), 0.0, 1.0))
        return F.struct(slope.alias("slope"), (mean_y - slope * mean_x).alias("intercept"), r2.alias("r2"))

    mean = F.aggregate(series, F.lit(0.0), lambda a, v: a + v) / n
    return F.when(n >= 3, let(mean, lambda m: let(sums(m), lambda s: line(m, s))))


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts; zeros and nulls take no part."""
    used = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(used, F.lit(0.0), lambda a, c: a + c)
    return F.aggregate(used, F.lit(0.0), lambda a, c: a - c / total * F.ln(c / total))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
