"""Outlook of a place for property: weighted factors, drivers, confidence and an appreciation band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import band_desc, clamp

# Factors with their weights, in the order that breaks ties.
FACTORS = {
    "accessibility": 1.0, "jobs": 0.9, "walkability": 0.8, "green": 0.6, "schools": 0.6, "healthcare": 0.4, "devPotential": 0.9, "pipeline": 0.8, "redevelopment": 0.5,
    "modernization": 0.3, "buildingChangeTrend": 1.0, "futureExpansion": 0.8, "caGrowthPrediction": 0.9, "transitAccess": 0.7, "floodSafety": 0.9, "airQuality": 0.4,
    "quietness": 0.3, "lowCongestion": 0.5,
}
# What an intent multiplies weights with; 1 where it names no factor.
INTENTS = {
    "balanced": {},
    "live": {
        "walkability": 1.3, "green": 1.4, "schools": 1.4, "healthcare": 1.3, "quietness": 1.6, "floodSafety": 1.5, "airQuality": 1.4, "jobs": 0.8, "pipeline": 0.4, "redevelopment": 0.4,
        "devPotential": 0.5, "buildingChangeTrend": 0.6, "futureExpansion": 0.6, "caGrowthPrediction": 0.6, "transitAccess": 1.4, "lowCongestion": 1.4,
    },
    "invest": {
        "accessibility": 1.3, "jobs": 1.4, "pipeline": 1.5, "devPotential": 1.3, "walkability": 1.1, "modernization": 1.1, "quietness": 0.5, "schools": 0.8, "buildingChangeTrend": 1.4,
        "futureExpansion": 1.4, "caGrowthPrediction": 1.5, "transitAccess": 1.2, "lowCongestion": 0.8,
    },
    "build": {
        "devPotential": 1.7, "redevelopment": 1.7, "pipeline": 1.3, "accessibility": 1.1, "walkability": 0.7, "green": 0.6, "schools": 0.6, "healthcare": 0.6, "quietness": 0.4,
        "buildingChangeTrend": 1.5, "futureExpansion": 1.6, "caGrowthPrediction": 1.6, "transitAccess": 1.0, "lowCongestion": 0.6,
    },
}
# Least scores of the outlook's bands.
BANDS = [(70, "strong"), (58, "above"), (43, "stable"), (30, "soft")]
# Half width of the appreciation band by confidence, in percent.
WIDTHS = {"high": 1.5, "medium": 2.5, "low": 4.0}


def flood_safety(peak_ratio: Column, risk: Column) -> Column:
    """From the peak discharge ratio, else from a risk score."""
    return F.when(peak_ratio.isNotNull(), clamp(F.lit(100.0) - (peak_ratio - 1) * F.lit(100 / 3), 0.0, 100.0)).otherwise(F.lit(100.0) - clamp(risk, 0.0, 100.0))


def air_quality(aqi: Column) -> Column:
    return clamp(F.lit(100.0) - aqi / 300 * 100, 0.0, 100.0)


def share_or_score(v: Column) -> Column:
    """A 0-to-1 probability or a 0-to-100 score as a score."""
    return clamp(F.when(v <= 1, v * 100).otherwise(v), 0.0, 100.0)


def weights_of(intent: str) -> dict[str, float]:
    """Weights for an intent; unknown ones count as balanced."""
    own = INTENTS.get(intent, {})
    return {k: w * own.get(k, 1.0) for k, w in FACTORS.items()}


def outlook(values: Column, intent: str = "balanced", base_pct: float = 6.0, spread_pct: float = 6.0) -> Column:
    """The outlook of a ``map<string,double>`` of factors (0 to 100; absent or null: no evidence).

    ``struct(score, band, confidence, used, low, mid, high, lifted, held)``; lifted and held name the three
    factors that raise and lower the score most. Without evidence the score is null.
    """
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.lit(w).alias("w"), F.try_element_at(values, F.lit(k)).alias("v")) for i, (k, w) in enumerate(weights_of(intent).items())])
    known = F.transform(F.filter(own, lambda f: f["v"].isNotNull()), lambda f: F.struct(f["i"], f["key"], f["w"], clamp(f["v"], 0.0, 100.0).alias("v")))
    return _let(known, lambda fs: _let(_evidence(fs), lambda e: _outlook(fs, e, base_pct, spread_pct)))


def _let(value: Column, use) -> Column:
    """Bind ``value`` once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _evidence(fs: Column) -> Column:
    sums = F.aggregate(fs, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v")), lambda a, f: F.struct((a["w"] + f["w"]).alias("w"), (a["v"] + f["w"] * f["v"]).alias("v")))
    used, ratio = F.size(fs), F.size(fs) / F.lit(float(len(FACTORS)))
    confidence = F.when(used == 0, "no_data").when(ratio >= 0.6, "high").when(ratio >= 0.35, "medium").otherwise("low")
    return F.struct(F.when(used > 0, _let(sums, lambda x: F.floor(x["v"] / x["w"] + 0.5))).alias("score"), confidence.alias("confidence"))


def _outlook(fs: Column, e: Column, base_pct: float, spread_pct: float) -> Column:
    score, confidence = e["score"], e["confidence"]
    half = F.try_element_at(F.create_map(*[x for k, v in WIDTHS.items() for x in (F.lit(k), F.lit(v))]), confidence)
    mid = F.lit(base_pct) + (score - 50) / 50.0 * spread_pct
    pull = F.transform(fs, lambda f: F.struct((-F.abs(F.round(f["w"] * (f["v"] - 50), 1))).alias("size"), f["i"].alias("i"), f["key"].alias("key"), (f["w"] * (f["v"] - 50)).alias("c")))
    top = lambda keep: F.array_join(F.transform(F.slice(F.array_sort(F.filter(pull, keep)), 1, 3), lambda p: p["key"]), ",")
    return F.struct(
        score.alias("score"), F.coalesce(band_desc(score, BANDS, "weak"), F.lit("unknown")).alias("band"), confidence.alias("confidence"), F.size(fs).alias("used"),
        F.round(mid - half, 1).alias("low"), F.round(mid, 1).alias("mid"), F.round(mid + half, 1).alias("high"),
        top(lambda p: (p["size"] < 0) & (p["c"] > 0)).alias("lifted"), top(lambda p: (p["size"] < 0) & (p["c"] < 0)).alias("held"),
    )
