"""Queries of the score models over derived inputs, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as m
from ..operators import tables
from . import geography as g

c = F.col


def _line(spark, d):
    return g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("q"), c("l_extendedprice").alias("p"), c("l_discount").alias("disc"), c("l_tax").alias("tax"), "l_partkey", "l_suppkey")


def growth_scores(spark, d):
    x = _line(spark, d)
    projects = F.when(c("l_linenumber") == 7, F.lit(None)).when(c("l_linenumber") == 6, F.array().cast("array<struct<value:double,age:double,km:double>>")).otherwise(
        F.array(F.struct((c("p") * 1000).alias("value"), (c("q") / 10).alias("age"), (c("disc") * 20).alias("km")))
    )
    y = x.select(
        "l_orderkey", "l_linenumber",
        m.built_up_expansion(c("q"), c("p") / 1500, c("tax") * 10, (c("l_linenumber") % 4).cast("double")).alias("bue"),
        F.when(c("l_linenumber") != 5, m.densification(c("q") - 25, c("p") / 1000)).alias("den"), m.capital_flow(projects).alias("cap"),
    )
    return y.select("l_orderkey", "l_linenumber", F.round("bue", 3).alias("bue"), F.round("den", 3).alias("den"), "cap", *[m.horizon(c("bue"), c("den"), c("cap"), h).alias(h) for h in m.HORIZONS])


def emerging_hotspots(spark, d):
    return _line(spark, d).select("l_orderkey", "l_linenumber", m.emerging_class(c("q") * 2, c("disc") * 20 - 1).alias("class"))


def heat_scores(spark, d):
    raw = F.when(c("l_linenumber") == 3, 0).otherwise(14500 + (c("l_partkey") % 900)).cast("int")
    around = (14500 + (c("l_suppkey") % 700)).cast("int")
    x = _line(spark, d).select("l_orderkey", "l_linenumber", m.lst_celsius(raw).alias("cell"), m.lst_celsius(around).alias("around"))
    return x.select("l_orderkey", "l_linenumber", F.round("cell", 6).alias("cell"), m.heat_island(c("cell"), c("around")).alias("uhi"))


def scs_runoff(spark, d):
    r = m.runoff_mm(c("q") * 3, 60 + c("l_linenumber") * 5.0)
    return _line(spark, d).select("l_orderkey", "l_linenumber", F.round(r, 6).alias("runoff_mm"), F.round(r * 0.004, 6).alias("depth_m"))


def scs_scenarios(spark, d):
    """Mean runoff and volume per rainfall scenario: each row meets a constant array of scenarios."""
    rains = F.explode(F.array(*[F.lit(float(v)) for v in (25, 50, 75, 100, 150, 200, 300)]))
    x = g.table(spark, d, "orders").select((F.lit(60.0) + c("o_orderkey") % 35).alias("cn"), rains.alias("rain"))
    r = m.runoff_mm(c("rain"), c("cn"))
    return x.groupBy("rain").agg(F.round(F.avg(r), 6).alias("runoff_mm"), F.round(F.sum(r) / 1000 * 900, 3).alias("volume_m3"))


def los_grade(spark, d):
    names = F.array(*[F.lit(k) for k in ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "other")])
    x = g.roads(spark, d).select("k", m.capacity_of(F.element_at(names, (c("class") + 1).cast("int"))).alias("cap"), ((c("k") % 997) / 997.0).alias("b"), (c("k") % 5 == 0).alias("bridge"))
    x = x.withColumn("vc", c("b") / c("cap"))
    return x.select("k", F.round("vc", 6).alias("vc"), m.level_of_service(c("vc")).alias("los"), m.criticality(c("b") / 50, c("bridge")).alias("criticality"), m.congestion_risk(F.round("vc", 6)).alias("risk"))


def transit_access(spark, d):
    h = F.when(c("l_linenumber") != 4, c("q"))
    return _line(spark, d).select("l_orderkey", "l_linenumber", m.transit_access(h, c("l_linenumber")).alias("access"), m.coverage_access(c("l_linenumber") - 2).alias("coverage"))


def mobility_risk(spark, d):
    seal = c("l_suppkey") % 11 == 0
    risk = m.mobility_risk(c("q") / 8, c("l_partkey") % 3 == 0, seal, c("p") / 200)
    return _line(spark, d).select("l_orderkey", "l_linenumber", risk.alias("risk"), m.access_class(risk, seal).alias("access"))


def aqi_index(spark, d):
    return _line(spark, d).select("l_orderkey", "l_linenumber", m.aqi(F.when(c("l_linenumber") != 2, c("q") * 11), c("q") * 13).alias("aqi"))


def informality_index(spark, d):
    """Six features per cell, scaled over all cells (constant: 0.5), two of them inverted, weighted."""
    x = g.table(spark, d, "lineitem").groupBy((c("l_suppkey") % 64).alias("cell")).agg(
        (F.stddev_samp("l_quantity") / F.avg("l_quantity")).alias("size_cv"), F.avg("l_discount").alias("entropy"), F.avg("l_tax").alias("road"),
        F.sum("l_quantity").alias("density"), F.avg("l_extendedprice").alias("area"), F.count("*").cast("double").alias("n"),
    )
    s = tables.min_max(x, ["size_cv", "entropy", "road", "density", "area", "n"], 0.5)
    index = c("size_cv") * 0.2 + c("entropy") * 0.2 + (F.lit(1.0) - c("road")) * 0.2 + c("density") * 0.15 + (F.lit(1.0) - c("area")) * 0.15 + c("n") * 0.1
    return s.select("cell", F.round(index, 4).alias("informality"))


def crowd_capacity(spark, d):
    flow, standing = m.crowd_capacity(c("q") / 5, c("p") / 100)
    return _line(spark, d).select("l_orderkey", "l_linenumber", flow, standing).select("l_orderkey", "l_linenumber", F.round("flow_per_min", 6).alias("flow_per_min"), F.round("standing", 6).alias("standing"))


def parking_pressure(spark, d):
    v = m.parking_pressure(c("q"), c("l_linenumber") * 5, c("l_partkey") % 4, c("disc") * 10 + 0.5)
    return _line(spark, d).select("l_orderkey", "l_linenumber", F.round(v, 6).alias("pressure"))


def hotspot_score(spark, d):
    """The thirty most congested edges; edges with fewer than five vehicles are left out."""
    x = g.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("vehicles"), F.avg("l_quantity").alias("speed"), (F.sum(F.col("l_quantity") * (c("l_suppkey") % 9)) / 4).alias("waiting"), (F.sum("l_quantity") * (c("l_suppkey") % 5) / 2).alias("loss"), F.avg("l_discount").alias("occupancy"),
    )
    score = m.hotspot_score(c("vehicles"), c("speed"), c("l_suppkey") % 4 * 15 + 20, c("waiting"), c("loss"), c("occupancy"))
    return x.filter("vehicles >= 5").select("l_suppkey", "vehicles", score.alias("score")).orderBy(F.desc("score"), "l_suppkey").limit(30)


def scenario_adjust(spark, d):
    p = c("q") * 2
    out = [m.scenario(k, p, c("disc") * 40, c("q") * 1.5, c("p") / 300).alias(k) for k in ("transit_hub", "protect_flood", "curb_sprawl")]
    return _line(spark, d).select("l_orderkey", "l_linenumber", *out)


def discharge_risk(spark, d):
    return _line(spark, d).select("l_orderkey", "l_linenumber", m.discharge_risk(c("q") / 8).alias("risk"))


def index_change(spark, d):
    """Two scenes on the same pixels: built-up index before and after, and the direction of change."""
    x = _line(spark, d).select((c("l_partkey") % 50).alias("row"), (c("l_suppkey") % 50).alias("col"), "q", "tax", "disc")
    a = x.groupBy("row", "col").agg(F.avg("q").alias("swir"), F.avg(c("disc") * 500).alias("nir"))
    b = x.groupBy("row", "col").agg(F.max("q").alias("swir2"), F.avg(c("tax") * 600).alias("nir2"))
    v = F.round(m.normalised_difference(c("swir2"), c("nir2")) - m.normalised_difference(c("swir"), c("nir")), 6)
    return a.join(b, ["row", "col"]).select("row", "col", v.alias("change"), F.when(v > 0.15, "growth").when(v < -0.15, "loss").otherwise("none").alias("direction"))


def estate_outlook(spark, d):
    """Weighted mean of the factors that are known, per intent; with the drivers' number as confidence."""
    f = {"access": c("q") * 2, "growth": F.when(c("l_linenumber") != 3, c("disc") * 1000), "flood": F.when(c("l_linenumber") != 5, c("tax") * 1000), "green": (c("l_partkey") % 100).cast("double")}
    w = {"invest": {"access": 2.0, "growth": 3.0, "flood": -1.0, "green": 0.5}, "live": {"access": 1.5, "growth": 0.5, "flood": -2.0, "green": 2.0}}
    x = _line(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in f.items()])
    value = lambda k, s: (F.lit(100.0) - c(k)) * -s if s < 0 else c(k) * s
    out = []
    for intent, weights in w.items():
        total = sum((F.when(c(k).isNotNull(), abs(s)).otherwise(0.0) for k, s in weights.items()), F.lit(0.0))
        out.append(F.round(sum((F.coalesce(value(k, s), F.lit(0.0)) for k, s in weights.items()), F.lit(0.0)) / total, 4).alias(intent))
    known = sum((c(k).isNotNull().cast("int") for k in f), F.lit(0))
    return x.select("l_orderkey", "l_linenumber", *out, known.cast("int").alias("factors"))


_Q = "SELECT l_orderkey, l_linenumber, "
_AQI = lambda x, bands: "CASE WHEN {0} IS NULL OR {0} < 0 THEN NULL {1} ELSE 500 END".format(x, " ".join(f"WHEN {x} >= {a} AND {x} <= {b} THEN floor({(j - i) / (b - a)!r}::DOUBLE * ({x} - {a}) + {i} + 0.5)" for a, b, i, j in bands))
_LOGN = "CASE WHEN {0} > 0 THEN least(100, floor(ln(1.0::DOUBLE + {0}) / ln(1.0::DOUBLE + 500000000.0::DOUBLE) * 100 + 0.5)) ELSE 0 END"
_RUN = "CASE WHEN {r} - (25400.0::DOUBLE / {cn} - 254) * 0.2::DOUBLE > 0 THEN pow({r} - (25400.0::DOUBLE / {cn} - 254) * 0.2::DOUBLE, 2) / ({r} - (25400.0::DOUBLE / {cn} - 254) * 0.2::DOUBLE + (25400.0::DOUBLE / {cn} - 254)) ELSE 0.0::DOUBLE END"
_BUE = "greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + 25 * tanh((l_quantity - prev) / prev * 100 / 8) + 15 * tanh(l_tax * 10) + least(10.0, (l_linenumber % 4) * 2.0)))"


def _horizon(w):
    total = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {v}::DOUBLE END" for k, v in zip(("bue", "den", "cap"), w, strict=True))
    value = " + ".join(f"coalesce({k} * {v}::DOUBLE, 0)" for k, v in zip(("bue", "den", "cap"), w, strict=True))
    return f"floor(({value}) / ({total}) + 0.5)::INT"


QUERIES = {
    "growth_scores": (growth_scores, f"""WITH x AS (SELECT *, l_extendedprice / 1500 AS prev, CASE WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice * 1000 * exp(-(l_quantity / 10) / 2) * exp(-(l_discount * 20) / 1.5::DOUBLE) END AS w FROM lineitem),
        y AS (SELECT l_orderkey, l_linenumber, {_BUE} AS bue, CASE WHEN l_linenumber <> 5 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + 25 * tanh((l_quantity - 25) / 15) + least(15.0::DOUBLE, l_extendedprice / 1000 / 8))) END AS den, CASE WHEN w IS NOT NULL THEN ({_LOGN.format('w')})::INT END AS cap FROM x)
        SELECT l_orderkey, l_linenumber, round(bue, 3) AS bue, round(den, 3) AS den, cap, {", ".join(f"{_horizon(w)} AS {h}" for h, w in m.HORIZONS.items())} FROM y"""),
    "emerging_hotspots": (emerging_hotspots, _Q + """CASE WHEN lv >= 60 AND s > 0.5 THEN 'intensifying' WHEN lv >= 60 AND s < -0.5 THEN 'diminishing' WHEN lv >= 60 THEN 'persistent' WHEN s > 0.5 THEN 'emerging' WHEN s < -0.5 THEN 'cooling' ELSE 'stable' END AS class
        FROM (SELECT *, l_quantity * 2 AS lv, l_discount * 20 - 1 AS s FROM lineitem)"""),
    "heat_scores": (heat_scores, _Q + """round(cell, 6) AS cell, greatest(0, least(100, floor((cell - around + 2) * 12 + 0.5)))::INT AS uhi FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN (14500 + l_partkey % 900) / 50.0::DOUBLE - 273.15::DOUBLE END AS cell,
        (14500 + l_suppkey % 700) / 50.0::DOUBLE - 273.15::DOUBLE AS around FROM lineitem WHERE true) WHERE cell IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL FROM lineitem WHERE l_linenumber = 3"""),
    "scs_runoff": (scs_runoff, _Q + f"round(r, 6) AS runoff_mm, round(r * 0.004::DOUBLE, 6) AS depth_m FROM (SELECT *, {_RUN.format(r='(l_quantity * 3)', cn='(60 + l_linenumber * 5.0::DOUBLE)')} AS r FROM lineitem)"),
    "scs_scenarios": (scs_scenarios, f"SELECT rain, round(avg(r), 6) AS runoff_mm, round(sum(r) / 1000 * 900, 3) AS volume_m3 FROM (SELECT rain, {_RUN.format(r='rain', cn='(60.0::DOUBLE + o_orderkey % 35)')} AS r FROM orders, (VALUES (25.0::DOUBLE), (50), (75), (100), (150), (200), (300)) t(rain)) GROUP BY rain"),
    "los_grade": (los_grade, f"""SELECT k, round(vc, 6) AS vc, CASE WHEN vc <= 0.35 THEN 'A' WHEN vc <= 0.55 THEN 'B' WHEN vc <= 0.75 THEN 'C' WHEN vc <= 0.9 THEN 'D' WHEN vc <= 1.0 THEN 'E' ELSE 'F' END AS los,
        CASE WHEN k % 5 = 0 AND b / 50 > 0.01 THEN 'critical' WHEN k % 5 = 0 OR b / 50 > 0.01 THEN 'high' WHEN b / 50 > 0.005 THEN 'medium' ELSE 'low' END AS criticality, round_even(least(1.0::DOUBLE, round(vc, 6)) * 100, 0)::INT AS risk
        FROM (SELECT k, b, b / ([1.0, 0.9, 0.75, 0.55, 0.4, 0.25, 0.15, 0.3]::DOUBLE[])[class + 1] AS vc FROM (SELECT k, class, (k % 997) / 997.0::DOUBLE AS b FROM {g.ROAD}))"""),
    "transit_access": (transit_access, _Q + """round_even(least(100.0::DOUBLE, CASE WHEN l_linenumber = 4 THEN 10.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - (l_quantity - 5) * 4)) END * 0.8::DOUBLE + least(20.0::DOUBLE, l_linenumber * 5.0)), 0)::INT AS access,
        greatest(0, least(100, (l_linenumber - 2) * 25))::INT AS coverage FROM lineitem"""),
    "mobility_risk": (mobility_risk, _Q + """risk, CASE WHEN l_suppkey % 11 = 0 OR risk >= 66 THEN 'Restricted' WHEN risk >= 40 THEN 'Constrained' ELSE 'Smooth' END AS access FROM (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 8 / 5.0::DOUBLE) * 35
        + (l_partkey % 3 = 0)::INT * 25 + (l_suppkey % 11 = 0)::INT * 20 + (1.0::DOUBLE - least(1.0::DOUBLE, l_extendedprice / 200 / 400.0::DOUBLE)) * 20)), 0)::INT AS risk FROM lineitem)"""),
    "aqi_index": (aqi_index, _Q + f"greatest(({_AQI('a', m.PM25)})::INT, ({_AQI('b', m.PM10)})::INT) AS aqi FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_quantity * 11 END AS a, l_quantity * 13 AS b FROM lineitem)"),
    "informality_index": (informality_index, """WITH x AS (SELECT l_suppkey % 64 AS cell, stddev_samp(l_quantity) / avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, sum(l_quantity) AS d, avg(l_extendedprice) AS e, count(*)::DOUBLE AS f FROM lineitem GROUP BY 1),
        y AS (SELECT cell, """ + ", ".join(f"CASE WHEN max({v}) OVER () = min({v}) OVER () THEN 0.5::DOUBLE ELSE ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) END AS {v}" for v in "abcdef") + """ FROM x)
        SELECT cell, round(a * 0.2::DOUBLE + b * 0.2::DOUBLE + (1 - c) * 0.2::DOUBLE + d * 0.15::DOUBLE + (1 - e) * 0.15::DOUBLE + f * 0.1::DOUBLE, 4) AS informality FROM y"""),
    "crowd_capacity": (crowd_capacity, _Q + "round(l_quantity / 5 * 0.75::DOUBLE * 82, 6) AS flow_per_min, round(l_quantity / 5 * 0.75::DOUBLE * (l_extendedprice / 100) * 2, 6) AS standing FROM lineitem"),
    "parking_pressure": (parking_pressure, _Q + "round(greatest(0.0::DOUBLE, (l_quantity * 15 - l_linenumber * 5 * 10 + l_partkey % 4 * 5) * (l_discount * 10 + 0.5::DOUBLE)), 6) AS pressure FROM lineitem"),
    "hotspot_score": (hotspot_score, """SELECT l_suppkey, vehicles, round((40 * greatest(0.0::DOUBLE, 1 - speed / (20 + 15 * (l_suppkey % 4))) + 1.5::DOUBLE * least(waiting / vehicles, 30) + 0.8::DOUBLE * least(loss / vehicles, 60) + 20 * occupancy)
        * least(vehicles / 50, 2), 1) AS score FROM (SELECT l_suppkey, count(*) AS vehicles, avg(l_quantity) AS speed, sum(l_quantity * (l_suppkey % 9)) / 4 AS waiting, sum(l_quantity) * (l_suppkey % 5) / 2 AS loss, avg(l_discount) AS occupancy FROM lineitem GROUP BY 1)
        WHERE vehicles >= 5 ORDER BY score DESC, l_suppkey LIMIT 30"""),
    "scenario_adjust": (scenario_adjust, _Q + """floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, l_quantity * 2 + 25 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - l_discount * 40 / 3)))) + 0.5)::INT AS transit_hub,
        floor(least(100.0::DOUBLE, CASE WHEN l_quantity * 1.5::DOUBLE >= 60 THEN l_quantity * 2 * 0.4::DOUBLE WHEN l_quantity * 1.5::DOUBLE >= 40 THEN l_quantity * 2 * 0.7::DOUBLE ELSE l_quantity * 2 END) + 0.5)::INT AS protect_flood,
        floor(least(100.0::DOUBLE, CASE WHEN l_extendedprice / 300 < 50 THEN l_quantity * 2 * 0.5::DOUBLE WHEN l_extendedprice / 300 < 150 THEN l_quantity * 2 * 0.8::DOUBLE ELSE l_quantity * 2 END) + 0.5)::INT AS curb_sprawl FROM lineitem"""),
    "discharge_risk": (discharge_risk, _Q + "CASE WHEN l_quantity / 8 < 1.2::DOUBLE THEN 'normal' WHEN l_quantity / 8 < 2 THEN 'elevated' WHEN l_quantity / 8 < 4 THEN 'high' WHEN l_quantity / 8 < 6 THEN 'severe' ELSE 'extreme' END AS risk FROM lineitem"),
    "index_change": (index_change, """SELECT row, col, v AS change, CASE WHEN v > 0.15::DOUBLE THEN 'growth' WHEN v < -0.15::DOUBLE THEN 'loss' ELSE 'none' END AS direction FROM (SELECT row, col, round((CASE WHEN s2 + n2 = 0 THEN 0.0::DOUBLE ELSE (s2 - n2) / (s2 + n2) END) - (CASE WHEN s1 + n1 = 0 THEN 0.0::DOUBLE ELSE (s1 - n1) / (s1 + n1) END), 6) AS v
        FROM (SELECT l_partkey % 50 AS row, l_suppkey % 50 AS col, avg(l_quantity) AS s1, avg(l_discount * 500) AS n1, max(l_quantity) AS s2, avg(l_tax * 600) AS n2 FROM lineitem GROUP BY ALL))"""),
    "estate_outlook": (estate_outlook, _Q + """round((a * 2 + coalesce(b * 3, 0) + coalesce(100 - f, 0) + e * 0.5::DOUBLE) / (2.5::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 3 END + CASE WHEN f IS NULL THEN 0 ELSE 1 END), 4) AS invest,
        round((a * 1.5::DOUBLE + coalesce(b * 0.5::DOUBLE, 0) + coalesce((100 - f) * 2, 0) + e * 2) / (3.5::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN f IS NULL THEN 0 ELSE 2 END), 4) AS live,
        (2 + (b IS NOT NULL)::INT + (f IS NOT NULL)::INT)::INT AS factors FROM (SELECT *, l_quantity * 2 AS a, CASE WHEN l_linenumber <> 3 THEN l_discount * 1000 END AS b, CASE WHEN l_linenumber <> 5 THEN l_tax * 1000 END AS f, (l_partkey % 100)::DOUBLE AS e FROM lineitem)"""),
}
