"""Queries of graph, raster and streaming operators, with oracle SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, raster
from ..session import remember, shared_dir
from ..streaming import ingest
from . import geography as g

c = F.col


def _edges(spark, d):
    """Towns of forty customers: everyone has a street to someone before them in town, every fourth a second one."""
    k = c("c_custkey")
    town = k - k % 40
    first, second = F.greatest(town, k - 1 - k * k % 9), F.greatest(town, k - 2)
    s = g.table(spark, d, "customer")
    own = s.select(k.alias("a"), first.alias("b"), ((k % 9 + 1) / 10.0).alias("t")).unionByName(s.filter(k % 4 == 0).select(k.alias("a"), second.alias("b"), ((k % 7 + 1) / 10.0).alias("t")))
    return graph.undirected(own, "t")


def node_degrees(spark, d):
    return graph.degrees(_edges(spark, d)).select("node", "degree", F.round("centrality", 6).alias("centrality"))


def graph_components(spark, d):
    return graph.components(_edges(spark, d))


def graph_bridges(spark, d):
    return graph.bridges(_edges(spark, d))


def edge_betweenness(spark, d):
    return graph.betweenness(_edges(spark, d)).select("a", "b", F.round("betweenness", 6).alias("betweenness"))


def greedy_clusters(spark, d):
    s = g.sites(spark, d).withColumn("kind", c("k") % 5).withColumn("seq", c("k"))
    return graph.greedy_clusters(s, 3000.0, "kind")


def _dem(spark, d):
    x = g.table(spark, d, "lineitem").groupBy((c("l_partkey") % 40).cast("int").alias("row"), (c("l_suppkey") % 40).cast("int").alias("col"))
    return x.agg(F.round(F.avg("l_quantity"), 6).alias("v"))


def _urban(spark, d):
    return _dem(spark, d).withColumn("v", F.when(c("v") > 27, 1.0).otherwise(0.0))


def raster_slope(spark, d):
    return raster.slope(_dem(spark, d), 10.0).select("row", "col", F.round("slope", 5).alias("slope"))


def raster_flow_direction(spark, d):
    return raster.flow_direction(_dem(spark, d), 0.0)


def raster_flow_accumulation(spark, d):
    return raster.flow_accumulation(raster.flow_direction(_dem(spark, d), 0.0))


def raster_local_minima(spark, d):
    return raster.local_minima(_dem(spark, d), 2)


def raster_neighbour_fraction(spark, d):
    return raster.neighbour_fraction(_urban(spark, d))


def urban_growth_step(spark, d):
    p = _dem(spark, d).select("row", "col", (c("v") / 50).alias("p"))
    return raster.ca_step(_urban(spark, d), p, 60)


def growth_agreement(spark, d):
    u = _urban(spark, d)
    seen = u.withColumn("v", F.when((c("v") == 1) | ((c("row") + c("col")) % 9 == 0), 1.0).otherwise(0.0))
    return raster.agreement(u, urban_growth_step(spark, d), seen).select(F.round("merit", 6).alias("merit"), F.round("kappa", 6).alias("kappa"))


def growth_demand(spark, d):
    """Cells that turn urban a step, over masks of four years in which the bar falls."""
    r = _dem(spark, d)
    return raster.markov_demand(r.select(F.explode(F.array(*map(F.lit, range(4)))).alias("year"), "row", "col", "v").withColumn("v", F.when(c("v") > 29 - c("year"), 1.0).otherwise(0.0)))


def stream_tumbling(spark, d):
    """The tumbling windows of the events, run as a stream to its end."""
    counts = ingest.tumbling(ingest.events_stream(spark, d), "5 minutes")
    return ingest.run_to_end(counts, f"tumbling_{uuid.uuid4().hex}", "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def stream_dedupe(spark, d):
    """First sight of each user and event type, with state kept by the stream."""
    seen = ingest.events_stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return ingest.run_to_end(seen, f"dedupe_{uuid.uuid4().hex}", "append")


def keyed_ingest(spark, d):
    """Events fed week by week: a user's first event of a type, again once two days without one are behind the watermark."""
    path = f"{shared_dir(spark)}/cellscope/keyed-{uuid.uuid4().hex}"
    remember(spark, path)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    week = F.date_trunc("week", "ts")
    for (start,) in sorted(events.filter("ts is not null").select(week).distinct().collect()):
        events.filter(week == F.lit(start)).write.mode("append").parquet(f"{path}/feed")
        feed = spark.readStream.schema(events.schema).parquet(f"{path}/feed")
        ingest.ingest_keyed(feed, ["user_id", "event_type"], "ts", 2 * 86_400_000, "1 hour", ["event_id"], f"{path}/history", f"{path}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{path}/history").select("event_id", "user_id", "event_type", F.unix_millis("ts").alias("ms"))


_E = """(SELECT least(a, b) AS a, greatest(a, b) AS b, min(greatest(0.1::DOUBLE, t)) AS w FROM (
    SELECT c_custkey AS a, greatest(c_custkey - c_custkey % 40, c_custkey - 1 - c_custkey * c_custkey % 9) AS b, (c_custkey % 9 + 1) / 10.0::DOUBLE AS t FROM customer
    UNION ALL SELECT c_custkey, greatest(c_custkey - c_custkey % 40, c_custkey - 2), (c_custkey % 7 + 1) / 10.0::DOUBLE FROM customer WHERE c_custkey % 4 = 0) WHERE a <> b GROUP BY ALL)"""
_BOTH = f"(SELECT a, b FROM {_E} UNION ALL SELECT b, a FROM {_E})"
_DEM = "(SELECT (l_partkey % 40)::INT AS row, (l_suppkey % 40)::INT AS col, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)"
_URBAN = f"(SELECT row, col, (CASE WHEN v > 27 THEN 1.0 ELSE 0.0 END)::DOUBLE AS v FROM {_DEM})"
_DIR = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {2**0.5 if a and b else 1.0!r}::DOUBLE)" for i, (a, b) in enumerate(raster.EIGHT)) + ") k(i, dr, dc, len)"
_FLOW = f"""SELECT o.row, o.col, f.dr, f.dc FROM {_DEM} o LEFT JOIN (SELECT row, col, dr, dc FROM (SELECT x.row, x.col, k.dr, k.dc, row_number() OVER (PARTITION BY x.row, x.col ORDER BY (x.v - y.v) / k.len DESC, k.i) AS n
    FROM {_DEM} x, {_DIR}, {_DEM} y WHERE y.row = x.row + k.dr AND y.col = x.col + k.dc AND (x.v - y.v) / k.len > 0) WHERE n = 1) f ON f.row = o.row AND f.col = o.col"""
_DIFF = lambda a, b, s: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.0::DOUBLE ELSE (coalesce({b}, o) - coalesce({a}, o)) / ((({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT) * {s}) END"
_FRAC = f"(SELECT u.row, u.col, coalesce(sum(n.v), 0.0) / 8 AS frac FROM {_URBAN} u LEFT JOIN {_URBAN} n ON abs(n.row - u.row) <= 1 AND abs(n.col - u.col) <= 1 AND NOT (n.row = u.row AND n.col = u.col) GROUP BY ALL)"
_STEP = f"""(WITH s AS (SELECT f.row, f.col, row_number() OVER (ORDER BY d.v / 50 * (1 + 0.5::DOUBLE * f.frac) DESC, f.row, f.col) AS n FROM {_FRAC} f JOIN {_DEM} d USING (row, col) JOIN {_URBAN} u USING (row, col) WHERE u.v = 0 AND d.v > 0)
    SELECT u.row, u.col, CASE WHEN s.n <= 60 THEN 1.0 ELSE u.v END::DOUBLE AS v FROM {_URBAN} u LEFT JOIN s USING (row, col))"""

QUERIES = {
    "node_degrees": (node_degrees, f"SELECT a AS node, count(*) AS degree, round(count(*) / (count(*) OVER () - 1)::DOUBLE, 6) AS centrality FROM {_BOTH} GROUP BY a"),
    "graph_components": (graph_components, f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_BOTH}), r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
        SELECT node, min(label) AS component FROM r GROUP BY node"""),
    "graph_bridges": (graph_bridges, f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_E}), t AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT a AS ea, b AS eb, a AS node FROM e UNION SELECT r.ea, r.eb, t.b FROM r JOIN t ON t.a = r.node WHERE NOT (least(t.a, t.b) = r.ea AND greatest(t.a, t.b) = r.eb))
        SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ea = e.a AND r.eb = e.b AND r.node = e.b)"""),
    "edge_betweenness": (edge_betweenness, None),
    "greedy_clusters": (greedy_clusters, None),
    "raster_slope": (raster_slope, f"""SELECT row, col, round(degrees(atan(sqrt(pow({_DIFF('n', 's', 10)}, 2) + pow({_DIFF('w', 'e', 10)}, 2)))), 5) AS slope FROM (SELECT x.row, x.col, x.v AS o, n.v AS n, s.v AS s, w.v AS w, e.v AS e FROM {_DEM} x
        LEFT JOIN {_DEM} n ON n.row = x.row - 1 AND n.col = x.col LEFT JOIN {_DEM} s ON s.row = x.row + 1 AND s.col = x.col LEFT JOIN {_DEM} w ON w.row = x.row AND w.col = x.col - 1 LEFT JOIN {_DEM} e ON e.row = x.row AND e.col = x.col + 1)"""),
    "raster_flow_direction": (raster_flow_direction, _FLOW),
    "raster_flow_accumulation": (raster_flow_accumulation, f"""WITH RECURSIVE f AS MATERIALIZED ({_FLOW}), w AS (SELECT row AS r0, col AS c0, row, col FROM f UNION ALL SELECT w.r0, w.c0, f.row + f.dr, f.col + f.dc FROM w JOIN f ON f.row = w.row AND f.col = w.col WHERE f.dr IS NOT NULL)
        SELECT row, col, count(*) AS cells FROM w GROUP BY ALL"""),
    "raster_local_minima": (raster_local_minima, f"SELECT x.row, x.col FROM {_DEM} x JOIN {_DEM} y ON abs(x.row - y.row) <= 2 AND abs(x.col - y.col) <= 2 AND NOT (x.row = y.row AND x.col = y.col) GROUP BY x.row, x.col, x.v HAVING x.v < min(y.v)"),
    "raster_neighbour_fraction": (raster_neighbour_fraction, f"SELECT * FROM {_FRAC}"),
    "urban_growth_step": (urban_growth_step, f"SELECT * FROM {_STEP}"),
    "growth_agreement": (growth_agreement, f"""WITH j AS (SELECT u.v AS b, s.v AS s, CASE WHEN u.v = 1 OR (u.row + u.col) % 9 = 0 THEN 1.0 ELSE 0.0 END AS o FROM {_URBAN} u JOIN {_STEP} s USING (row, col)),
        a AS (SELECT count(*) FILTER (b = 0 AND s = 1 AND o = 1)::DOUBLE AS h, count(*) FILTER (b = 0 AND (s = 1 OR o = 1)) AS a, count(*) FILTER (s = o) / count(*)::DOUBLE AS p, (sum(s) / count(*))::DOUBLE AS s1, (sum(o) / count(*))::DOUBLE AS o1 FROM j)
        SELECT round(h / a, 6) AS merit, round((p - (s1 * o1 + (1 - s1) * (1 - o1))) / (1 - (s1 * o1 + (1 - s1) * (1 - o1))), 6) AS kappa FROM a"""),
    "growth_demand": (growth_demand, f"""WITH y AS (SELECT y, row, col, v > 29 - y AS on_now, v > 30 - y AS on_before FROM {_DEM}, range(4) t(y))
        SELECT round_even(count(*) FILTER (y > 0 AND on_now AND NOT on_before) / 3.0::DOUBLE, 0)::BIGINT AS demand FROM y"""),
    "stream_tumbling": (stream_tumbling, "SELECT floor(epoch(ts))::BIGINT // 300 * 300 AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "keyed_ingest": (keyed_ingest, """WITH k AS (SELECT user_id, event_type, date_trunc('week', ts) AS wk, epoch_us(max(ts)) // 1000 AS last, min({'ts': ts, 'id': event_id}) AS f FROM events WHERE ts IS NOT NULL GROUP BY ALL),
        w AS (SELECT wk, max(max(last)) OVER (ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS mark FROM k GROUP BY wk),
        s AS (SELECT *, lag(last) OVER (PARTITION BY user_id, event_type ORDER BY wk) AS seen FROM k JOIN w USING (wk))
        SELECT f.id AS event_id, user_id, event_type, epoch_us(f.ts) // 1000 AS ms FROM s WHERE seen IS NULL OR seen + 172800000 <= mark"""),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
}
