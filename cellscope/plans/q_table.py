"""Queries of aggregates, order statistics, sequences, set operations and time windows, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import num
from ..operators import tables
from . import geography as g

t = g.table


def upper_median_stats(spark, d):
    s = tables.positional_stats(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return s.select(F.col("l_returnflag").alias("grp"), "n", "low", "high", F.round("mean", 4).alias("mean"), "upper_median", "p90", "p95", F.round("variation", 6).alias("variation"))


def nearest_rank_p95(spark, d):
    return tables.nearest_rank(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 0.95).select("l_returnflag", F.col("v").alias("p95"))


def linear_percentile(spark, d):
    shares = {"p10": 0.1, "p90": 0.9, "p98": 0.98}
    p = tables.linear_percentiles(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", shares)
    return p.select("l_returnflag", *[F.round(n, 4).alias(n) for n in shares])


def grouping_sets_trips(spark, d):
    x = t(spark, d, "lineitem")
    r = x.rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_duration"), F.round(F.sum("l_extendedprice"), 2).alias("length"), F.grouping("l_returnflag").cast("int").alias("total"))
    return r


def headway_median(spark, d):
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    gaps = e.withColumn("gap", (F.col("s") - F.lag("s").over(w)) / 60.0).filter("gap > 0")
    return gaps.groupBy("user_id").agg(F.round(F.percentile("gap", F.lit(0.5)), 4).alias("headway_min"))


def distinct_trips(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("routes"), F.count("*").alias("stops"))


def entropy_diversity(spark, d):
    c = t(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    a = c.groupBy("l_suppkey").agg(F.collect_list("n").alias("c"))
    h = num.entropy(F.col("c"))
    k = F.greatest(F.lit(2), F.size("c")).cast("double")
    return a.select("l_suppkey", F.round(h / F.ln(F.lit(2.0)), 6).alias("bits"), F.round(h / F.ln(k) * 100, 4).alias("evenness"))


def largest_remainder(spark, d):
    w = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("w"))
    return tables.largest_remainder(w, "c_nationkey", "w", 100000)


def class_share_weighted(spark, d):
    """Share of each class in an area and the area's weighted figure, from a constant lookup."""
    cn = F.element_at(F.array(*[F.lit(float(v)) for v in (98, 85, 77, 70, 61, 55, 80, 91)]), (F.col("cls") + 1).cast("int"))
    x = t(spark, d, "orders").select((F.col("o_orderkey") % 8).alias("cls"), (F.col("o_custkey") % 20).alias("area"))
    c = x.groupBy("area", "cls").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("area")))
    return c.groupBy("area").agg(F.round(F.sum(F.col("share") * cn), 6).alias("curve_number"), F.round(F.max("share"), 6).alias("top_share"), F.max_by("cls", F.struct("n", -F.col("cls"))).alias("top_class"))


def ols_trend(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.year("o_orderdate").alias("y"), "o_totalprice")
    s = tables.series(o, "k", "y", F.sum("o_totalprice"))
    return tables.trends(s, "k").select("k", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


def yoy_change(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.year("o_orderdate").alias("y"), "o_totalprice")
    s = tables.series(o, "k", "y", F.sum("o_totalprice"))
    last, prev = F.element_at("series", -1), F.element_at("series", -2)
    return s.filter(F.size("series") >= 2).select("k", F.round((last - prev) / prev * 100, 6).alias("yoy_pct"))


def last_valid(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return e.select("event_id", F.last("v", ignorenulls=True).over(w).alias("last_valid"))


def ratio_to_first(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    x = t(spark, d, "lineitem").withColumn("ratio", F.col("l_quantity") / F.first("l_quantity").over(w))
    return x.groupBy("l_orderkey").agg(F.round(F.max("ratio"), 6).alias("peak"), F.max_by("l_linenumber", F.struct("ratio", -F.col("l_linenumber"))).alias("peak_line"))


def minmax_normalise(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.lit(7.0).alias("b"))
    return tables.min_max(x, ["a", "b"], 0.5).select("p_partkey", F.round("a", 6).alias("a"), "b")


def minmax_zero(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.lit(7.0).alias("b"))
    return tables.min_max(x, ["a", "b"], 0.0).select("p_partkey", F.round("a", 6).alias("a"), "b")


def ratio_to_p95(spark, d):
    x = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"), F.lit("all").alias("g"))
    p = tables.nearest_rank(x, "g", "v", 0.95).select(F.col("v").alias("p95"))
    return x.join(F.broadcast(p)).select("s_suppkey", F.round(F.col("v") / F.col("p95"), 6).alias("ratio"))


def topn_per_key(spark, d):
    return tables.top_per_key(t(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey", 3).select("s_nationkey", "s_suppkey", "rank")


def full_outer_compare(spark, d):
    a = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    b = t(spark, d, "lineitem").groupBy((F.year("l_shipdate") + 1).alias("y")).agg(F.count("*").alias("n"))
    return tables.compare_counts(a, b, "y")


def seen_anti_join(spark, d):
    """Events of users without a large order."""
    return tables.unseen(t(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey")), t(spark, d, "orders").filter("o_totalprice > 400000"), "o_custkey")


def exists_semi_join(spark, d):
    big = t(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


def upsert_by_key(spark, d):
    o = t(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.lit("old").alias("state"))
    new = o.filter("s_suppkey % 7 = 0").withColumn("state", F.lit("new"))
    return tables.upsert(o, new, "s_suppkey")


def set_except_intersect(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("n")), t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n"))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("customers only")))


def dedupe_first(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    return tables.first_by(e, ["user_id", "event_type"], F.col("event_id"))


def merge_reissue(spark, d):
    """Trips of two sets in order of departure with new consecutive ids."""
    o = t(spark, d, "orders")
    both = o.filter("o_orderkey % 2 = 0").select(F.lit("a").alias("s"), "o_orderkey", "o_orderdate").unionByName(o.filter("o_orderkey % 2 = 1").select(F.lit("b").alias("s"), "o_orderkey", "o_orderdate"))
    return tables.sequential_ids(both, ["o_orderdate", "o_orderkey"]).select("s", "o_orderkey", "id")


def shared_endpoint(spark, d):
    """Lines that share a start with another line, and the widest neighbour's class."""
    r = g.roads(spark, d).select("k", "class", F.concat_ws(",", F.round("lat1", 5), F.round("lon1", 5)).alias("node"))
    w = r.groupBy("node").agg(F.count("*").alias("n"), F.max(F.struct("class", "k")).alias("a"), F.min("class").alias("low"))
    return r.join(w, "node").filter("n > 1").select("k", (F.col("n") - 1).alias("neighbours"), F.col("a.class").alias("widest"), "low")


def node_degree(spark, d):
    r = g.roads(spark, d).select(F.explode(F.array(F.struct(F.round("lat1", 5).alias("y"), F.round("lon1", 5).alias("x")), F.struct(F.round("lat2", 5).alias("y"), F.round("lon2", 5).alias("x")))).alias("p"))
    return r.groupBy(F.col("p.y").alias("lat"), F.col("p.x").alias("lon")).agg(F.count("*").alias("degree")).filter("degree >= 4")


def scenario_summary(spark, d):
    x = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * 0.9 + F.when(F.col("l_linenumber") % 2 == 0, 6).otherwise(0)).alias("after"), F.col("l_quantity").alias("before"))
    delta = F.col("after") - F.col("before")
    return x.groupBy("l_returnflag").agg(F.count_if(delta > 0).alias("gained"), F.count_if(delta < 0).alias("lost"), F.round(F.avg(delta), 6).alias("mean_delta"))


def worst_by_rank(spark, d):
    rank = F.element_at(F.create_map(*[x for k, v in (("A", 1), ("N", 2), ("R", 3)) for x in (F.lit(k), F.lit(v))]), F.col("l_returnflag"))
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_returnflag", rank).alias("worst"), F.count("*").alias("n"))


def area_aggregate(spark, d):
    x = t(spark, d, "part").select((F.col("p_partkey") % 100).alias("cell"), "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    one = tables.first_by(x, ["cell"], F.col("p_partkey"))
    long = one.unpivot("cell", ["size", "price"], "score", "v")
    return long.groupBy("score").agg(F.count_distinct("cell").alias("cells"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def tumbling_5min(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def sliding_windows(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.unix_seconds("w.start").alias("start"), "n")


def session_windows(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def cosine_topk(spark, d):
    """The five rows most like vector 0 by cosine."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.filter("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(num.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))
    return s.orderBy(F.desc("sim"), "vec_id").limit(5)


_LI = "lineitem"
_YEAR = "SELECT k, list(v ORDER BY y) AS s FROM (SELECT o_custkey % 50 AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY k"
_EV = "(SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)"
_RANKED = "(SELECT l_returnflag AS grp, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)"

QUERIES = {
    "upper_median_stats": (upper_median_stats, f"""SELECT grp, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, max(v) FILTER (i = n // 2) AS upper_median, max(v) FILTER (i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90,
        max(v) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, round(stddev_samp(v) / avg(v), 6) AS variation FROM {_RANKED} GROUP BY grp"""),
    "nearest_rank_p95": (nearest_rank_p95, f"SELECT grp AS l_returnflag, v AS p95 FROM {_RANKED} WHERE i = round_even(0.95::DOUBLE * (n - 1), 0)"),
    "linear_percentile": (linear_percentile, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.98), 4) AS p98 FROM lineitem GROUP BY 1"),
    "grouping_sets_trips": (grouping_sets_trips, "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_duration, round(sum(l_extendedprice), 2) AS length, grouping(l_returnflag)::INT AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)"),
    "headway_median": (headway_median, f"SELECT user_id, round(quantile_cont(gap, 0.5), 4) AS headway_min FROM (SELECT user_id, (s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id)) / 60.0::DOUBLE AS gap FROM {_EV}) WHERE gap > 0 GROUP BY user_id"),
    "distinct_trips": (distinct_trips, "SELECT user_id, count(DISTINCT event_type) AS routes, count(*) AS stops FROM events GROUP BY user_id"),
    "entropy_diversity": (entropy_diversity, """SELECT l_suppkey, round(h / ln(2.0::DOUBLE), 6) AS bits, round(h / ln(greatest(2, k)) * 100, 4) AS evenness FROM (SELECT l_suppkey, count(*) AS k, -sum(n / s * ln(n / s)) AS h FROM
        (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY l_suppkey)::DOUBLE AS s FROM lineitem GROUP BY l_suppkey, l_linenumber) GROUP BY l_suppkey)"""),
    "largest_remainder": (largest_remainder, """WITH w AS (SELECT c_nationkey, count(*)::DOUBLE AS w FROM customer GROUP BY 1), r AS (SELECT c_nationkey, w / sum(w) OVER () * 100000 AS raw FROM w), p AS (SELECT c_nationkey, floor(raw)::BIGINT AS base, raw - floor(raw) AS frac FROM r)
        SELECT c_nationkey, base + (row_number() OVER (ORDER BY frac DESC, c_nationkey) <= 100000 - sum(base) OVER ())::BIGINT AS share FROM p"""),
    "class_share_weighted": (class_share_weighted, """WITH c AS (SELECT o_custkey % 20 AS area, o_orderkey % 8 AS cls, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY area)::DOUBLE AS share FROM c)
        SELECT area, round(sum(share * [98, 85, 77, 70, 61, 55, 80, 91][cls + 1]), 6) AS curve_number, round(max(share), 6) AS top_share, arg_max(cls, {'n': n, 'c': -cls}) AS top_class FROM s GROUP BY area"""),
    "ols_trend": (ols_trend, f"SELECT k, round(regr_slope(v, i), 2) AS slope, round(regr_intercept(v, i), 2) AS intercept, round(regr_r2(v, i), 6) AS r2 FROM (SELECT k, unnest(s) AS v, unnest(range(len(s))) AS i FROM ({_YEAR})) GROUP BY k"),
    "yoy_change": (yoy_change, f"SELECT k, round((s[-1] - s[-2]) / s[-2] * 100, 6) AS yoy_pct FROM ({_YEAR}) WHERE len(s) >= 2"),
    "last_valid": (last_valid, "SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_valid FROM events"),
    "ratio_to_first": (ratio_to_first, """SELECT l_orderkey, round(max(ratio), 6) AS peak, arg_max(l_linenumber, {'r': ratio, 'l': -l_linenumber}) AS peak_line FROM
        (SELECT l_orderkey, l_linenumber, l_quantity / first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS ratio FROM lineitem) GROUP BY l_orderkey"""),
    "minmax_normalise": (minmax_normalise, "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS a, 0.5::DOUBLE AS b FROM part"),
    "minmax_zero": (minmax_zero, "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS a, 0.0::DOUBLE AS b FROM part"),
    "ratio_to_p95": (ratio_to_p95, """WITH r AS (SELECT s_suppkey, s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) - 1 AS i, count(*) OVER () AS n FROM supplier)
        SELECT s_suppkey, round(v / (SELECT v FROM r WHERE i = round_even(0.95::DOUBLE * (n - 1), 0)), 6) AS ratio FROM r"""),
    "topn_per_key": (topn_per_key, "SELECT s_nationkey, s_suppkey, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3"),
    "full_outer_compare": (full_outer_compare, """SELECT y::INT AS y, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) a
        FULL OUTER JOIN (SELECT year(l_shipdate) + 1 AS y, count(*) AS n FROM lineitem GROUP BY 1) b USING (y)"""),
    "seen_anti_join": (seen_anti_join, "SELECT event_id, user_id AS o_custkey FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_totalprice > 400000)"),
    "exists_semi_join": (exists_semi_join, "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)"),
    "upsert_by_key": (upsert_by_key, "SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'new' ELSE 'old' END AS state FROM supplier"),
    "set_except_intersect": (set_except_intersect, """SELECT n, 'both' AS part FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
        UNION ALL SELECT n, 'customers only' FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"""),
    "dedupe_first": (dedupe_first, "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type"),
    "merge_reissue": (merge_reissue, "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS s, o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS id FROM orders"),
    "shared_endpoint": (shared_endpoint, f"""WITH r AS (SELECT k, class, round(lat1, 5) AS y, round(lon1, 5) AS x FROM {g.ROAD}), n AS (SELECT y, x, count(*) AS n, max(class) AS widest, min(class) AS low FROM r GROUP BY ALL)
        SELECT k, n - 1 AS neighbours, widest, low FROM r JOIN n USING (y, x) WHERE n > 1"""),
    "node_degree": (node_degree, f"SELECT lat, lon, count(*) AS degree FROM (SELECT round(lat1, 5) AS lat, round(lon1, 5) AS lon FROM {g.ROAD} UNION ALL SELECT round(lat2, 5), round(lon2, 5) FROM {g.ROAD}) GROUP BY ALL HAVING count(*) >= 4"),
    "scenario_summary": (scenario_summary, """SELECT l_returnflag, count(*) FILTER (d > 0) AS gained, count(*) FILTER (d < 0) AS lost, round(avg(d), 6) AS mean_delta FROM
        (SELECT l_returnflag, l_quantity * 0.9::DOUBLE + CASE WHEN l_linenumber % 2 = 0 THEN 6 ELSE 0 END - l_quantity AS d FROM lineitem) GROUP BY 1"""),
    "worst_by_rank": (worst_by_rank, "SELECT l_suppkey, max(l_returnflag) AS worst, count(*) AS n FROM lineitem GROUP BY 1"),
    "area_aggregate": (area_aggregate, """WITH one AS (SELECT p_partkey % 100 AS cell, arg_min(p_size, p_partkey)::DOUBLE AS size, arg_min(p_retailprice, p_partkey) AS price FROM part GROUP BY 1), l AS (UNPIVOT one ON size, price INTO NAME score VALUE v)
        SELECT score, count(DISTINCT cell) AS cells, round(avg(v), 4) AS mean, min(v) AS low, max(v) AS high FROM l GROUP BY 1"""),
    "tumbling_5min": (tumbling_5min, f"SELECT s // 300 * 300 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_EV} GROUP BY ALL"),
    "sliding_windows": (sliding_windows, f"SELECT start, count(*) AS n FROM (SELECT unnest([s // 300 * 300, s // 300 * 300 - 300]) AS start FROM {_EV}) GROUP BY start"),
    "session_windows": (session_windows, """SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM
        (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true))::INT AS new FROM events)) GROUP BY user_id, sid"""),
    "cosine_topk": (cosine_topk, """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS sim FROM embeddings WHERE vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 5"""),
}
