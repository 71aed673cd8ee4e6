"""Queries of text, feeds, rules, exports and data quality, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import quality
from . import geography as g

c = F.col


def _docs(spark, d):
    return g.table(spark, d, "documents")


def alert_infer(spark, d):
    return _docs(spark, d).select("doc_id", x.first_match(c("text"), x.SEVERITY, "Minor").alias("severity"), x.first_match(c("text"), x.CATEGORY, "Other").alias("category"))


def alert_filter(spark, d):
    """Severity at or above a threshold (unknown: 0), and a substring in either of two columns."""
    level = F.coalesce(F.try_element_at(F.create_map(*[v for k, n in (("error", 4), ("purchase", 3), ("click", 2), ("view", 1)) for v in (F.lit(k), F.lit(n))]), c("event_type")), F.lit(0))
    e = g.table(spark, d, "events")
    return e.filter((level >= 3) & (F.lower("event_type").contains("err") | F.lower("props").contains("a"))).select("event_id", "event_type")


def html_strip(spark, d):
    return g.table(spark, d, "pages").select("page_id", F.md5(x.strip_tags(c("html"))).alias("digest"), F.length(x.strip_tags(c("html"))).alias("n"))


def json_extract(spark, d):
    e = g.table(spark, d, "events").select("event_id", F.concat(F.lit("answer: "), "props", F.lit(" end")).alias("s"))
    return e.select("event_id", x.json_object(c("s")).alias("json"))


def intent_route(spark, d):
    return g.table(spark, d, "conversations").select("conv_id", "turn", x.first_match(c("text"), x.ROUTES, "best_residential").alias("query"))


_WORDS = ("quiet green area for a family", "cheap flat near metro and school", "nightlife and food", "flood safe property investment", "walkable heritage tourism", "it hub startup", "nothing here")


def _questions(spark, d):
    q = F.array(*map(F.lit, _WORDS))
    k = c("c_custkey")
    text = F.concat_ws(" ", F.element_at(q, (k % 7 + 1).cast("int")), F.element_at(q, (k % 5 + 1).cast("int")))
    return g.table(spark, d, "customer").select(k.alias("k"), text.alias("q"))


def lexicon_weights(spark, d):
    return g.spread(_questions(spark, d), "k").select("k", F.explode(x.lexicon_weights(c("q"))).alias("e")).select("k", c("e.score").alias("score_id"), c("e.w").alias("w"))


def question_normalise(spark, d):
    return g.table(spark, d, "conversations").select("conv_id", "turn", x.normal_question(F.concat(F.lit("  "), c("text"), F.lit(" ?! "))).alias("key"))


def csv_guard(spark, d):
    s = F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "x", " -", "@", ""))), (c("p_partkey") % 6 + 1).cast("int")), c("p_partkey").cast("string"))
    return g.table(spark, d, "part").select("p_partkey", x.csv_safe(s).alias("cell"))


def time_and_units(spark, d):
    k = c("o_orderkey")
    hms = F.concat_ws(":", (k % 30).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k * 7 % 60).cast("string"), 2, "0"))
    width = F.concat((k % 97 / 10).cast("string"), F.lit(" m"))
    o = g.table(spark, d, "orders")
    return o.select("o_orderkey", F.round(x.minutes_of(hms), 6).alias("minutes"), x.number_with_unit(width).alias("width"), x.distance_label((k * 37 % 4000).cast("double")).alias("label"), x.slug(c("o_orderpriority")).alias("slug"))


def staleness(spark, d):
    s = x.staleness(F.unix_seconds(c("ts").cast("timestamp")), F.lit(1706750000).cast("long"))
    return g.table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.age_min", "s.stale", "s.label")


def training_shapes(spark, d):
    """Instruction pairs: each user turn with the answer that follows it, in the three usual shapes."""
    t = g.table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "role", "text")
    a = t.select("conv_id", (c("turn") - 1).alias("turn"), c("role").alias("r2"), c("text").alias("answer"))
    p = t.filter("role = 'user'").join(a.filter("r2 = 'assistant'"), ["conv_id", "turn"])
    return p.select("conv_id", "turn", c("text").alias("instruction"), F.lit("").alias("input"), c("answer").alias("output"), F.concat_ws("|", F.lit("human"), "text", F.lit("gpt"), "answer").alias("shared"))


def quality_rules(spark, d):
    e = g.table(spark, d, "events")
    rules = [
        quality.required("user_id"), quality.one_of("event_type", ["click", "view", "purchase"]), quality.in_range("value", 1, 150), quality.matches("props", r"\{.*\}"),
    ]
    return quality.violations(e, "event_id", rules)


def quality_unique(spark, d):
    return quality.repeats(g.table(spark, d, "events").select("event_id", c("user_id").alias("key")), "key", "event_id")


def quality_report(spark, d):
    return quality_rules(spark, d).groupBy("column", "rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def export_geojson(spark, d):
    """Cells as GeoJSON features with a closed ring."""
    s = g.pois(spark, d)
    p = lambda dy, dx: F.array((c("lon") + dx), (c("lat") + dy))
    ring = F.array(p(0.0, 0.0), p(0.0, 0.25), p(0.25, 0.25), p(0.25, 0.0), p(0.0, 0.0))
    s = s.select("k", (F.floor(c("lat") * 4) / 4).alias("lat"), (F.floor(c("lon") * 4) / 4).alias("lon"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return s.select("k", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(c("k").alias("id")).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def export_matrix(spark, d):
    """Comparison matrix: metrics as rows, regions as columns."""
    n = g.table(spark, d, "customer").groupBy((c("c_nationkey") % 4).alias("r")).agg(F.count("*").cast("double").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    long = n.unpivot("r", ["customers", "balance"], "metric", "v")
    wide = long.groupBy("metric").pivot("r", [0, 1, 2, 3]).agg(F.first("v"))
    return wide.select("metric", *[c(str(i)).alias(f"r{i}") for i in range(4)])


_ROUTE = lambda col, groups, other: "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '{p}') THEN '{k}'" for k, p in groups) + f" ELSE '{other}' END"


def _lexicon_sql():
    """Each concept that occurs adds its weights in order; no question here reaches the limits twice."""
    rows = []
    for i, (_, p, w) in enumerate(x.LEXICON):
        rows += [(i, p.replace("(?:", "("), s, v) for s, v in w.items()]
    values = ", ".join(f"({i}, '{p}', '{s}', {v}::DOUBLE)" for i, p, s, v in rows)
    words = ", ".join(f"'{w}'" for w in _WORDS)
    return f"""WITH q AS (SELECT c_custkey AS k, ([{words}])[c_custkey % 7 + 1] || ' ' || ([{words}])[c_custkey % 5 + 1] AS q FROM customer),
      m AS (SELECT k, l.s AS score_id, list(l.w ORDER BY l.i) AS ws FROM q JOIN (VALUES {values}) l(i, p, s, w) ON regexp_matches(q.q, l.p) GROUP BY ALL)
      SELECT k, score_id, round(list_reduce(list_transform(ws, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v))), lambda a, b: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a + b))), 6) AS w FROM m"""


_STRIP = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s]+', ' ', 'g'), ' ')"
_BAD = r"""SELECT event_id AS id, 'event_type' AS "column", 'one_of' AS rule FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL
    SELECT event_id, 'value', 'in_range' FROM events WHERE value < 1 OR value > 150 UNION ALL SELECT event_id, 'user_id', 'required' FROM events WHERE user_id IS NULL UNION ALL
    SELECT event_id, 'props', 'matches' FROM events WHERE NOT regexp_matches(props, '\{.*\}')"""

QUERIES = {
    "alert_infer": (alert_infer, f"SELECT doc_id, {_ROUTE('text', x.SEVERITY, 'Minor')} AS severity, {_ROUTE('text', x.CATEGORY, 'Other')} AS category FROM documents"),
    "alert_filter": (alert_filter, "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND (contains(event_type, 'err') OR contains(lower(props), 'a'))"),
    "html_strip": (html_strip, f"SELECT page_id, md5({_STRIP}) AS digest, length({_STRIP})::INT AS n FROM pages"),
    "json_extract": (json_extract, r"SELECT event_id, CASE WHEN json_valid(regexp_extract(props, '(?s)\{.*\}')) THEN regexp_extract(props, '(?s)\{.*\}') END AS json FROM events"),
    "intent_route": (intent_route, f"SELECT conv_id, turn, {_ROUTE('text', x.ROUTES, 'best_residential')} AS query FROM conversations"),
    "lexicon_weights": (lexicon_weights, _lexicon_sql()),
    "question_normalise": (question_normalise, r"SELECT conv_id, turn, regexp_replace(regexp_replace(trim(lower('  ' || text || ' ?! '), ' '), '\s+', ' ', 'g'), '[?.!,;]+$', '') AS key FROM conversations"),
    "csv_guard": (csv_guard, r"SELECT p_partkey, CASE WHEN regexp_matches(s, '^\s*[=+\-@]') THEN '''' || s ELSE s END AS cell FROM (SELECT p_partkey, (['=', '+', 'x', ' -', '@', ''])[p_partkey % 6 + 1] || p_partkey AS s FROM part)"),
    "time_and_units": (time_and_units, """SELECT o_orderkey, round(o_orderkey % 30 * 60 + o_orderkey % 60 + (o_orderkey * 7 % 60) / 60.0::DOUBLE, 6) AS minutes, (o_orderkey % 97) / 10.0::DOUBLE AS width,
        CASE WHEN o_orderkey * 37 % 4000 < 1000 THEN (o_orderkey * 37 % 4000)::VARCHAR || ' m' ELSE round((o_orderkey * 37 % 4000) / 1000.0::DOUBLE, 1)::VARCHAR || ' km' END AS label, {slug} AS slug FROM orders"""),
    "staleness": (staleness, """SELECT event_id, age AS age_min, age > 120 AS stale, CASE WHEN age < 60 THEN age || ' min' WHEN age < 1440 THEN age // 60 || ' h' ELSE age // 1440 || ' d' END AS label
        FROM (SELECT event_id, greatest(0, floor((1706750000 - floor(epoch(ts))) / 60))::BIGINT AS age FROM events)"""),
    "training_shapes": (training_shapes, """SELECT u.conv_id, u.turn, u.text AS instruction, '' AS input, a.text AS output, 'human|' || u.text || '|gpt|' || a.text AS shared
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL"""),
    "quality_rules": (quality_rules, _BAD),
    "quality_unique": (quality_unique, "SELECT event_id AS id, user_id AS key, min(event_id) OVER (PARTITION BY user_id) AS first_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1"),
    "quality_report": (quality_report, f'SELECT "column", rule, count(*) AS n, min(id) AS first_id FROM ({_BAD}) GROUP BY ALL'),
    "export_matrix": (export_matrix, "SELECT metric, " + ", ".join(f"max(v) FILTER (r = {i}) AS r{i}" for i in range(4)) + """ FROM (UNPIVOT (SELECT c_nationkey % 4 AS r, count(*)::DOUBLE AS customers, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1)
        ON customers, balance INTO NAME metric VALUE v) GROUP BY metric"""),
}
_RING = ", ".join(f"'[' || (x + {dx})::VARCHAR || ',' || (y + {dy})::VARCHAR || ']'" for dy, dx in ((0, 0), (0, 0.25), (0.25, 0.25), (0.25, 0), (0, 0)))
QUERIES["export_geojson"] = (
    export_geojson,
    f"""SELECT k, '{{"type":"Feature","properties":{{"id":' || k || '}},"geometry":{{"type":"Polygon","coordinates":[[' || array_to_string([{_RING}], ',') || ']]}}}}' AS feature
    FROM (SELECT k, floor(lat * 4) / 4 AS y, floor(lon * 4) / 4 AS x FROM {g.POI})""",
)
QUERIES["time_and_units"] = (time_and_units, QUERIES["time_and_units"][1].replace("{slug}", "trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_')"))
