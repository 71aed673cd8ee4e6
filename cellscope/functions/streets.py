"""Widths, crowds, utilities and directives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import band, clamp

# Carriageway width in metres by class.
WIDTHS = {
    "trunk": 12.0, "trunk_link": 8.0, "primary": 9.0, "primary_link": 6.0, "secondary": 7.0, "secondary_link": 5.0,
    "tertiary": 5.5, "tertiary_link": 4.0, "residential": 5.0, "unclassified": 4.0, "living_street": 4.0, "service": 3.0,
    "track": 3.0, "footway": 1.5, "cycleway": 2.0, "path": 1.5, "pedestrian": 3.0, "steps": 1.5,
}
# People for each officer by situation.
FORCE = {"peaceful": 50, "tense": 15, "riot": 6}
# Patterns of question contexts, in the order they are tried.
CONTEXTS = (
    ("planning", r"what should be built|how to improve|development recommend|planning recommend|what.{0,20}(need|lack|missing)|improve this area|gap analysis|urban intervention|what.{0,10}develop|master plan|urdpfi|zoning suggest"),
    ("environment", r"air quality|pollution|aqi|pm2\.?5|pm10|weather|temperature|climate|flood|waterlog|solar|energy|panel|uv|radiation"),
    ("building", r"building|density|fsi|floor area|morpholog|height|lcz|urban form|footprint"),
    ("infrastructure", r"transit|bus|metro|sensor|iudx|smart city|hospital|school|health|post office|infrastructure"),
    ("investment", r"invest|real estate|property|land|affordable|luxury|redevelop|warehouse"),
)
# The wire format of directive lines, "[ACTION] type key:value ...", values bare or in quotes.
DIRECTIVE = r"(?m)^[ \t]*\[ACTION\][ \t]+([a-zA-Z_]+)[ \t]*([^\n]*)$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PARAMETER = r"""([a-zA-Z_]+)\s*:\s*("[^"]*"|'[^']*'|\S+)"""


def _table(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def metres(tag: Column) -> Column:
    """The number of a tag such as "5 m"; null for anything else."""
    return F.trim(F.regexp_replace(F.trim(tag), "m+$", "")).try_cast("double")


def width(width_tag: Column, lanes_tag: Column, road_class: Column) -> Column:
    """The tagged width, else lanes at 3.5 m, else the class's width, else 4 m."""
    own, lanes = metres(width_tag), metres(lanes_tag)
    return F.coalesce(F.when(own > 0, own), F.when(lanes > 0, lanes * 3.5), F.try_element_at(_table(WIDTHS), road_class), F.lit(4.0))


def crowd_radius(people: Column) -> Column:
    return band(people, [(500, 300.0), (1000, 500.0), (2000, 800.0), (5000, 1200.0)], 1800.0)


def force(people: Column, situation: Column) -> Column:
    """``struct(total, officers, reserves, commanders)``; unknown situations count as peaceful."""
    ratio = F.coalesce(F.try_element_at(_table(FORCE), situation), F.lit(FORCE["peaceful"]))
    total = F.ceil(people / ratio)
    part = lambda share: F.ceil(total * F.lit(share))
    return F.struct(total.alias("total"), part(0.6).alias("officers"), part(0.25).alias("reserves"), part(0.15).alias("commanders"))


def context(question: Column) -> Column:
    q, out = F.lower(question), None
    for name, pattern in CONTEXTS:
        out = F.when(q.rlike(pattern), name) if out is None else out.when(q.rlike(pattern), name)
    return out.otherwise("general")


def directives(text: Column) -> Column:
    """``array<struct<type, params, numbers>>`` of a reply's directive lines; values lose their quotes, the last of a name counts.

    ``numbers`` has the values that read as numbers, as such.
    """
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(DIRECTIVE))
    clean = lambda v: F.regexp_replace(v, "^['\"]|['\"]$", "")

    def one(line: Column) -> Column:
        rest = F.regexp_extract(line, DIRECTIVE, 2)
        names, values = F.regexp_extract_all(rest, F.lit(PARAMETER), 1), F.regexp_extract_all(rest, F.lit(PARAMETER), 2)
        pairs = F.arrays_zip(names.alias("k"), F.transform(values, clean).alias("v"))
        last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))
        numeric = F.transform(F.filter(last, lambda p: F.trim(p["v"]).rlike(NUMBER)), lambda p: F.struct(p["k"].alias("k"), F.trim(p["v"]).cast("double").alias("v")))
        return F.struct(F.lower(F.regexp_extract(line, DIRECTIVE, 1)).alias("type"), F.map_from_entries(last).alias("params"), F.map_from_entries(numeric).alias("numbers"))

    return F.transform(lines, one)


def without_directives(text: Column) -> Column:
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(DIRECTIVE)), "\n")
    return F.trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def electricity(overhead: Column, cables: Column, substations: Column, transformers: Column) -> Column:
    return (
        F.when((cables > 0) & (overhead > 0), "mixed").when(cables > 0, "underground")
        .when((overhead > 0) | (substations > 0) | (transformers > 0), "overhead").otherwise("unknown")
    )


def noise(quietness: Column) -> Column:
    """``struct(value, status)`` of the complement of quietness; null for null."""
    level = clamp(F.lit(100.0) - quietness, 0.0, 100.0)
    return F.when(quietness.isNotNull(), F.struct(F.floor(level + 0.5).alias("value"), band(level, [(25, "good"), (50, "moderate"), (70, "elevated")], "high").alias("status")))


def walking_radius(minutes: Column) -> Column:
    return minutes * 80.0 / 1.3


def walking_seconds(metres_away: Column) -> Column:
    return metres_away * 1.3 / 1.4


def circle(lat: Column, lon: Column, radius_m: Column, steps: int = 72) -> Column:
    """A closed ring ``array<struct<lat, lon>>`` around a point, starting in the north."""
    far = F.degrees(radius_m / F.lit(6371000.0))
    turn = lambda i: i * F.lit(2 * 3.141592653589793 / steps)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((lat + far * F.cos(turn(i))).alias("lat"), (lon + far * F.sin(turn(i)) / F.cos(F.radians(lat))).alias("lon")))


def date_in_name(name: Column) -> Column:
    """The date in a file name, written 20240115, 2024-01-15 or 2024_01_15; the name itself without one."""
    shapes = [r"(\d{4})(\d{2})(\d{2})", r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})_(\d{2})_(\d{2})"]
    part = lambda p: F.concat_ws("-", *[F.regexp_extract(name, p, i) for i in (1, 2, 3)])
    return F.coalesce(*[F.when(name.rlike(p), part(p)) for p in shapes], name)
