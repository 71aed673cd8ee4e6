"""Column functions over tagged elements and small values: kinds by precedence, ids, ages, fixed digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import lit

# Classes of main roads, and worship categories by religion.
ARTERIAL = ("motorway", "trunk", "primary", "secondary", "tertiary")
WORSHIP = {
    "hindu": "worship_hindu", "muslim": "worship_muslim", "islam": "worship_muslim", "jain": "worship_jain", "sikh": "worship_sikh",
    "christian": "worship_christian", "christianity": "worship_christian",
}


def _tag(tags: Column, name: str) -> Column:
    """A tag's value; null if it is missing or empty."""
    return F.nullif(F.try_element_at(tags, F.lit(name)), F.lit(""))


def is_arterial(road_class: Column, classes: tuple[str, ...] = ARTERIAL) -> Column:
    """One of the classes or its link road."""
    return F.coalesce(F.regexp_replace(road_class, "_link$", "").isin(*classes), F.lit(False))


def transit_kind(tags: Column) -> Column:
    """A bus station by amenity, else the highway's, else the public transport's value, else a stop."""
    return F.when(_tag(tags, "amenity") == "bus_station", F.lit("bus_station")).otherwise(F.coalesce(_tag(tags, "highway"), _tag(tags, "public_transport"), F.lit("stop")))


def safety_kind(tags: Column) -> Column:
    """Police, level crossing or barrier, in this order; null for anything else."""
    barrier = _tag(tags, "barrier")
    return F.when(_tag(tags, "amenity") == "police", F.lit("police")).when(_tag(tags, "railway") == "level_crossing", F.lit("level_crossing")).when(barrier.isin("toll_booth", "lift_gate"), barrier)


def crowd_category(tags: Column) -> Column:
    """Where crowds gather or are looked after: worship by religion first, then the amenities in order; else null."""
    amenity, shop = _tag(tags, "amenity"), _tag(tags, "shop")
    table = F.create_map(*[F.lit(x) for kv in WORSHIP.items() for x in kv])
    worship = F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(_tag(tags, "religion"), F.lit(""))))), F.lit("worship_other"))
    sacred = (amenity == "place_of_worship") | _tag(tags, "building").isin("temple", "mosque", "church") | _tag(tags, "religion").isNotNull()
    return (
        F.when(sacred, worship).when(amenity == "marketplace", "market").when(amenity.isin("school", "college", "university"), "school")
        .when(amenity.isin("hospital", "clinic"), "hospital").when(amenity == "police", "police").when(amenity == "fire_station", "fire_station")
        .when((amenity == "bus_station") | (_tag(tags, "public_transport") == "station"), "transport").when(shop.isin("supermarket", "mall", "general"), "market")
        .when(amenity == "fuel", "transport")
    )


def link_identifier(link: Column) -> Column:
    """The identifier parameter of a feed's link; the link itself without one."""
    found = F.regexp_extract(link, r"identifier=([\w-]+)", 1)
    return F.when(found != "", found).otherwise(link)


def age_years(then_s: Column, now_s: Column) -> Column:
    """Years of 365.25 days between two times in seconds, never under 0."""
    return F.greatest(F.lit(0.0), (now_s - then_s) / F.lit(365.25 * 86_400))


def fixed_digits(x: Column, digits: int) -> Column:
    """The number with so many decimals, rounded on its exact binary value, ties away from zero.

    The product with the power of ten is taken with its rounding error, by splitting the number in halves of
    26 bits, so that 1.005 gives 1.00 and 1.125 gives 1.13.
    """
    scale = float(10**digits)
    a = F.abs(x.cast("double"))
    p = a * scale
    high = a * 134_217_729.0 - (a * 134_217_729.0 - a)
    error = (high * scale - p) + (a - high) * scale
    low = F.floor(p)
    rest = (p - low) + error
    whole = low + F.when(rest >= 0.5, 1).when(rest < -0.5, -1).otherwise(0)
    n = 10**digits
    text = F.format_string(f"%d.%0{digits}d", F.floor(whole / lit(float(n))).cast("long"), (whole % n).cast("long")) if digits else F.format_string("%d", whole.cast("long"))
    return F.when(x.isNotNull(), F.concat(F.when((x < 0), F.lit("-")).otherwise(F.lit("")), text))


def axis_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Share of the shorter of two ranges that both have; 0 if they are apart or one has no length."""
    both, shorter = F.least(high_a, high_b) - F.greatest(low_a, low_b), F.least(high_a - low_a, high_b - low_b)
    return F.when((both > 0) & (shorter > 0), both / shorter).otherwise(F.lit(0.0))
