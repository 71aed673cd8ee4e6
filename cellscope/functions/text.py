"""Text, JSON, duration and label functions, intents and weights from questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import let

# Ordered key words of alert severities and categories; the first group that occurs counts.
SEVERITY = [
    ("Extreme", "extreme|red alert|evacuat|very severe"), ("Severe", "severe|heavy|intense|warning|orange alert"), ("Moderate", "moderate|watch|yellow alert"),
]
CATEGORY = [
    ("Met-Storm", "thunderstorm|lightning|rain|monsoon|shower"), ("Met-Heat", "heatwave|heat wave|temperature"), ("Met-Cyclone", "cyclone|depression|low pressure"),
    ("Met-Flood", "flood|waterlog|deluge"), ("Geo-Earthquake", "earthquake|seismic|tremor"), ("Geo-Landslide", "landslide|rockfall"), ("Fire", "fire"),
]
# The first pattern that a question contains names the query.
ROUTES = [
    ("restaurant", "restaurant|food|dining|eat"), ("mall", "mall|shopping|retail|shop"), ("hospital", "hospital|health|medical|clinic"), ("school", "school|education|college|university"),
    ("green", "park|green|garden|nature"), ("tourism", "hotel|tourism|tourist|heritage"), ("ithub", "it hub|tech|coworking|startup"), ("ev", "ev|electric vehicle|charging"),
    ("transit", "transit|bus|metro|transport"), ("flood", "flood|waterlog|drainage"), ("noise_hotspot", "noise|quiet|peaceful"), ("air_quality", "air quality|pollution|aqi"),
    ("safety_concern", "safety|crime|safe|dangerous"), ("best_residential", "residential|living|house|flat"), ("realestate", "investment|real estate|property"),
    ("re_warehouse", "warehouse|logistics|industrial"), ("re_highrise", "highrise|tower|tall"), ("affordable", "affordable|budget|cheap"), ("luxury", "luxury|premium|upscale"),
    ("re_redevelop", "redevelop|old building"), ("student", "student|college area"), ("senior", "senior|elderly|retirement"), ("family", "family|kid|children"), ("parking", "parking"),
]
# Concepts as a pattern and weights per score.
LEXICON: list[tuple[str, str, dict[str, float]]] = [
    ("Family-friendly", r"\bfamil(?:y|ies)\b|\bkids?\b|\bchild(?:ren)?\b|raising|parenting", {"education_score": 0.7, "safety": 0.6, "green": 0.4, "healthcare_access": 0.4, "noise_estimate": 0.3, "flood_risk": -0.3}),
    ("Young-professional", r"young professional|professionals|nightlife|vibrant|trendy|happening|buzzing|lively|singles?\b", {"entertainment_score": 0.7, "commercial": 0.6, "digital_readiness": 0.5, "connectivity": 0.5, "food_diversity": 0.4}),
    ("Quiet", r"quiet|peaceful|calm|serene|tranquil|low noise|less noise", {"noise_estimate": 0.8, "green": 0.4}),
    ("Good schools", r"school|education|college|universit|campus|student", {"education_score": 0.9}),
    ("Healthcare access", r"health|hospital|medical|clinic|pharmac|doctor", {"healthcare_access": 0.9}),
    ("Flood-safe", r"flood|waterlog|water[- ]?log|drainage|inundation|flood[- ]?safe|flood[- ]?free|low[- ]?lying", {"flood_risk": -0.9}),
    ("Safe", r"\bsafe(?:ty)?\b|secure|security|low crime|crime[- ]?free|dangerous", {"safety": 0.9}),
    ("Green", r"\bgreen\b|parks?\b|nature|trees?\b|greenery|open space|garden", {"green": 0.9}),
    ("Walkable", r"walkab|pedestrian|on foot|stroll|\bwalk\b", {"walkability": 0.9}),
    ("Well-connected", r"transit|metro|\bbus\b|public transport|commut|well[- ]?connected|connectivity", {"connectivity": 0.8, "public_service": 0.4}),
    ("Commercial", r"shop|retail|market|\bmall\b|commercial|\bbusiness\b", {"commercial": 0.8, "food_diversity": 0.3}),
    ("Food & dining", r"\bfood\b|restaurant|dining|cafe|eatery|cuisine|foodie", {"food_diversity": 0.8, "entertainment_score": 0.4}),
    ("Investment", r"invest|property|real[- ]?estate|appreciat|capital growth|\broi\b|returns?", {"investment": 0.7, "real_estate_growth": 0.7, "development_potential": 0.5}),
    ("IT / tech hub", r"it hub|\btech\b|technology|startup|start-up|co[- ]?working|coworking|digital|software", {"digital_readiness": 0.7, "commercial": 0.5, "connectivity": 0.5}),
    ("Upscale", r"luxur|premium|upscale|high[- ]?end|posh|elite|plush", {"real_estate_growth": 0.5, "investment": 0.5, "material_quality": 0.6, "noise_estimate": 0.3}),
    ("Tourism", r"touris|heritage|sightsee|landmark|attraction", {"tourism": 0.9}),
    ("Senior-friendly", r"senior|elderly|retire|old age", {"healthcare_access": 0.6, "safety": 0.5, "green": 0.4, "noise_estimate": 0.4}),
    ("Livable", r"livab|liveab|comfortable|quality of life|good place to live|settle", {"livability": 0.9}),
    ("Cleaner air", r"clean air|air quality|pollution|\baqi\b|fresh air|breathe", {"green": 0.6, "noise_estimate": 0.3}),
    ("Central / dense", r"\bdense\b|density|bustling|\bbusy\b|crowded|central", {"urban_compactness": 0.6, "population_proxy": 0.4, "commercial": 0.4}),
    ("Affordable", r"affordable|budget|cheap|low[- ]?cost|economical", {"real_estate_growth": -0.3, "investment": -0.2}),
]


def first_match(text: Column, groups: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first pattern that occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for label, pattern in groups:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise(otherwise)


def lexicon_weights(question: Column) -> Column:
    """Scores' weights by all concepts that occur, in order, held to [-1, 1] after each; empty for none.

    Letters beyond ASCII are no part of a word, as in the patterns' own language.
    """
    low = F.regexp_replace(F.lower(question), r"[^\x00-\x7F]", "~")
    held: dict[str, list[Column]] = {}
    for i, (_, _, weights) in enumerate(LEXICON):
        for score, w in weights.items():
            held.setdefault(score, []).append(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")))

    def entries(hits: Column) -> Column:
        fold = lambda own: F.aggregate(F.filter(F.array(*own), lambda e: F.get(hits, e["i"])), F.lit(None).cast("double"), lambda a, e: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(a, F.lit(0.0)) + e["w"])))
        return F.filter(F.array(*[F.struct(F.lit(s).alias("score"), F.round(fold(own), 6).alias("w")) for s, own in sorted(held.items())]), lambda e: e["w"].isNotNull())

    # The question is lowered once; each pattern is searched once, however many scores it weighs.
    return let(low, lambda q: let(F.array(*[q.rlike(pattern) for _, pattern, _ in LEXICON]), entries))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[\s]+", " "))


def normal_question(q: Column) -> Column:
    """Lower case, single spaces, no closing punctuation: the key of an answer's cache."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(q)), r"\s+", " "), r"[?.!,;]+$", "")


def json_object(text: Column) -> Column:
    """From the first { to the last }; null where that is no JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def csv_safe(c: Column) -> Column:
    """A quote before cells that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def minutes_of(hms: Column) -> Column:
    """HH:MM:SS to minutes; hours may pass 24; null for anything else."""
    p = F.split(hms, ":")
    n = lambda i: F.try_to_number(F.get(p, F.lit(i)), F.lit("999")).cast("double")
    return F.when(hms.rlike(r"^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$"), n(0) * 60 + n(1) + n(2) / 60)


def number_with_unit(c: Column) -> Column:
    """The number at the start of "3.5 m" and the like; null without one."""
    return F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def distance_label(metres: Column) -> Column:
    """Metres below one kilometre, else kilometres to one decimal."""
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.round(metres / 1000, 1).cast("string"), F.lit(" km")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def staleness(then_s: Column, now_s: Column) -> Column:
    """``struct(age_min, stale, label)``; ages below zero count as zero; stale beyond two hours."""
    age = F.greatest(F.lit(0), F.floor((now_s - then_s) / 60)).cast("long")
    label = F.when(age < 60, F.concat(age.cast("string"), F.lit(" min"))).when(age < 1440, F.concat(F.floor(age / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(age / 1440).cast("string"), F.lit(" d")))
    return F.struct(age.alias("age_min"), (age > 120).alias("stale"), label.alias("label"))
