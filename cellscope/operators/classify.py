"""Map elements to features by tag rules, and rule-table lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> feature -> (tag key, value); a value of several alternatives is split by "|",
# "*" takes any value.
RULES: dict[str, dict[str, tuple[str, str]]] = {
    "food": {
        "restaurants": ("amenity", "restaurant"), "cafes": ("amenity", "cafe"), "fast_food": ("amenity", "fast_food"), "bars": ("amenity", "bar|pub"),
        "food_court": ("amenity", "food_court"), "ice_cream": ("amenity", "ice_cream"), "bakery": ("shop", "bakery"), "butcher": ("shop", "butcher"),
        "confectionery": ("shop", "confectionery"), "drinking_water": ("amenity", "drinking_water"),
    },
    "education": {
        "schools": ("amenity", "school"), "colleges": ("amenity", "college"), "universities": ("amenity", "university"), "kindergartens": ("amenity", "kindergarten"),
        "libraries": ("amenity", "library"), "language_school": ("amenity", "language_school"), "driving_school": ("amenity", "driving_school"), "research": ("amenity", "research_institute"),
    },
    "healthcare": {
        "hospitals": ("amenity", "hospital"), "clinics": ("amenity", "clinic|doctors"), "pharmacies": ("amenity", "pharmacy"), "dentists": ("amenity", "dentist"),
        "veterinary": ("amenity", "veterinary"), "blood_bank": ("healthcare", "blood_bank"), "nursing_home": ("amenity", "nursing_home"), "lab": ("healthcare", "laboratory"),
        "optician": ("shop", "optician"), "alt_medicine": ("healthcare", "alternative"),
    },
    "finance": {
        "banks": ("amenity", "bank"), "atms": ("amenity", "atm"), "exchange": ("amenity", "bureau_de_change"), "insurance": ("office", "insurance"),
        "microfinance": ("amenity", "microfinance"), "financial": ("office", "financial"), "tax": ("office", "tax"),
    },
    "shopping": {
        "mall": ("shop", "mall"), "supermarket": ("shop", "supermarket"), "convenience": ("shop", "convenience"), "clothes": ("shop", "clothes"),
        "electronics": ("shop", "electronics"), "mobile": ("shop", "mobile_phone"), "hardware": ("shop", "hardware|doityourself"), "furniture": ("shop", "furniture"),
        "jewelry": ("shop", "jewelry"), "books": ("shop", "books"), "stationery": ("shop", "stationery"), "department": ("shop", "department_store"),
        "marketplace": ("amenity", "marketplace"), "car_dealer": ("shop", "car"),
    },
    "transport": {
        "bus_stop": ("highway", "bus_stop"), "railway": ("railway", "station|halt"), "metro": ("station", "subway"), "taxi": ("amenity", "taxi"),
        "parking": ("amenity", "parking"), "bicycle_parking": ("amenity", "bicycle_parking"), "bicycle_rental": ("amenity", "bicycle_rental"), "fuel": ("amenity", "fuel"),
        "ev_charging": ("amenity", "charging_station"), "car_wash": ("amenity", "car_wash"), "car_repair": ("shop", "car_repair"), "auto_rickshaw": ("amenity", "auto_rickshaw_stand"),
    },
    "government": {
        "police": ("amenity", "police"), "fire": ("amenity", "fire_station"), "post_office": ("amenity", "post_office"), "courthouse": ("amenity", "courthouse"),
        "govt_office": ("office", "government"), "embassy": ("amenity", "embassy"), "community": ("amenity", "community_centre"), "social": ("amenity", "social_facility"),
        "toilets": ("amenity", "toilets"), "recycling": ("amenity", "recycling|waste_disposal"), "townhall": ("amenity", "townhall"), "prison": ("amenity", "prison"),
    },
    "leisure": {
        "parks": ("leisure", "park"), "playground": ("leisure", "playground"), "garden": ("leisure", "garden"), "pitch": ("leisure", "pitch"),
        "swimming": ("leisure", "swimming_pool"), "gym": ("leisure", "fitness_centre"), "sports_centre": ("leisure", "sports_centre"), "stadium": ("leisure", "stadium"),
        "golf": ("leisure", "golf_course"), "water_park": ("leisure", "water_park"), "dog_park": ("leisure", "dog_park"), "nature_reserve": ("leisure", "nature_reserve"),
    },
    "entertainment": {
        "cinema": ("amenity", "cinema"), "theatre": ("amenity", "theatre"), "museum": ("tourism", "museum"), "gallery": ("tourism", "gallery"),
        "nightclub": ("amenity", "nightclub"), "arcade": ("leisure", "amusement_arcade"), "theme_park": ("tourism", "theme_park"), "zoo": ("tourism", "zoo"),
        "monument": ("historic", "monument|memorial"), "worship": ("amenity", "place_of_worship"),
    },
    "accommodation": {
        "hotel": ("tourism", "hotel"), "guest_house": ("tourism", "guest_house"), "hostel": ("tourism", "hostel"), "motel": ("tourism", "motel"),
        "attraction": ("tourism", "attraction"), "viewpoint": ("tourism", "viewpoint"), "info": ("tourism", "information"), "picnic": ("tourism", "picnic_site"),
    },
    "landuse": {
        "residential_area": ("landuse", "residential"), "commercial_area": ("landuse", "commercial"), "industrial_area": ("landuse", "industrial"), "retail_area": ("landuse", "retail"),
        "buildings_total": ("building", "*"), "res_buildings": ("building", "residential|house|apartments|detached"), "com_buildings": ("building", "commercial|office|retail"),
        "construction": ("landuse", "construction"), "vacant": ("landuse", "brownfield|greenfield"), "cemetery": ("landuse", "cemetery"), "military": ("landuse", "military"),
        "farmland": ("landuse", "farmland|orchard|vineyard"),
    },
    "infrastructure": {
        "street_lamps": ("highway", "street_lamp"), "cell_tower": ("man_made", "tower|mast"), "power": ("power", "substation|line|pole"), "water_tower": ("man_made", "water_tower|storage_tank"),
        "bridge": ("man_made", "bridge"), "roads": ("highway", "primary|secondary|tertiary|residential|trunk"), "footpath": ("highway", "footway|path|pedestrian"),
        "cycleway": ("highway", "cycleway"), "water_body": ("natural", "water"), "river": ("waterway", "river|stream|canal"),
    },
    "business": {
        "offices": ("office", "yes|company"), "it_company": ("office", "it"), "coworking": ("amenity", "coworking_space"), "estate_agent": ("shop", "estate_agent"),
        "lawyer": ("office", "lawyer"), "accountant": ("office", "accountant"), "beauty": ("shop", "beauty|hairdresser"), "laundry": ("shop", "laundry|dry_cleaning"),
        "photo": ("shop", "photo"), "tailor": ("shop", "tailor"),
    },
}


def rule_rows() -> list[tuple[str, str, str, str]]:
    """(category, feature, tag key, value), one row per alternative value."""
    return [(c, f, key, v) for c, features in RULES.items() for f, (key, values) in features.items() for v in values.split("|")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "category string, feature string, key string, value string")


def classify(elements: DataFrame) -> DataFrame:
    """``k, category, feature`` for every rule that an element meets; an element may meet several.

    Empty tag values never match. Elements without a relevant key are dropped before their tags are
    exploded; the rules, a constant table of some 160 rows, are broadcast.
    """
    spark = elements.sparkSession
    relevant = sorted({key for _, _, key, _ in rule_rows()})
    tagged = elements.filter(F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, relevant))))
    pairs = tagged.select("k", F.explode("tags").alias("key", "actual")).filter("actual <> ''")
    rules = F.broadcast(rule_table(spark))
    hit = (pairs["key"] == rules["key"]) & ((pairs["actual"] == rules["value"]) | (rules["value"] == "*"))
    return pairs.join(rules, hit).select("k", "category", "feature").distinct()
