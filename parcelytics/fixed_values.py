"""Fixed values that results depend on: word lists, lookup tables, thresholds, patterns and constants."""

# Mean Earth radii used by different steps: place matching (km), feature building (km), serving (m).
MATCH_RADIUS_KM = 6371.0
FEATURE_RADIUS_KM = 6371.0088
SERVING_RADIUS_M = 6371008.8
PERCH_M2 = 25.29285
CITY_CENTRE = (6.9333, 79.8433)
EXCEL_EPOCH = "1899-12-30"

# Serving constants.
REFERENCE_PERCHES = 12.0
SMALL_PLOT_PERCHES = 6.0
SUPPORT_GRADES = [(50, "high"), (10, "medium"), (1, "low")]
FLOOD_LEVELS = ["High", "Medium", "Low", "No official record"]

# Cleaning thresholds.
CENSOR_TOLERANCE = 9_999_999.0
RATIO_LIMIT = 10.0
SCALE_SWAP = (1 / 3, 3.0)
THOUSANDS_CEILING = 100_000.0
THOUSANDS_FACTOR = (100.0, 10_000.0)
PRICE_BAND = (0.005, 0.995)
TRIM_K = 1.5
ENCODING_SMOOTHING = 10.0
DISTINCT_MIN = 30
R_MAX = 0.80

# Accepted coordinates: the country box used for cleaning, and the one used for geocoder hits.
CLEAN_BOX = {"lat": (5.7, 10.0), "lon": (79.3, 82.1)}
HIT_BOX = {"lat": (5.70, 9.95), "lon": (79.40, 82.00)}
DUPLICATE_PIN_M = 100.0
NAME_SIMILARITY_MIN = 0.60
FUZZY_CUTOFF = 0.90
POOL_CUTOFF = 0.85
MAX_NGRAM = 4

RENT_WORDS = [
    "rent", "renting", "for rent", "lease", "leasing", "leasehold",
    "monthly", "per month", "rental", "p/m",
]
NON_LAND_TITLE_WORDS = [
    "apartment", "flat", "annex", "annexe", "condominium", "condo",
    "penthouse", "storey house", "storied house", "bedroom", "br house",
    "villa", "bungalow", "mansion", "hotel", "guest house", "warehouse",
    "factory", "showroom", "shop", "office space", "building for",
]
NON_LAND_TYPES = [
    "Office", "Building", "Factory / Workshop", "Warehouse / Storage", "Hotel", "Shop",
]

# Romanisation variants folded by the sound key, applied in this order.
ASPIRATES = [("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("ph", "p"), ("sh", "s"), ("ch", "c")]
VOWELS = [("aa", "a"), ("ee", "i"), ("oo", "u"), ("ii", "i"), ("uu", "u")]
SPELLING_SWAPS = [
    ("wela", "wala"), ("wala", "wela"), ("ela", "ala"), ("ala", "ela"), ("w", "v"), ("th", "t"), ("oo", "u"),
]

# Qualifiers stripped from official names, in this order: letter, town, cardinal, prefix.
LETTER_SUFFIX = r"^(.+?)[\s\-]+'?([ABC])'?$"
TOWN_SUFFIX = r"(?i)^(.+?)\s+((?:new\s+)?town)$"
CARDINAL_SUFFIX = r"(?i)^(.+?)[\s\-]+(north|south|east|west|central)$"
SIZE_PREFIX = r"(?i)^(ihala|pahala|maha|kuda|megoda|meda|udu)\s+(.+)$"
PROTECTED_NAMES = ["havelock town"]
SCRIPT_SUFFIXES = [
    "උතුර", "දකුණ", "නැගෙනහිර", "බටහිර", "මධ්‍යම", "ඉහළ", "පහළ", "මෙගොඩ", "මැද", "නගරය",
]
SCRIPT_PREFIXES = ["ඉහළ", "පහළ", "මහ", "කුඩා", "මෙගොඩ", "මැද"]

# Postal areas 1-15 and the division each one stands for.
POSTAL_AREAS = {
    1: "Fort", 2: "Slave Island", 3: "Kollupitiya", 4: "Bambalapitiya", 5: "Havelock Town",
    6: "Wellawatta", 7: "Kurunduwatta", 8: "Borella", 9: "Dematagoda", 10: "Maradana",
    11: "Pettah", 12: "Aluthkade", 13: "Kotahena", 14: "Grandpass", 15: "Mattakkuliya",
}
POSTAL_PATTERN = r"(?i)(?:^|[^a-z])(?:colombo|col|cmb)[\s\-.]*0*(\d{1,2})(?!\d)"

FILLER_WORDS = [
    "road", "roads", "rd", "roas", "raod", "lane", "ln", "street", "st", "avenue", "ave", "mawatha", "mawata", "mw",
    "maawatha", "pawatha", "place", "pl", "highway", "bypass", "pass", "drive", "path", "para", "paara", "cross",
    "circular", "bus", "route", "town", "city", "junction", "jn", "juncion", "junchion", "handiya", "village", "gama",
    "nagar", "nagara", "nagaraya", "pansala", "pansela", "palliya", "kovil", "devalaya", "devala", "pola",
    "vidyalaya", "maha", "school", "temple", "church", "mosque", "hospital", "bank", "market", "stadium", "ground",
    "near", "facing", "front", "side", "back", "main", "new", "old", "upper", "lower", "beside", "opposite", "close",
    "next", "behind", "off", "at", "in", "on", "to", "for", "and", "the", "of", "with", "no", "nos", "land", "lands",
    "plot", "plots", "perch", "perches", "sale", "sell", "selling", "house", "houses", "residencies", "residence",
    "residency", "block", "blocks", "phase", "meter", "meters", "metre", "km", "m", "sri", "lanka", "colombo",
]
ROAD_WORDS = [
    "road", "roads", "rd", "roas", "raod", "mawatha", "mawata", "mw", "pawatha", "lane", "street", "st", "avenue",
    "ave", "highway", "bypass", "para", "paara",
]
GENERIC_TOKENS = [
    "the", "of", "and", "in", "for", "at", "sri", "lanka", "university", "college", "school", "schools", "hospital",
    "institute", "international", "divisional", "base", "teaching", "national", "district", "general", "provincial",
    "prison", "police", "leprosy", "campus", "interchange", "memorial", "centre", "center",
]

# Map-tag categories: the first rule that holds decides.
TAG_CATEGORIES = [
    ("school", "amenity", ["school"]),
    ("hospital", "amenity", ["hospital", "clinic", "doctors"]),
    ("supermarket", "shop", ["supermarket", "convenience"]),
    ("bank", "amenity", ["bank", "atm"]),
    ("bus_stop", "highway", ["bus_stop"]),
    ("railway_station", "railway", ["station"]),
    ("park", "leisure", ["park"]),
]
NEARBY_RADIUS_M = 1500.0
NEARBY_PER_CATEGORY = 8
CACHE_TTL_DAYS = 30
CACHE_BUCKET = 0.001

# Satellite scaling: reflectance gain and offset, thermal gain and offset, Kelvin offset; the mask bits of the
# quality band (fill, dilated cloud, cirrus, cloud, cloud shadow).
REFLECTANCE_SCALE = (0.0000275, -0.2)
THERMAL_SCALE = (0.00341802, 149.0)
KELVIN = 273.15
QA_MASK_BITS = [0, 1, 2, 3, 4]
QA_WATER_BIT = 7

# Share of a unit below which it counts as not covered: what rounding leaves where polygons only touch.
LEAST_COVERED = 1e-9
