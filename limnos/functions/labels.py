"""Labels of features, names, catches and weather, as Column expressions over rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _col

# Upper bounds in feet and their colours, for soundings and for contours.
SOUNDING_COLOURS = [(2, "#b71c1c"), (4, "#e63946"), (8, "#f4795b"), (20, "#f4a261"), (28, "#e9c46a"), (36, "#2a9d8f"), (45, "#00e5ff"), (55, "#0077b6"), (65, "#7b2d8b")]
CONTOUR_COLOURS = [(10, "#4dd0e1"), (20, "#4db6ac"), (30, "#66bb6a"), (50, "#aed581"), (70, "#fff176"), (90, "#ffb74d")]
DEEPEST_SOUNDING, DEEPEST_CONTOUR = "#ffffff", "#ef5350"

# Names of depth properties, in order of trust.
DEPTH_NAMES = ("depth", "DEPTH", "elevation", "ELEVATION", "CONTOUR", "contour", "Elev", "Level", "Z", "z", "depth_ft", "DEPTH_FT", "Contour", "ContourInterval")

# Map tags and the kinds they tell, the first kind that fits counts; a bridge's kind follows what it carries.
INLAND_KINDS = [
    ("DAM", {"waterway": "dam weir", "man_made": "dam"}),
    ("BOAT_RAMP", {"waterway": "boat_slipway", "leisure": "slipway"}),
    ("PIER", {"waterway": "dock", "man_made": "pier dock"}),
    ("BREAKWATER", {"man_made": "breakwater"}),
    ("GROYNE", {"man_made": "groyne"}),
    ("HAZARD_MARKER", {"man_made": "buoy artificial_reef"}),
    ("FISH_ATTRACTOR", {"fish_attractor": "yes"}),
    ("HAZARD", {"natural": "rock", "submerged": "yes", "hazard": "navigation"}),
    ("", {"bridge": "yes"}),
    ("ISLAND", {"place": "island islet", "natural": "island"}),
]
COASTAL_KINDS = [
    ("DAM", {"waterway": "dam weir", "man_made": "dam"}),
    ("BOAT_RAMP", {"waterway": "boat_slipway", "leisure": "slipway"}),
    ("MARINA", {"waterway": "dock boatyard", "leisure": "marina", "man_made": "marina"}),
    ("TIDAL_CHANNEL", {"waterway": "tidal_channel"}),
    ("PIER", {"man_made": "pier dock"}),
    ("JETTY", {"man_made": "jetty"}),
    ("BREAKWATER", {"man_made": "breakwater"}),
    ("GROYNE", {"man_made": "groyne"}),
    ("NAV_BEACON", {"man_made": "beacon", "seamark:type": "beacon_cardinal beacon_lateral beacon_safe_water beacon_isolated_danger beacon_special_purpose"}),
    ("NAV_BUOY", {"man_made": "buoy", "seamark:type": "buoy_cardinal buoy_lateral buoy_safe_water buoy_isolated_danger buoy_special_purpose"}),
    ("NAV_LIGHT", {"seamark:type": "light light_minor light_vessel"}),
    ("MOORING", {"seamark:type": "mooring"}),
    ("HAZARD", {"seamark:type": "wreck obstruction"}),
    ("LANDMARK", {"seamark:type": "landmark"}),
    ("MARINA", {"seamark:type": "harbour small_craft_facility anchorage"}),
    ("NAV_LINE", {"seamark:type": "navigation_line recommended_track"}),
    ("REEF_SHOAL", {"natural": "reef shoal", "seamark:type": "rock"}),
    ("HAZARD", {"natural": "rock", "submerged": "yes", "hazard": "navigation"}),
    ("FISH_ATTRACTOR", {"fish_attractor": "yes", "leisure": "fishing"}),
    ("SHORELINE", {"natural": "island coastline beach mud"}),
    ("ISLAND", {"place": "island islet"}),
    ("", {"bridge": "yes"}),
]
FOOTWAYS = "footway path pedestrian"
WANTED = {
    "waterway": "dam weir boat_slipway dock tidal_channel boatyard",
    "man_made": "pier dock jetty groyne breakwater buoy beacon marina artificial_reef",
    "leisure": "marina fishing slipway",
    "place": "island islet",
    "natural": "reef shoal rock island coastline beach mud",
    "fish_attractor": "yes",
    "submerged": "yes",
    "hazard": "navigation",
}


def _colour(depth: Column, bands: list[tuple[int, str]], deepest: str) -> Column:
    """The first band whose upper bound, itself included, holds the depth."""
    return F.coalesce(*(F.when(depth <= top, F.lit(colour)) for top, colour in bands), F.lit(deepest))


def sounding_colour(feet) -> Column:
    """The band's colour; an unknown depth has the deepest's."""
    d = _col(feet).cast("double")
    return _colour(F.when(~F.isnan(d), d), SOUNDING_COLOURS, DEEPEST_SOUNDING)


def contour_colour(depth) -> Column:
    """By the size of the number that the value starts with; no number counts as 0."""
    number = F.regexp_extract(F.trim(_col(depth).cast("string")), r"^[+-]?\d*\.?\d+", 0).try_cast("double")
    return _colour(F.abs(F.coalesce(number, F.lit(0.0))), CONTOUR_COLOURS, DEEPEST_CONTOUR)


def depth_property(properties) -> Column:
    """The key that holds a depth in a map of properties: a known name with a value, else the first key that sounds like one and holds a number."""
    p = _col(properties)
    known = F.filter(F.array(*map(F.lit, DEPTH_NAMES)), lambda k: F.try_element_at(p, k).isNotNull())
    likely = F.filter(F.map_entries(p), lambda e: e["key"].rlike("(?i)depth|elev|contour|z") & e["value"].rlike(r"^\s*[+-]?\d*\.?\d"))
    return F.coalesce(F.get(known, 0), F.get(likely, 0)["key"])


def _has(tags: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(False)
    for key, values in wanted.items():
        out = out | F.coalesce(F.try_element_at(tags, F.lit(key)).isin(*values.split()), F.lit(False))
    return out


def _set(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)) != "", F.lit(False))


def kind_of(tags, kinds: list[tuple[str, dict[str, str]]] = INLAND_KINDS) -> Column:
    """The feature kind that a map of tags tells; OTHER where none does."""
    t = _col(tags)
    bridge = F.when(_set(t, "railway"), "RAIL_BRIDGE").when(_has(t, {"highway": FOOTWAYS}), "FOOT_BRIDGE").when(_set(t, "highway"), "ROAD_BRIDGE").otherwise("BRIDGE")
    return F.coalesce(*(F.when(_has(t, wanted), F.lit(kind) if kind else bridge) for kind, wanted in kinds), F.lit("OTHER"))


def worth_keeping(tags) -> Column:
    """Whether a map feature bears on the water: a wanted tag, any sea mark, or a bridge that carries something."""
    t = _col(tags)
    return _has(t, WANTED) | _set(t, "seamark:type") | (_has(t, {"bridge": "yes"}) & (_set(t, "highway") | _set(t, "railway")))


# Words of bait that swims or is cut.
LIVE_BAIT = ("live", "free-line", "freeline", "free line", "downline", "down-line", "down line", "cut bait")


def live_bait(name) -> Column:
    return F.coalesce(F.lower(_col(name)).rlike("|".join(LIVE_BAIT)), F.lit(False))


def name_quality(name, generic: tuple[str, ...], water: Column | None = None) -> Column:
    """struct<named,words,tidy>, to be compared as a whole: whether words besides generic ones and the water's (an array) are left, how many, and whether there is no parenthesis."""
    n = F.coalesce(_col(name), F.lit(""))
    words = F.filter(F.split(F.lower(n), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*generic))
    own = F.array_except(F.array_distinct(words), water) if water is not None else words
    count = F.size(F.filter(words, lambda w: F.array_contains(own, w))) if water is not None else F.size(words)
    return F.struct((count > 0).cast("int").alias("named"), count.alias("words"), ((n != "") & ~n.contains("(")).cast("int").alias("tidy"))


# Spellings of species, and phrases that name one in a note, the first that occurs counts.
SPECIES = {
    "White Bass/Hybrid": "White Bass / Hybrid", "Hybrid": "White Bass / Hybrid", "Striper": "Striped Bass", "Black Bass": "Largemouth Bass", "Bowfin (Mudfish)": "Bowfin", "Mudfish": "Bowfin",
    "Bowfin Mudfish": "Bowfin", "Black Crappie": "Crappie", "White Crappie": "Crappie", "Sunfish": "Sunfish (Panfish)", "Shad": "American Shad", "No Fish": "Not Fish", "None": "",
}
SPECIES_IN_NOTES = [
    ("Striped Bass", "striped bass|striper"), ("Largemouth Bass", "largemouth|large mouth|black bass"), ("Smallmouth Bass", "smallmouth"), ("Spotted Bass", "spotted bass"),
    ("Crappie", "crappie|black crappie|white crappie"), ("Catfish", "catfish|blue cat|channel cat|flathead|barbels"), ("Bowfin", "bowfin|mudfish"), ("Chain Pickerel", "chain pickerel|pickerel"),
    ("Bluegill", "bluegill"), ("Sunfish (Panfish)", "sunfish|panfish|shellcracker|redear|redbreast"), ("Gar", "gar"), ("Yellow Perch", "yellow perch"), ("White Bass / Hybrid", "white bass|hybrid"),
    ("Red Drum (Redfish)", "redfish|red drum"), ("Speckled Trout (Spotted Seatrout)", "speckled trout|spotted seatrout"), ("Flounder", "flounder"),
]
NO_SPECIES = ("", "other fish", "unknown", "not fish", "no fish")


def clean_species(name) -> Column:
    n = F.trim(F.coalesce(_col(name), F.lit("")))
    known = F.create_map(*(F.lit(x) for pair in SPECIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, n), n)


def species_or_inferred(name, notes) -> Column:
    """struct<species,inferred>: the cleaned name, or what the notes name where it tells none."""
    own, text = clean_species(name), F.lower(F.coalesce(_col(notes), F.lit("")))
    found = F.coalesce(*(F.when(text.rlike(rf"\b({phrases})\b"), F.lit(kind)) for kind, phrases in SPECIES_IN_NOTES))
    asked = F.lower(own).isin(*NO_SPECIES) & found.isNotNull()
    return F.struct(F.when(asked, found).otherwise(own).alias("species"), asked.alias("inferred"))


# Words of waypoints and the species they stand for, the first counts.
WAYPOINT_SPECIES = [("striper|stripe", "Striped Bass"), ("bass", "Largemouth Bass"), ("red|drum", "Redfish"), ("crappie", "Crappie")]


def waypoint_species(name, symbol) -> Column:
    text = F.lower(F.concat(F.coalesce(_col(name), F.lit("")), F.coalesce(_col(symbol), F.lit(""))))
    return F.coalesce(*(F.when(text.rlike(p), F.lit(s)) for p, s in WAYPOINT_SPECIES), F.lit("Fish"))


def plausible_length(species, inches, longest: dict[str, float], default: float = 60.0, least: float = 3.0) -> Column:
    """ok, too long or too short; ok where nothing is told."""
    limits = F.create_map(*(F.lit(x) for pair in longest.items() for x in (pair[0], float(pair[1]))))
    top = F.coalesce(F.try_element_at(limits, _col(species)), F.lit(default))
    n = _col(inches)
    return F.when(n.isNull() | (n == 0) | _col(species).isNull(), "ok").when(n > top, "too long").when(n < least, "too short").otherwise("ok")


# Words of weather and the share of sky they leave clouded, the first counts.
CLOUDS = [("overcast|cloudy(?!.*partly)|rain|storm|shower|fog", 0.9), ("mostly cloudy", 0.8), ("partly (cloudy|sunny)|scattered", 0.5), ("mostly (sunny|clear)", 0.2), ("fair|sunny|clear", 0.1)]


def cloud_share(weather) -> Column:
    """0 to 1 out of words, a share or percent; null where it tells nothing."""
    w = F.lower(F.trim(_col(weather).cast("string")))
    n = w.try_cast("double")
    told = F.coalesce(*(F.when(w.rlike(p), F.lit(v)) for p, v in CLOUDS))
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n)))).otherwise(told)


def low_light(phase, weather) -> Column:
    """1 at dawn and dusk (phase 1), half in phase 2, a quarter else; clouds add three fifths of what is missing."""
    base = F.when(_col(phase) == 1, 1.0).when(_col(phase) == 2, 0.5).otherwise(0.25)
    return F.coalesce(F.floor(F.least(F.lit(1.0), base + cloud_share(weather) * (1 - base) * 0.6) * 100 + 0.5) / 100, base)


def station_day(day) -> Column:
    """2024-05-01 as a tide service writes it."""
    return F.replace(F.coalesce(_col(day).cast("string"), F.lit("")), F.lit("-"), F.lit(""))


def station_time(text) -> Column:
    """A tide service's local time to the minute; null for other forms."""
    t = F.nullif(F.regexp_extract(_col(text), r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", 0), F.lit(""))
    return F.replace(t, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def listed(value, parts: str = r"[,;/]|\band\b") -> Column:
    """array<string> out of a JSON array of strings, or of prose; blanks go."""
    t = F.trim(_col(value))
    told = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    items = F.coalesce(told, F.split(t, f"(?i){parts}"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def stockings(value) -> Column:
    """array<struct<species,year>> out of a JSON list of records, of names, or of prose."""
    t = F.trim(_col(value))
    kind = "array<struct<species:string,year:string>>"
    records = F.filter(F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), kind), lambda r: F.coalesce(r["species"] != "", F.lit(False)))
    named = F.transform(listed(t, "[,;]"), lambda s: F.struct(s.alias("species"), F.lit(None).cast("string").alias("year")))
    return F.when(F.coalesce(F.size(records) > 0, F.lit(False)), records).otherwise(F.coalesce(named, F.array().cast(kind)))


def kept_entries(entries) -> Column:
    """A map without null and empty values; null if nothing is left."""
    out = F.map_filter(_col(entries), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(out) > 0, out)


def with_path(entries, path, value) -> Column:
    """A flattened record (a map by dotted paths) with a value at a path: what stood there, below it, or as a plain value above it goes."""
    m, p = _col(entries), _col(path)
    rest = F.map_filter(m, lambda k, v: (k != p) & ~k.startswith(F.concat(p, F.lit("."))) & ~p.startswith(F.concat(k, F.lit("."))))
    return F.map_concat(rest, F.create_map(p, _col(value)))


# Flags of a catch that a person has to look at.
REVIEW = ("not_fish_or_rejected", "verify_board_length_from_photo", "board_missing_length", "species_needs_review", "inferred_from_notes", "low_confidence", "species_normalized")


def review_flags(has_fish, on_board, length, raw_species, notes, confidence) -> Column:
    """array of the flags of an imported catch, in the order of REVIEW. length: text, blank where none."""
    told, raw = species_or_inferred(raw_species, notes), F.trim(F.coalesce(_col(raw_species), F.lit("")))
    fish, board = F.coalesce(_col(has_fish), F.lit(False)), F.coalesce(_col(on_board), F.lit(False))
    kind = told["species"]
    holds = (~fish, board, board & (F.trim(F.coalesce(_col(length), F.lit(""))) == ""), kind.isin("", "Other Fish", "Unknown"), told["inferred"], F.lower(F.coalesce(_col(confidence), F.lit(""))).contains("low"), (clean_species(raw) != kind) & (kind != ""))
    return F.array_compact(F.array(*(F.when(h, F.lit(name)) for name, h in zip(REVIEW, holds, strict=True))))
