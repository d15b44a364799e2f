"""Column builders: text, numbers, geography, time. All stay in the JVM; none is a UDF."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Text
@cache
def fold_table(with_d: bool) -> tuple[str, str]:
    """Accented letters of the Latin blocks and what is left of each without its marks, made from the Unicode data."""
    pairs = []
    for c in (chr(i) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(*r)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    pairs += [("đ", "d"), ("Đ", "D")] if with_d else []
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _folded(c: Column, with_d: bool) -> Column:
    source, target = fold_table(with_d)
    x = F.coalesce(c, F.lit(""))
    folded = F.lower(F.translate(F.regexp_replace(x, "[\\u0300-\\u036f]", ""), source, target))
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(folded)  # plain ASCII has nothing to fold


def normalize_text(c: Column) -> Column:
    """Without accents, d for đ, in lower case; null is empty."""
    return _folded(c, True)


def clean_key(c: Column, fallback: str | None = "unknown") -> Column:
    """[a-z0-9] runs joined by underscores; đ is no letter here."""
    key = F.btrim(F.regexp_replace(_folded(c, False), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(key == "", F.lit(fallback)).otherwise(key) if fallback != "" else key


def normalize_name(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(_folded(c, False), "[^a-z0-9\\s]", " "), "\\s+", " ")), 1, 300)


def clean_string(c: Column, limit: int | None = None) -> Column:
    """Trimmed; the words for no value are empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    t = F.when(F.lower(t).isin("nan", "none", "null", "n/a"), "").otherwise(t)
    return F.substring(t, 1, limit) if limit else t


def optional_number(c: Column) -> Column:
    """The number at the start of a text, the first comma as a point; else null."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^([^,]*),", "$1."))
    return F.nullif(F.regexp_extract(t, "^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?", 0), F.lit("")).try_cast("double")


def parse_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|;]"), lambda x: clean_string(x)), lambda x: x != "")


def image_urls(c: Column) -> Column:
    """http and https addresses of a comma-separated list, each once, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda u: F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull(), F.lit(False))))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def query_tokens(query: str) -> list[str]:
    import re

    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D").lower()
    return [t for t in re.split("[^a-z0-9]+", plain) if len(t) >= 2]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def hits(doc: Column, terms: list[str]) -> Column:
    return total([F.contains(doc, F.lit(t)).cast("int") for t in terms])


def keyword_score(query: str, doc: Column) -> Column:
    """Share of the query's distinct tokens that the text holds."""
    terms = list(dict.fromkeys(query_tokens(query)))
    return hits(doc, terms) / F.lit(float(len(terms))) if terms else F.lit(0.0)


def contains_any(doc: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(doc, F.lit(t)) for t in terms], F.lit(False))


def search_keywords(c: Column, most: int = 120) -> Column:
    """Tokens and their prefixes of 2 to 12 characters."""
    t = tokens(c)
    prefixes = F.flatten(F.transform(t, lambda x: F.transform(F.sequence(F.lit(2), F.least(F.lit(12), F.length(x))), lambda i: F.substr(x, F.lit(1), i))))
    return F.slice(F.array_distinct(F.concat(t, prefixes)), 1, most)


# Numbers
def rounded(c: Column, n: int = 6) -> Column:
    """Half up, the same in all engines."""
    p = 10.0**n
    return F.floor(c * p + 0.5) / p


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(clamp(c, 0.0, 1.0))


def rating_score(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (c == 0), 0.35).when(c > 5, clamp01(c / 10.0)).otherwise(clamp01(c / 5.0))


def review_signal(c: Column) -> Column:
    return clamp01(F.log10(F.coalesce(c, F.lit(0)) + 1.0) / 3.0)


def distance_score(km: Column, most: float = 12.0) -> Column:
    return clamp01(1.0 - km / most)


def map_score(m: Column, key: Column) -> Column:
    return clamp01(F.coalesce(F.try_element_at(m, key), F.lit(0.0)) / F.greatest(F.coalesce(F.array_max(F.map_values(m)), F.lit(1.0)), F.lit(1.0)))


def popularity_score(visited: Column, added: Column, routed: Column, reviews: Column, rating: Column) -> Column:
    part = lambda c, d: clamp01(F.log10(c + 1.0) / d)
    return clamp01(part(visited, 2.2) * 0.28 + part(added, 2.2) * 0.24 + part(routed, 2.4) * 0.16 + review_signal(reviews) * 0.14 + rating_score(rating) * 0.18)


def trapezoid(x: Column, a: float | Column, b: float | Column, c: float | Column, d: float | Column) -> Column:
    """Membership; at or outside the outer edges 0, even where a = b."""
    a, b, c, d = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b, c, d))
    return F.when((x <= a) | (x >= d), 0.0).when((x >= b) & (x <= c), 1.0).when(x < b, (x - a) / (b - a)).otherwise((d - x) / (d - c))


# Geography
def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return 2 * 6371000.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def grid_key(lat: Column, lon: Column, size: float = 0.018) -> Column:
    cell = lambda c: F.floor(c / size + 0.5) * size
    return F.format_string("%.3f,%.3f", cell(lat), cell(lon))


#: Speed in km/h, overhead and least minutes: fixed values, one set for matrices and one for trips.
MATRIX_SPEED = {"walking": 4.5, "car": 28.0}
TRIP_MODES = {"walk": (4.5, 0.0, 2.0), "motorbike": (22.0, 3.0, 4.0), "car": (18.0, 5.0, 5.0), "taxi": (18.0, 7.0, 7.0)}


def matrix_minutes(km: Column, mode: str) -> Column:
    return F.when(km.isNotNull(), F.greatest(F.lit(3.0), js_round(km / MATRIX_SPEED.get(mode, 22.0) * 60.0).cast("double")))


def leg_metres(*points: Column) -> Column:
    return js_round(haversine_m(*points) / 10.0) * 10


def leg_minutes(metres: Column, mode: str = "motorbike") -> Column:
    speed, overhead, least = TRIP_MODES.get(mode, TRIP_MODES["motorbike"])
    return F.when(metres.isNotNull(), F.greatest(F.lit(least), F.ceil(metres / 1000.0 / speed * 60.0 + overhead).cast("double")))


# Time
def minutes_of(c: Column) -> Column:
    """HH:mm as minutes; null where it's no time."""
    ok = c.rlike("^\\d{1,2}:\\d{1,2}$")
    return F.when(ok, F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int"))


def time_of(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


OPENING = "^([01][0-9]|2[0-3]):([0-5][0-9])\\s*-\\s*([01][0-9]|2[0-3]):([0-5][0-9])$"


def opening_ranges(c: Column) -> Column:
    """Ranges in minutes; a null range where a part can't be read or doesn't end after its start."""
    def one(part: Column) -> Column:
        p = F.trim(part)
        at = [F.regexp_extract(p, OPENING, i).try_cast("int") for i in range(1, 5)]
        start, end = at[0] * 60 + at[1], at[2] * 60 + at[3]
        return F.when(p.rlike(OPENING) & (end > start), F.struct(start.alias("start"), end.alias("end")))

    return F.transform(F.split(F.trim(c), "\\|", -1), one)


def opening_status(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "unknown").when(F.exists(opening_ranges(c), lambda r: r.isNull()), "unparseable").otherwise("known")


def opening_fit(c: Column, arrival: Column, departure: Column) -> Column:
    fits = F.exists(opening_ranges(c), lambda r: (arrival >= r["start"]) & (departure <= r["end"]))
    return F.when(opening_status(c) != "known", opening_status(c)).when(fits, "open").otherwise("conflict")


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 11, "morning").when(hour < 17, "afternoon").when(hour < 22, "evening").otherwise("night")


def dwell_style(minutes: Column) -> Column:
    return F.when(minutes < 25, "quick_stop").when(minutes < 75, "standard_visit").otherwise("long_stay")


#: Stop minutes by the first category term that is found, in this order: fixed values.
STOP_MINUTES = {
    "cafe": 60, "coffee": 60, "tea": 60, "restaurant": 75, "food": 75, "seafood": 75, "local_food": 75, "dessert": 45, "bakery": 45, "snack": 45, "attraction": 75,
    "landmark": 75, "viewpoint": 75, "museum": 90, "cultural": 90, "historic": 90, "gallery": 90, "beach": 90, "park": 90, "nature": 90, "riverside": 90, "shopping": 75,
    "market": 75, "mall": 75, "nightlife": 90, "bar": 90, "pub": 90, "spa": 90, "wellness": 90, "activity": 90, "entertainment": 90, "hotel": 30, "lodging": 30,
}


def stop_minutes(haystack: Column, requested: Column | None = None) -> Column:
    by_term = F.coalesce(*[F.when(F.contains(haystack, F.lit(t)), F.lit(m)) for t, m in STOP_MINUTES.items()], F.lit(60))
    return by_term if requested is None else F.when(requested.between(15, 480), requested).otherwise(by_term)
