"""Traffic rules: road names, rule joins and fuzzy congestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bearing, trapezoid

#: Peak hours (first start, first end, second start, second end) by road class: fixed values.
PEAKS = {"primary": (6.5, 9.0, 16.0, 19.0), "secondary": (7.0, 8.5, 16.5, 18.5), "residential": (7.0, 8.0, 17.0, 18.0)}


def road_name(c: Column) -> Column:
    """Lower case, without the word for road in front, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "^\\s*(đường|phố|road|street)\\s+", ""), "\\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one part of the other; empty names match nothing."""
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | F.contains(a, b) | F.contains(b, a))


def fuzzy_join(names: DataFrame, rules: DataFrame, name: str, rule: str) -> DataFrame:
    """Each distinct name with its first matching rule by number. rules is a small literal table, broadcast below Spark's own size limit."""
    pairs = names.select(name).distinct().join(rules, names_match(F.col(name), F.col(rule)))
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy("rule_id"))).where("__n = 1").drop("__n")


def one_way_state(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rule_bearing: Column, metres: Column) -> Column:
    """violation beyond 150 degrees from the allowed direction, fine up to 90, else neither; segments of under 15 m are skipped."""
    d = F.abs(bearing(lat1, lon1, lat2, lon2) - rule_bearing)
    angle = F.when(d > 180, 360.0 - d).otherwise(d)
    return F.when(metres < 15, "skipped").when(angle <= 90, "fine").when(angle > 150, "violation").otherwise("neither")


def peak_degree(hour: Column, road_class: Column) -> Column:
    out = None
    for name, (a, b, c, d) in PEAKS.items():
        m = F.greatest(trapezoid(hour, a - 1, a, b, b + 1), trapezoid(hour, c - 1, c, d, d + 1))
        out = F.when(road_class == name, m) if out is None else out.when(road_class == name, m) if name != "residential" else out.otherwise(m)
    return out


def traffic_levels(hour: Column, density: Column, rain: Column, road_class: Column) -> tuple[Column, Column, Column]:
    """Degrees of low, medium and high traffic: and is the least, or the greatest."""
    p = peak_degree(hour, road_class)
    low, mid, high = trapezoid(density, 0, 0, 5, 15), trapezoid(density, 10, 20, 35, 50), trapezoid(density, 35, 50, 300, 500)
    light, heavy = trapezoid(rain, 0, 0, 2, 5), trapezoid(rain, 2, 5, 50, 100)
    return (
        F.greatest(F.least(1 - p, low), F.least(1 - p, mid)),
        F.greatest(F.least(p, mid), F.least(1 - p, high), F.least(p, low)),
        F.greatest(F.least(p, high, heavy), F.least(p, high, light), F.least(p, high, 1 - heavy), F.least(1 - p, high, heavy)),
    )


def centroid(low: Column, mid: Column, high: Column) -> Column:
    """Over 0, 5 .. 100; 0 where nothing holds."""
    state = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))

    def add(s, i):
        x = i.cast("double")
        mu = F.greatest(F.least(trapezoid(x, -20, 0, 20, 40), low), F.least(trapezoid(x, 20, 40, 60, 80), mid), F.least(trapezoid(x, 60, 80, 100, 120), high))
        return F.struct((s["num"] + x * mu).alias("num"), (s["den"] + mu).alias("den"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(100), F.lit(5)), state, add, lambda s: F.when(s["den"] == 0, 0.0).otherwise(s["num"] / s["den"]))


def level(score: Column) -> Column:
    return F.when(score > 70, "high").when(score > 30, "medium").otherwise("low")


def road_class(ref: Column, classes: Column, name: Column) -> Column:
    """From the road's number, else its classes, else its name; named town roads are secondary."""
    r, n = F.upper(F.coalesce(ref, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    any_of = lambda *c: F.coalesce(F.arrays_overlap(classes, F.array(*[F.lit(x) for x in c])), F.lit(False))
    part = lambda c, *terms: F.greatest(*[F.contains(c, F.lit(t)) for t in terms])
    return (
        F.when(part(r, "QL", "AH"), "primary").when(part(r, "ĐT", "DT"), "secondary")
        .when(any_of("motorway", "trunk", "primary"), "primary").when(any_of("secondary", "tertiary"), "secondary").when(any_of("residential", "service"), "residential")
        .when(part(n, "đại lộ", "quốc lộ", "cầu", "hầm chui"), "primary").otherwise("secondary")
    )


#: Words of a turn restriction, in the order in which they are looked for: fixed values.
TURNS = {"no_right_turn": ("quẹo phải", "rẽ phải"), "no_left_turn": ("quẹo trái", "rẽ trái"), "no_u_turn": ("quay đầu",), "no_straight": ("đi thẳng",)}


def turn_type(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(F.contains(t, F.lit(w)), F.lit(kind)) for kind, words in TURNS.items() for w in words], F.lit("unknown"))


def time_ranges(c: Column) -> Column:
    """Ranges of a time rule in minutes; parts are split by commas or AND, and the first range of a part counts."""
    at = lambda p, i: F.regexp_extract(p, "([0-9]{1,2}):([0-9]{2})\\s*-\\s*([0-9]{1,2}):([0-9]{2})", i).try_cast("int")
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)and", ","), ",")
    return F.filter(F.transform(parts, lambda p: F.struct((at(p, 1) * 60 + at(p, 2)).alias("start"), (at(p, 3) * 60 + at(p, 4)).alias("end"))), lambda r: r["start"].isNotNull())


def time_restricted(c: Column, minute: Column) -> Column:
    """Both ends belong to a range; ranges don't go past midnight."""
    return F.exists(time_ranges(c), lambda r: (minute >= r["start"]) & (minute <= r["end"]))


#: Words for turns and steps of a route: fixed values.
MODIFIERS = {
    "left": "rẽ trái", "right": "rẽ phải", "slight left": "rẽ nhẹ sang trái", "slight right": "rẽ nhẹ sang phải", "sharp left": "rẽ gấp sang trái", "sharp right": "rẽ gấp sang phải",
    "straight": "đi thẳng", "uturn": "quay đầu",
}
STEPS = {
    "depart": "Xuất phát trên {road}", "arrive": "Đến nơi - {road}", "turn": "{turn} vào {road}", "new name": "Tiếp tục trên {road}", "merge": "Nhập vào {road}", "fork": "{fork} vào {road}",
    "roundabout": "Đi qua vòng xuyến, ra {road}", "end of road": "Cuối đường, {end} vào {road}", "continue": "Tiếp tục trên {road}",
}


def instruction(kind: Column, modifier: Column, road: Column, metres: Column) -> Column:
    """A step in words, with its kilometres."""
    words = F.try_element_at(F.create_map(*[F.lit(x) for kv in MODIFIERS.items() for x in kv]), F.coalesce(modifier, F.lit("")))
    named = F.coalesce(F.nullif(road, F.lit("")), F.lit("đường không tên"))
    slots = {"road": named, "turn": F.coalesce(words, modifier, F.lit("")), "fork": F.coalesce(words, F.lit("rẽ")), "end": F.coalesce(words, F.lit(""))}
    text = F.concat(F.coalesce(words, kind, F.lit("")), F.lit(" trên "), named)
    for name, template in STEPS.items():
        parts = [slots[p] if i % 2 else F.lit(p) for i, p in enumerate(template.replace("}", "{").split("{"))]
        text = F.when(kind == name, F.concat(*parts)).otherwise(text)
    return F.concat(text, F.format_string(" (%.1f km)", F.floor(metres / 100.0 + 0.5) / 10.0))


#: Peak hours by how busy a road is: fixed values.
PROFILES = {"High": (11.5, 13.5, 17.5, 22.0), "Medium": (7.0, 9.5, 16.5, 19.5), "Low": (6.5, 8.5, 16.0, 18.0)}


def density_level(name: Column) -> Column:
    """From the sum of the name's code points modulo 50. A character's UTF-32 bytes are its code point."""
    codes = F.transform(F.split(name, ""), lambda ch: F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int"))
    n = F.aggregate(codes, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 50
    return F.when(n > 35, "High").when(n > 15, "Medium").otherwise("Low")
