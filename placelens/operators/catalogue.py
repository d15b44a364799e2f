"""Raw catalogue rows to places with their issues, the quality report, road densities, profile fallback and itineraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import clean_string, image_urls, normalize_text, optional_number, parse_list, valid_coordinate

#: The default city and its box (west, south, east, north): fixed values.
CITY, BOX = "da-nang", (107.8, 15.8, 108.5, 16.3)
#: Number columns of a place by their raw names.
NUMBERS = {
    "Overall Rating": "rating", "Rating_Scale": "rating_scale", "Rating_Count": "rating_count", "Review_Sample_Count": "review_sample_count", "Google_Rating": "google_rating",
    "Google_Rating_Count": "google_rating_count", "Foody_Rating_10": "foody_rating_10", "Foody_Review_Sample_Count": "foody_review_sample_count", "Price_Min_VND": "price_min_vnd",
    "Price_Max_VND": "price_max_vnd",
}
#: Text columns of a place by their raw names; empty ones are null.
TEXTS = {
    "RestaurantID": "source_id", "Category_Normalized": "category_normalized", "Admin_Normalization_Status": "admin_status", "Address_Raw": "address_raw", "Address_Current": "address_current",
    "Primary_Rating_Source": "primary_rating_source", "Price": "price", "Opening_Hours_Raw": "opening_hours", "Merge_Status": "merge_status",
}
LISTS = {"Source_IDs": "source_ids", "Alias_Global_IDs": "alias_ids", "Data_Quality_Flags": "quality_flags"}


def normalize_places(raw: DataFrame) -> DataFrame:
    """raw: the canonical text columns. Each row as a place, with valid (fit for use) and issues (all that is wrong with it, in a fixed order)."""
    text = lambda c: clean_string(F.col(f"`{c}`"))
    blank = lambda c: F.nullif(c, F.lit(""))
    d = raw.select(
        text("Global_ID").alias("poi_id"), text("City_ID").alias("city_id"), F.lower(text("Entity_Type")).alias("entity_type"), text("Restaurant Name").alias("name"),
        optional_number(F.col("Lat")).alias("lat"), optional_number(F.col("Lon")).alias("lon"), text("Category").alias("raw_category"), text("District").alias("district"),
        text("District_Raw").alias("district_raw"), text("Source").alias("source"), text("LLM_Input_Text").alias("text"), image_urls(F.col("Image_URL")).alias("image_urls"),
        *[optional_number(F.col(f"`{a}`")).alias(b) for a, b in NUMBERS.items()], *[blank(text(a)).alias(b) for a, b in TEXTS.items()],
        *[parse_list(F.col(a)).alias(b) for a, b in LISTS.items()],
    )
    placed = valid_coordinate(F.col("lat"), F.col("lon"))
    west, south, east, north = BOX
    outside = placed & (F.col("city_id") == CITY) & ~(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    found = {
        "non_poi_entity_type": F.col("entity_type") != "poi", "missing_global_id": F.col("poi_id") == "", "missing_city_id": F.col("city_id") == "", "missing_name": F.col("name") == "",
        "invalid_coordinates": ~placed, "outside_da_nang_bbox": outside,
    }
    issues = F.array_compact(F.array(*[F.when(c, name) for name, c in found.items()]))
    d = d.withColumn("issues", issues).withColumn("valid", F.size(F.array_except("issues", F.array(F.lit("outside_da_nang_bbox")))) == 0)
    folded = normalize_text(F.concat_ws(" ", "name", "raw_category", "category_normalized", "district", "address_current", "address_raw", "text"))
    return d.select(
        "*", F.coalesce(blank(F.col("raw_category")), "category_normalized", F.lit("unknown")).alias("category"), F.coalesce("address_current", "address_raw", F.lit("")).alias("address"),
        F.when(outside, "outside_city_bbox").when(placed, "valid").otherwise("invalid").alias("coordinate_status"), F.get("image_urls", F.lit(0)).alias("image_url"), folded.alias("folded"),
    )


def city_places(rows: DataFrame, city: str = CITY) -> DataFrame:
    """The usable places of a city."""
    return rows.where(F.col("valid") & (F.col("city_id") == city))


def by_id(rows: DataFrame, place: str, city: str | None = None) -> DataFrame:
    return rows.where((F.col("poi_id") == place) & (F.lit(True) if city is None else F.col("city_id") == city))


def collection(df: DataFrame, equal: dict, limit: int, cap: int, order: list[Column] | None = None) -> DataFrame:
    """Rows whose columns equal the values, `limit` of them and `cap` at most (the feature is the limit); in an order if there is one."""
    for c, v in equal.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return (df.orderBy(*order) if order else df).limit(min(limit, cap))


def stale(profiles: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Profiles that were updated longer ago than that, or never."""
    return profiles.where(F.col("updated_at").isNull() | (F.col("updated_at") < now - F.expr(f"interval {hours} hours")))


def quality_report(rows: DataFrame) -> DataFrame:
    """The report's sixteen counters over normalised rows, in one pass (distinct ids and aliases in their own)."""
    has = lambda name: F.array_contains("issues", name)
    count = F.count_if
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(34).cast("long").alias("n_columns"), count(F.col("valid")).alias("application_pois"), count(F.col("entity_type") == "urban_void").alias("excluded_urban_void"),
        count(~F.col("valid")).alias("invalid_rows"), F.countDistinct(F.nullif("poi_id", F.lit(""))).alias("unique_ids"),
        (F.count(F.nullif("poi_id", F.lit(""))) - F.countDistinct(F.nullif("poi_id", F.lit("")))).alias("duplicate_id_rows"), count(has("missing_name")).alias("missing_name"),
        count(has("missing_city_id")).alias("missing_city_id"), count(F.col("lat").isNull() | F.col("lon").isNull()).alias("missing_coordinates"),
        count(has("invalid_coordinates")).alias("invalid_coordinates"), count(has("outside_da_nang_bbox")).alias("outside_box"), count(F.col("address") == "").alias("missing_address"),
        count(F.col("rating").isNull()).alias("missing_rating"), count(F.col("rating_count").isNull()).alias("missing_review_count"),
    )
    aliases = rows.select(F.explode("alias_ids").alias("a")).agg(F.countDistinct("a").alias("alias_ids"))
    return totals.crossJoin(F.broadcast(aliases))  # one row each


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Usable places that share their source ids: source_key, poi_ids."""
    key = F.coalesce(F.nullif(F.array_join("source_ids", "|"), F.lit("")), "source_id")
    groups = rows.where("valid").withColumn("source_key", key).where("source_key is not null").groupBy("source_key")
    return groups.agg(F.sort_array(F.collect_list("poi_id")).alias("poi_ids")).where(F.size("poi_ids") > 1)


def address_road(address: Column) -> Column:
    """The road of an address: its first part without the house number; null if no more than two characters are left."""
    part = F.trim(F.split_part(F.trim(F.regexp_replace(address, '"', "")), F.lit(","), F.lit(1)))
    name = F.trim(F.regexp_replace(F.regexp_replace(part, r"^(Số\s+)?(\d+[A-Za-z/]*\s+)?", ""), r"^(K\d+[/\d]*\s+)?", ""))
    return F.when(F.length(name) > 2, name)


def road_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"^(?:Đường|đường|[Dd][Uu][Oo][Nn][Gg])\s+", ""))


def road_density(addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """segments: segment, road. n: places on the road of that name, else on the first road (in order of first_seen) one of whose names is part of the other, else 0. addresses: address, first_seen."""
    roads = addresses.select(road_key(address_road(F.col("address"))).alias("key"), "first_seen").where("key is not null")
    counts = roads.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("first_seen").alias("seen"))
    names = segments.select(road_key(F.col("road")).alias("target")).where("target <> ''").distinct()
    exact = names.join(counts, names["target"] == counts["key"]).select("target", "n")
    # Only names without an equal meet all roads: distinct names on both sides.
    rest = names.join(exact.select("target"), "target", "left_anti").join(counts, F.contains("key", "target") | F.contains("target", "key"))
    fuzzy = rest.groupBy("target").agg(F.min_by("n", "seen").alias("n"))
    found = exact.unionByName(fuzzy)
    return segments.withColumn("target", road_key(F.col("road"))).join(found, "target", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_profiles(requests: DataFrame, profiles: DataFrame, fallback: str = "global") -> DataFrame:
    """requests: request, and user_id, persona_id, session_id, the first of which that isn't empty is the key. The profile of that key, else the fallback's. profiles: profile, value."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("user_id", "persona_id", "session_id")], F.lit(fallback))
    own = requests.withColumn("key", key).join(profiles, F.col("key") == F.col("profile"), "left")
    other = profiles.where(F.col("profile") == fallback).select(F.col("profile").alias("f_profile"), F.col("value").alias("f_value"))
    joined = own.join(F.broadcast(other), F.lit(True), "left")  # one row
    return joined.select("request", F.coalesce("profile", "f_profile").alias("profile"), F.coalesce("value", "f_value").alias("value"))


#: What a text about food or drink holds: fixed values.
SEMANTIC = (
    r"\bcafe\b|\bcoffee\b|ca phe|dessert|tra sua|nha hang|restaurant|quan an|an vat|via he|quan nhau|bia|beer|hai san|lau|nuong"
)


def text_strength(text: Column) -> Column:
    folded = normalize_text(text)
    return F.when(folded.rlike(SEMANTIC), 1.0).when(F.trim(folded) != "", 0.35).otherwise(0.0)


def distance_bias(d: DataFrame, distance: str, scale: float = 1.0) -> DataFrame:
    """Adds bias: log((1 + max^1.5) / (1 + d^1.5)) times scale, with the largest distance of all rows."""
    most = d.agg(F.max(distance).alias("__most"))
    return d.crossJoin(F.broadcast(most)).withColumn("bias", F.log((1 + F.pow("__most", F.lit(1.5))) / (1 + F.pow(distance, F.lit(1.5)))) * scale).drop("__most")  # one row


def overlap(must: Column, exclude: Column) -> Column:
    """What a request both demands and excludes."""
    return F.array_intersect(must, exclude)


def history(new: Column, old: Column, most: int = 30) -> Column:
    """Distinct concepts, the newest first."""
    return F.slice(F.array_distinct(F.concat(F.array(new), F.coalesce(old, F.array().cast("array<string>")))), 1, most)


def location(row: dict[str, list[Column]]) -> Column:
    """lat and lon from the first of their names that has a value; null unless both are in range."""
    lat, lon = (F.coalesce(*[c.cast("double") for c in row[k]]) for k in ("lat", "lon"))
    return F.when(valid_coordinate(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


#: Most minutes of a plan and its number of stops: fixed values. Longer plans have five.
STOP_CAPS = ((120, 2), (210, 3), (330, 4))


def stop_limit(minutes: int | None, limit: int) -> int:
    if not minutes or minutes <= 0:
        return limit
    return min(limit, next((n for most, n in STOP_CAPS if minutes <= most), 5))


def stay_minutes(last: Column, minutes: int | None) -> Column:
    short, long = (35, 45) if minutes and minutes <= 120 else (45, 60) if minutes and minutes <= 210 else (55, 75)
    return F.when(last, long).otherwise(short)


def pick_by_intent(results: DataFrame, matches: list[str], limit: int) -> DataFrame:
    """results: poi_id, score, rank and a match column for each intent, a short ranked list. For each intent in turn its best result that isn't taken yet, if it matches by 0.7; then the others by rank."""
    order = lambda c: F.struct(F.col(c), F.col("score"), -F.col("rank"))
    taken, rest = None, results
    for i, c in enumerate(matches[: max(1, limit)]):
        best = rest.where(F.col(c) >= 0.7).agg(F.max_by("poi_id", order(c)).alias("poi_id")).where("poi_id is not null").withColumn("pick", F.lit(i))
        taken = best if taken is None else taken.unionByName(best)
        rest = rest.join(F.broadcast(best.select("poi_id")), "poi_id", "left_anti")
    if taken is None:
        picked = results.withColumn("pick", F.lit(len(matches)))
    else:
        picked = results.join(F.broadcast(taken), "poi_id", "left").withColumn("pick", F.coalesce("pick", F.lit(len(matches))))
    return picked.orderBy("pick", "rank").limit(limit)


def plan_itinerary(results: DataFrame, matches: list[str], limit: int, start: tuple[float, float] | None, mode: str, minutes: int | None) -> DataFrame:
    """The picked stops in order of their distance from the start (without one, of their score), with legs and stays, and the plan's totals on each row."""
    limit = stop_limit(minutes, limit)
    d = pick_by_intent(results, matches, limit)
    from_start = C.haversine_km(F.lit(start[0]), F.lit(start[1]), F.col("lat"), F.col("lon")) if start else F.lit(0.0)
    by = Window.orderBy(from_start, F.desc("score"), "rank")  # at most `limit` rows
    first = [F.lit(x) for x in start] if start else [F.lit(None).cast("double")] * 2
    before = [F.lag(c).over(by) for c in ("lat", "lon")]
    d = d.withColumn("n", F.row_number().over(by)).withColumn("before_lat", before[0]).withColumn("before_lon", before[1]).withColumn("stops", F.count(F.lit(1)).over(Window.partitionBy()))
    lat, lon = (F.when(F.col("n") == 1, x).otherwise(F.col(c)) for x, c in zip(first, ("before_lat", "before_lon"), strict=True))
    d = d.withColumn("km", C.haversine_km(lat, lon, F.col("lat"), F.col("lon"))).withColumn("travel", C.matrix_minutes(F.col("km"), mode).cast("long"))
    d = d.withColumn("stay", stay_minutes(F.col("n") == F.col("stops"), minutes).cast("long"))
    whole = Window.partitionBy()
    travel, stay = (F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"total_{c}") for c in ("travel", "stay"))
    return d.select(F.col("n").cast("long").alias("stop"), "poi_id", C.rounded(F.col("km"), 2).alias("km"), "travel", "stay", travel, stay)


def renumbered(stops: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """stops: trip_id, position, poi_id. Without the removed and with the added stops behind them, numbered from 1 in each trip."""
    kept = stops.join(removed, ["trip_id", "poi_id"], "left_anti").withColumn("later", F.lit(0)).unionByName(added.withColumn("later", F.lit(1)))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("trip_id").orderBy("later", "position", "poi_id"))).drop("later")
