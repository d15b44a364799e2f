"""Public views of places and profiles: statuses, warnings, reasons, identifiers, explicit preferences, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of events, languages of budgets and ways to move, weights of explicit preferences.
EVENT_ALIASES = {"agent_run_business_insight": "business_insight_run"}
ROLES = {"traveler": "customer", "customer": "customer", "seller": "seller", "admin": "admin"}
BUDGET_LEVELS = ("low", "medium", "high")
MOBILITY = ("walking", "motorbike", "car", "grab")
PREFERENCE_WEIGHTS = {"liked_categories": ("affinity", 1.0), "liked_tags": ("affinity", 0.75), "disliked_categories": ("penalty", 1.0), "disliked_tags": ("penalty", 0.9), "negative_filters": ("penalty", 1.0)}
LIKED_EVENTS = ("like", "add_to_itinerary", "route_opened", "booking_intent")


def known_status(c: Column) -> Column:
    return F.when(c.isNull() | (c.cast("string") == ""), "unknown").otherwise("known")


def quality_status(count: Column) -> Column:
    return F.when(count.isNull(), "unknown").when(count > 0, "known_gap").otherwise("known")


def flags(**named: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def place_warnings(address: Column, hours: Column, rating: Column, reviews: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return flags(address_unknown=empty(address), opening_hours_unknown=empty(hours), freshness_unknown=F.lit(True), rating_unknown=rating.isNull(), review_count_unknown=reviews.isNull())


def reason_codes(has_intent: Column, category: Column, text: Column, preference: Column, rating: Column, review: Column, distance: Column, km: Column) -> Column:
    codes = flags(
        intent_match=has_intent | (category >= 0.3), category_match=category >= 0.3, query_text_match=text > 0, preference_match=preference >= 0.45,
        rating_signal=rating >= 0.75, review_signal=review > 0, distance_fit=distance >= 0.7, distance_unknown=km.isNull(),
    )
    return F.when(F.size(codes) == 0, F.array(F.lit("canonical_dataset_match"))).otherwise(codes)


def source_identifier(value: Column, source: Column) -> Column:
    """namespace, value, source of `namespace:value`; without a name before the colon it's a restaurant id."""
    t = F.trim(F.coalesce(value, F.lit("")))
    at = F.instr(t, ":")
    named = at > 1
    namespace = F.when(named, F.substring_index(t, ":", 1)).otherwise("restaurant_id")
    rest = F.when(named, F.substr(t, at + 1)).otherwise(t)
    given = F.when(source != "", source)
    return F.when(t != "", F.struct(namespace.alias("namespace"), rest.alias("value"), F.when(named, F.coalesce(given, namespace)).otherwise(given).alias("source")))


def source_identifiers(values: Column, own: Column, source: Column) -> Column:
    every = F.concat(F.coalesce(values, F.array().cast("array<string>")), F.array(own))
    return F.array_distinct(F.array_compact(F.transform(every, lambda v: source_identifier(v, source))))


def clean_array(c: Column) -> Column:
    """Trimmed, without empty items, 160 characters each, 40 at most."""
    return F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, 160)), lambda x: x != ""), 1, 40)


def price_range(low: Column, high: Column) -> Column:
    """Defaults of 20,000 and 150,000 for what is missing or no number; the upper end is no less than the lower."""
    value = lambda c, d: F.coalesce(F.nullif(c.try_cast("double"), F.lit(0.0)), F.lit(d))
    least = F.greatest(F.lit(0.0), value(low, 20000.0))
    return F.struct(least.alias("min"), F.greatest(least, value(high, 150000.0)).alias("max"))


def budget_level(c: Column) -> Column:
    return F.when(c.isin(*BUDGET_LEVELS), c).otherwise("medium")


def mobility(c: Column) -> Column:
    found = F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isin(*MOBILITY)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("motorbike")))


def preference_weights(df: DataFrame, user: str = "user_id") -> DataFrame:
    """user, sign, key, weight: the largest weight of each key. df has the columns of PREFERENCE_WEIGHTS, each a list."""
    weighted = lambda c, sign, w: F.transform(clean_array(F.col(c)), lambda x: F.struct(F.lit(sign).alias("sign"), x.alias("key"), F.lit(w).alias("weight")))
    items = [weighted(c, sign, w) for c, (sign, w) in PREFERENCE_WEIGHTS.items()]
    return df.select(user, F.inline(F.concat(*items))).groupBy(user, "sign", "key").agg(F.max("weight").alias("weight"))


def feedback_role(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), c), F.lit("customer"))


def feedback_event(c: Column) -> Column:
    name = F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_ALIASES.items() for x in kv]), name), F.substring(F.trim(name), 1, 80))


def feedback_label(c: Column) -> Column:
    return F.when(c.isin(*LIKED_EVENTS), 1)


def polygon_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    pair = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = [pair(west, south), pair(east, south), pair(east, north), pair(west, north), pair(west, south)]
    return F.concat(F.lit("POLYGON(( "), F.concat_ws(", ", *ring), F.lit(" ))"))


def semantic_text(*parts: Column, limit: int = 1200) -> Column:
    return F.substring(F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]), 1, limit)

