"""Public views of places, explicit preferences, feedback, and road facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rules as X
from ..operators import serializers as Z
from ..sources.tables import PLACES_SQL, places, table
from . import discovery
from . import sqltext as Q


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _pick_sql(values, i: str) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({i} % {len(values)} + 1)::int]"


def place_public_view(spark, sf):
    """Statuses, warnings and identifiers of each place; every third has no address, every fourth no hours."""
    i = F.col("poi_id")
    p = places(spark, sf).withColumn("address", F.when(i % 3 > 0, F.col("district")).otherwise("")).withColumn("hours", F.when(i % 4 > 0, "06:00 - 21:00"))
    ids = F.array(F.concat(F.lit("google:"), i.cast("string")), F.concat(F.lit(":"), i.cast("string")), F.lit(" "), F.concat(F.lit("google:"), i.cast("string")))
    found = Z.source_identifiers(ids, i.cast("string"), F.when(i % 2 == 0, F.col("source")))
    return p.select("poi_id", Z.known_status(F.col("rating")).alias("rating_status"), Z.known_status(F.col("address")).alias("address_status"), F.array_join(Z.place_warnings(F.col("address"), F.col("hours"), F.col("rating"), F.col("review_count")), ",").alias("warnings"), F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["namespace"], x["value"], x["source"])), ",").alias("identifiers"))


PUBLIC_SQL = f"""with {PLACES_SQL}, p as (select *, case when poi_id % 3 > 0 then district else '' end as address, case when poi_id % 2 = 0 then '|' || source else '' end as src from poi)
select poi_id, case when rating is null then 'unknown' else 'known' end as rating_status, case when address = '' then 'unknown' else 'known' end as address_status,
 concat_ws(',', case when address = '' then 'address_unknown' end, case when poi_id % 4 = 0 then 'opening_hours_unknown' end, 'freshness_unknown', case when rating is null then 'rating_unknown' end, case when review_count is null then 'review_count_unknown' end) as warnings,
 'google|' || poi_id || case when poi_id % 2 = 0 then src else '|google' end || ',restaurant_id|:' || poi_id || src || ',restaurant_id|' || poi_id || src as identifiers from p"""


def reason_codes(spark, sf):
    d = discovery.recommend(spark, sf)
    codes = Z.reason_codes(F.lit(True), *[C.rounded(F.col(c)) for c in ("s_category", "s_keyword", "s_preference", "s_rating", "s_review", "s_distance", "distance_km")])
    return d.select("poi_id", F.array_join(codes, ",").alias("reasons"))


_r = Q.r
REASONS_SQL = f"""with {discovery.RECOMMEND_CTE} select poi_id, concat_ws(',', 'intent_match', case when {_r('s_category')} >= 0.3e0 then 'category_match' end, case when {_r('s_keyword')} > 0 then 'query_text_match' end, case when {_r('s_preference')} >= 0.45e0 then 'preference_match' end,
 case when {_r('s_rating')} >= 0.75e0 then 'rating_signal' end, case when {_r('s_review')} > 0 then 'review_signal' end, case when {_r(Q.clamp01('1e0 - distance_km / 14e0'))} >= 0.7e0 then 'distance_fit' end) as reasons from scored"""

LIKES = {"liked_categories": (3, ["cafe", " seafood ", "", "pub"]), "liked_tags": (5, ["cafe", "quiet", "beach"]), "disliked_categories": (7, ["pub", "", "museum"]), "disliked_tags": (11, ["loud", "pub"]), "negative_filters": (13, ["crowded", "loud", " "])}


def explicit_preferences(spark, sf):
    """Weights of what customers state: of each key the largest."""
    k = F.col("c_custkey")
    lists = {n: F.array(_pick(v, k), _pick(v, F.floor(k / step))) for n, (step, v) in LIKES.items()}
    return Z.preference_weights(table(spark, sf, "customer").select(k.alias("user_id"), *[c.alias(n) for n, c in lists.items()]))


PREFERENCES_SQL = (
    "with s as ("
    + " union all ".join(f"select c_custkey as user_id, '{Z.PREFERENCE_WEIGHTS[n][0]}' as sign, trim(unnest([{_pick_sql(v, 'c_custkey')}, {_pick_sql(v, f'(c_custkey // {step})')}])) as key, {Z.PREFERENCE_WEIGHTS[n][1]}e0 as weight from customer" for n, (step, v) in LIKES.items())
    + ") select user_id, sign, key, max(weight) as weight from s where key <> '' group by 1, 2, 3"
)
LOWS, HIGHS, BUDGETS, MOVES = ["30000", None, "x", "200000", "0"], ["100000", "90000", None, "50"], ["low", "none", None, "high"], ["car", "plane", "walking", "grab"]


def preference_defaults(spark, sf):
    k = F.col("c_custkey")
    p = Z.price_range(_pick(LOWS, k), _pick(HIGHS, F.floor(k / 5)))
    return table(spark, sf, "customer").select(k.alias("user_id"), p.alias("p"), Z.budget_level(_pick(BUDGETS, k)).alias("budget"), F.array_join(Z.mobility(F.array(_pick(MOVES, k), _pick(MOVES, F.floor(k / 3)))), ",").alias("mobility")).select("user_id", F.col("p.min").alias("min_price"), F.col("p.max").alias("max_price"), "budget", "mobility")


DEFAULTS_SQL = f"""with a as (select c_custkey as user_id, coalesce(nullif(try_cast({_pick_sql(LOWS, 'c_custkey')} as double), 0), 20000e0) as lo, coalesce(nullif(try_cast({_pick_sql(HIGHS, '(c_custkey // 5)')} as double), 0), 150000e0) as hi,
 {_pick_sql(BUDGETS, 'c_custkey')} as b, {_pick_sql(MOVES, 'c_custkey')} as m1, {_pick_sql(MOVES, '(c_custkey // 3)')} as m2 from customer)
select user_id, lo as min_price, greatest(lo, hi) as max_price, case when b in ('low', 'medium', 'high') then b else 'medium' end as budget,
 case when m1 = 'plane' and m2 = 'plane' then 'motorbike' when m1 = m2 or m2 = 'plane' then m1 when m1 = 'plane' then m2 else m1 || ',' || m2 end as mobility from a"""
ROLE_VALUES, EVENT_VALUES = ["traveler", "seller", "robot", None, "admin"], ["poi_useful", "agent_run_business_insight", "", None, " custom ", "like", "route_opened", "y" * 90]


def feedback_sanitize(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", Z.feedback_role(_pick(ROLE_VALUES, i)).alias("role"), Z.feedback_event(_pick(EVENT_VALUES, i)).alias("event"))
    return e.withColumn("label", Z.feedback_label(F.col("event")).cast("long"))


FEEDBACK_SQL = f"""with e as (select event_id, {_pick_sql(ROLE_VALUES, 'event_id')} as r, coalesce(nullif({_pick_sql(EVENT_VALUES, 'event_id')}, ''), 'unknown') as t from events)
select event_id, case when r in ('customer', 'seller', 'admin') then r else 'customer' end as role, case t when 'agent_run_business_insight' then 'business_insight_run' else trim(t)[1:80] end as event,
 case when trim(t) in ('like', 'add_to_itinerary', 'route_opened', 'booking_intent') then 1::bigint end as label from e"""

REFS, CLASSES, NAMES = ["QL1A", "đt602", None, "", "AH17"], ["primary", "tertiary", "service", "path"], ["Đường Lê Duẩn", "Cầu Rồng", "Đại lộ Võ Chí Công", "Trần Phú", ""]
TURN_TEXTS, RULE_TEXTS = ["Cấm quẹo phải", "cấm rẽ trái", "Cấm quay đầu", "Cấm đi thẳng", "Chỉ được rẽ phải", "khác"], ["06:00-08:00 AND 16:30 - 18:00", "7:00-9:00, 17:00-19:00", "", None, "22:00-02:00", "soon"]
KINDS, MODS = ["depart", "arrive", "turn", "new name", "merge", "fork", "roundabout", "end of road", "continue", "ferry"], ["left", "sharp right", "uturn", "around"]


def road_facts(spark, sf):
    """Road class, turn type, time rule, instruction and density of route steps, a view over the events."""
    i, v = F.col("event_id"), F.col("value")
    e = table(spark, sf, "events").select("event_id", (F.hour("ts") * 60 + F.minute("ts")).alias("at"), F.floor(v * 10).alias("metres"), _pick(REFS, i).alias("ref"), F.array(_pick(CLASSES, F.floor(i / 5))).alias("classes"), _pick(NAMES, F.floor(i / 7)).alias("name"), _pick(TURN_TEXTS, i).alias("turn"), _pick(RULE_TEXTS, F.floor(i / 3)).alias("rule"), _pick(KINDS, F.floor(i / 2)).alias("kind"), _pick(MODS, F.floor(i / 11)).alias("mod"))
    return e.select("event_id", X.road_class(F.col("ref"), F.col("classes"), F.col("name")).alias("road_class"), X.turn_type(F.col("turn")).alias("turn_type"), X.time_restricted(F.col("rule"), F.col("at")).alias("restricted"), X.instruction(F.col("kind"), F.col("mod"), F.col("name"), F.col("metres")).alias("instruction"), X.density_level(F.col("name")).alias("density"))


_cases = " ".join("when '" + k + "' then " + "'" + t.replace("{road}", "' || n || '").replace("{turn}", "' || coalesce(w, mod) || '").replace("{fork}", "' || coalesce(w, 'rẽ') || '").replace("{end}", "' || coalesce(w, '') || '") + "'" for k, t in X.STEPS.items())
_words = "case mod " + " ".join(f"when '{k}' then '{v}'" for k, v in X.MODIFIERS.items()) + " end"
ROAD_SQL = f"""with e as (select event_id, hour(ts) * 60 + minute(ts) as t, floor(value * 10) as metres, upper(coalesce({_pick_sql(REFS, 'event_id')}, '')) as ref, {_pick_sql(CLASSES, '(event_id // 5)')} as cls, {_pick_sql(NAMES, '(event_id // 7)')} as name,
 event_id % 6 as turn, (event_id // 3) % 6 as rule, {_pick_sql(KINDS, '(event_id // 2)')} as kind, {_pick_sql(MODS, '(event_id // 11)')} as mod from events),
f as (select *, {_words} as w, coalesce(nullif(name, ''), 'đường không tên') as n, list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) % 50 as d from e)
select event_id, case when contains(ref, 'QL') or contains(ref, 'AH') then 'primary' when contains(ref, 'ĐT') then 'secondary' when cls = 'primary' then 'primary' when cls = 'tertiary' then 'secondary' when cls = 'service' then 'residential'
 when contains(lower(name), 'cầu') or contains(lower(name), 'đại lộ') then 'primary' else 'secondary' end as road_class,
 ['no_right_turn', 'no_left_turn', 'no_u_turn', 'no_straight', 'no_right_turn', 'unknown'][turn + 1] as turn_type,
 case rule when 0 then t between 360 and 480 or t between 990 and 1080 when 1 then t between 420 and 540 or t between 1020 and 1140 else false end as restricted,
 case kind {_cases} else coalesce(w, kind) || ' trên ' || n end || printf(' (%.1f km)', floor(metres / 100e0 + 0.5) / 10e0) as instruction,
 case when name = '' then 'Low' when d > 35 then 'High' when d > 15 then 'Medium' else 'Low' end as density from f"""

QUERIES = {f.__name__: f for f in (place_public_view, reason_codes, explicit_preferences, preference_defaults, feedback_sanitize, road_facts)}
ORACLE_SQL = {"place_public_view": PUBLIC_SQL, "reason_codes": REASONS_SQL, "explicit_preferences": PREFERENCES_SQL, "preference_defaults": DEFAULTS_SQL, "feedback_sanitize": FEEDBACK_SQL, "road_facts": ROAD_SQL}
