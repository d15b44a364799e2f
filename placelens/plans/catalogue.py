"""Catalogue queries: raw rows over the test tables, their issues and report, densities, fallbacks and itineraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalogue as K
from ..operators import scoring as S
from ..sources.tables import CANONICAL_COLUMNS, PLACES_SQL, places, profile_events, table
from . import sqltext as Q

#: The odd rows of the raw catalogue, by the customer's key.
ODD_SQL = """raw as (select c_custkey as k,
  case when c_custkey % 31 = 0 then ' NaN ' when c_custkey % 37 = 0 then 'poi_1' else ' poi_' || c_custkey end as global_id,
  case when c_custkey % 5 = 0 then 'P1|P2; ' || (c_custkey % 40) else '' end as aliases, case when c_custkey % 41 = 0 then '' when c_custkey % 3 = 0 then 'hue' else 'da-nang' end as city,
  case when c_custkey % 13 = 0 then 'Urban_Void' else ' POI' end as entity, case when c_custkey % 29 = 0 then 'null' else c_name end as name,
  case when c_custkey % 23 = 0 then null when c_custkey % 19 = 0 then '95,5' else ((1570 + c_custkey % 70) / 100.0)::varchar end as lat,
  case when c_custkey % 23 = 1 then 'x' else ((10790 + c_custkey % 70) / 100.0)::varchar end as lon, case when c_custkey % 4 = 0 then '' else c_mktsegment end as category,
  case when c_custkey % 7 = 0 then (c_custkey % 9) || ' Lê Lợi, ' || c_mktsegment when c_custkey % 7 = 1 then 'Số ' || c_custkey || ' Trần Phú' else '' end as address,
  case when c_acctbal >= 0 then c_acctbal::varchar || ' pt' else 'n/a' end as rating from customer)"""


def raw_catalogue(spark, sf):
    """Customers as rows of the canonical file: all columns as text, with rows that have something wrong."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    mod = lambda n, r=0: k % n == r
    part = lambda base: (F.lit(base) + (k % 70) / 100.0).cast("decimal(10,2)").cast("string")
    made = {
        "Global_ID": F.when(mod(31), " NaN ").when(mod(37), "poi_1").otherwise(F.concat(F.lit(" poi_"), key)),
        "Alias_Global_IDs": F.when(mod(5), F.concat(F.lit("P1|P2; "), (k % 40).cast("string"))).otherwise(""),
        "City_ID": F.when(mod(41), "").when(mod(3), "hue").otherwise("da-nang"), "Entity_Type": F.when(mod(13), "Urban_Void").otherwise(" POI"),
        "Restaurant Name": F.when(mod(29), "null").otherwise(F.col("c_name")), "Lat": F.when(mod(23), None).when(mod(19), "95,5").otherwise(part(15.7)),
        "Lon": F.when(mod(23, 1), "x").otherwise(part(107.9)), "Category": F.when(mod(4), "").otherwise(F.col("c_mktsegment")), "Category_Normalized": F.lower("c_mktsegment"),
        "Address_Current": F.when(mod(7), F.concat((k % 9).cast("string"), F.lit(" Lê Lợi, "), F.col("c_mktsegment"))).when(mod(7, 1), F.concat(F.lit("Số "), key, F.lit(" Trần Phú"))).otherwise(""),
        "Overall Rating": F.when(F.col("c_acctbal") >= 0, F.concat(F.col("c_acctbal").cast("string"), F.lit(" pt"))).otherwise("n/a"), "Source_IDs": F.concat(F.lit("s"), (k % 900).cast("string")),
    }
    return table(spark, sf, "customer").select(k.alias("k"), *[made.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in CANONICAL_COLUMNS])


def normalize_places(spark, sf):
    raw = raw_catalogue(spark, sf)
    d = K.normalize_places(raw.drop("k"))
    return d.select("poi_id", "city_id", "name", "lat", "lon", "category", "address", C.rounded(F.col("rating")).alias("rating"), "valid", F.array_join("issues", ",").alias("issues"), "coordinate_status")


_CHECKED = f"""{ODD_SQL}, t as (select k, case when lower(trim(global_id)) in ('nan', 'none', 'null', 'n/a') then '' else trim(global_id) end as poi_id, city as city_id, lower(trim(entity)) as entity_type,
  case when lower(trim(name)) in ('nan', 'none', 'null', 'n/a') then '' else trim(name) end as name, try_cast(replace(lat, ',', '.') as double) as lat, try_cast(lon as double) as lon,
  coalesce(nullif(category, ''), nullif(lower((select c_mktsegment from customer where c_custkey = k)), ''), 'unknown') as category, address, aliases,
  try_cast(replace(rating, ' pt', '') as double) as rating from raw),
p as (select *, coalesce(lat between -90 and 90 and lon between -180 and 180, false) as placed from t),
q as (select *, placed and city_id = 'da-nang' and not (lon between 107.8e0 and 108.5e0 and lat between 15.8e0 and 16.3e0) as outside,
  entity_type = 'poi' and poi_id <> '' and city_id <> '' and name <> '' and placed as valid from p)"""
NORMALIZE_SQL = f"""with {_CHECKED} select poi_id, city_id, name, lat, lon, category, trim(address) as address, {Q.r('rating')} as rating, valid,
  concat_ws(',', case when entity_type <> 'poi' then 'non_poi_entity_type' end, case when poi_id = '' then 'missing_global_id' end, case when city_id = '' then 'missing_city_id' end,
    case when name = '' then 'missing_name' end, case when not placed then 'invalid_coordinates' end, case when outside then 'outside_da_nang_bbox' end) as issues,
  case when outside then 'outside_city_bbox' when placed then 'valid' else 'invalid' end as coordinate_status from q"""


def quality_report(spark, sf):
    return K.quality_report(K.normalize_places(raw_catalogue(spark, sf).drop("k")))


REPORT_SQL = f"""with {_CHECKED}, a as (select count(distinct a) as n from (select unnest(list_filter(list_transform(regexp_split_to_array(aliases, '[|;]'), lambda x: trim(x)), lambda x: x <> '')) as a from raw))
select count(*) as n_rows, 34::bigint as n_columns, count(*) filter (where valid) as application_pois, count(*) filter (where entity_type = 'urban_void') as excluded_urban_void, count(*) filter (where not valid) as invalid_rows,
  count(distinct nullif(poi_id, '')) as unique_ids, count(nullif(poi_id, '')) - count(distinct nullif(poi_id, '')) as duplicate_id_rows, count(*) filter (where name = '') as missing_name,
  count(*) filter (where city_id = '') as missing_city_id, count(*) filter (where lat is null or lon is null) as missing_coordinates, count(*) filter (where not placed) as invalid_coordinates,
  count(*) filter (where outside) as outside_box, count(*) filter (where address = '') as missing_address, count(*) filter (where rating is null) as missing_rating, count(*) as missing_review_count,
  (select n from a) as alias_ids from q"""


def place_merge_candidates(spark, sf):
    return K.merge_candidates(K.normalize_places(raw_catalogue(spark, sf).drop("k"))).select("source_key", F.array_join("poi_ids", ",").alias("poi_ids"))


MERGE_SQL = f"with {_CHECKED} select 's' || (k % 900) as source_key, string_agg(poi_id, ',' order by poi_id) as poi_ids from q where valid group by 1 having count(*) > 1"

SEGMENTS = [(1, "Đường Lê Lợi"), (2, "trần phú"), (3, "Phú"), (4, "nowhere"), (5, "Đại lộ Lê Lợi"), (6, "")]


def road_density(spark, sf):
    raw = raw_catalogue(spark, sf).select(F.col("Address_Current").alias("address"), F.col("k").alias("first_seen"))
    return K.road_density(raw, spark.createDataFrame(SEGMENTS, "segment long, road string"))


DENSITY_SQL = f"""with {ODD_SQL}, a as (select k, trim(regexp_replace(trim(string_split(trim(address), ',')[1]), '^(Số\\s+)?(\\d+[A-Za-z/]*\\s+)?', '')) as road from raw),
c as (select lower(road) as road, count(*) as n, min(k) as seen from a where length(road) > 2 group by 1),
s as (select segment::bigint as segment, lower(regexp_replace(trim(road), '^(Đường|đường)\\s+', '')) as target from (values {', '.join(map(str, SEGMENTS))}) v(segment, road)),
j as (select segment, n, row_number() over (partition by segment order by (target <> c.road)::int, seen) as i from s join c on target <> '' and (contains(c.road, target) or contains(target, c.road)))
select s.segment, coalesce(j.n, 0) as n from s left join j on j.segment = s.segment and i = 1"""


def profile_fallback(spark, sf):
    """Events ask for their user's profile (users below 50 have one), their session's or the global one."""
    e = profile_events(spark, sf)
    text = lambda c: F.col(c).cast("string")
    asked = e.select(F.col("event_id").alias("request"), F.when(F.col("event_id") % 3 != 0, text("user_id")).alias("user_id"), F.lit("").alias("persona_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))).alias("session_id"))
    own = e.where("user_id < 50").groupBy(text("user_id").alias("profile")).agg(F.count(F.lit(1)).alias("value"))
    made = spark.createDataFrame([("global", -1), ("s4", -4)], "profile string, value long")
    return K.resolve_profiles(asked, own.unionByName(made))


FALLBACK_SQL = """with p as (select user_id::varchar as profile, count(*) as value from events where user_id < 50 group by 1 union all select 'global', -1 union all select 's4', -4),
r as (select event_id as request, coalesce(case when event_id % 3 <> 0 then user_id::varchar end, case when event_id % 2 = 0 then 's' || (event_id % 7) end, 'global') as key from events)
select request, coalesce(p.profile, 'global') as profile, coalesce(p.value, -1) as value from r left join p on p.profile = r.key"""


def semantic_text_strength(spark, sf):
    return places(spark, sf).select("poi_id", K.text_strength(F.concat_ws(" ", "category", "text")).alias("strength"))


STRENGTH_SQL = f"with {PLACES_SQL}, f as (select poi_id, {Q.norm("concat_ws(' ', category, text)")} as t from poi) select poi_id, case when regexp_matches(t, '{K.SEMANTIC}') then 1e0 when trim(t) <> '' then 0.35e0 else 0e0 end as strength from f"


def distance_bias(spark, sf):
    d = places(spark, sf).select("poi_id", C.haversine_km(F.lit(16.0544), F.lit(108.2022), F.col("lat"), F.col("lon")).alias("km"))
    return K.distance_bias(d, "km").select("poi_id", C.rounded(F.col("bias")).alias("bias"))


BIAS_SQL = f"with {PLACES_SQL}, d as (select poi_id, {Q.km('16.0544e0', '108.2022e0', 'lat', 'lon')} as km from poi) select poi_id, {Q.r('ln((1 + pow((select max(km) from d), 1.5e0)) / (1 + pow(km, 1.5e0)))')} as bias from d"

PLAN = {"query": "cafe va hai san", "limit": 4, "start": (16.05, 108.2), "mode": "motorbike", "minutes": 240}


def itinerary_plan(spark, sf):
    """The best 20 results of a query, one stop for each of its intents, the rest by rank."""
    top = S.score_places(places(spark, sf), PLAN["query"], PLAN["start"]).where("score > 0.08").withColumn("s", C.rounded(F.col("score"))).orderBy(F.desc("s"), "poi_id").limit(max(PLAN["limit"] * 5, 18))
    intents = [name for name, _ in S.detect_intents(PLAN["query"])]
    match = [S.category_match(F.col("cat"), F.col("words"), name).alias(f"m_{i}") for i, name in enumerate(intents)]
    results = top.select("poi_id", F.col("s").alias("score"), "lat", "lon", *match)
    from pyspark.sql import Window

    results = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "poi_id")))  # 20 rows
    return K.plan_itinerary(results, [f"m_{i}" for i in range(len(intents))], PLAN["limit"], PLAN["start"], PLAN["mode"], PLAN["minutes"])


def _itinerary_sql() -> str:
    intents = [name for name, _ in S.detect_intents(PLAN["query"])]
    limit = K.stop_limit(PLAN["minutes"], PLAN["limit"])
    picks, sql = [], ""
    for i, _ in enumerate(intents[:limit]):
        earlier = "".join(f" and poi_id not in (select poi_id from pick{j})" for j in range(i))
        sql += f", pick{i} as (select poi_id, {i} as pick from res where m_{i} >= 0.7{earlier} order by m_{i} desc, score desc, rank limit 1)"
        picks.append(f"select * from pick{i}")
    lat, lon = PLAN["start"]
    start = Q.km(f"{lat}e0", f"{lon}e0", "lat", "lon")
    matches = ", ".join(f"{Q.category(name)} as m_{i}" for i, name in enumerate(intents))
    leg = Q.km("plat", "plon", "lat", "lon")
    stay = (55, 75)
    return f"""with {Q.scored(PLAN['query'], PLAN['start'], None, (), (), {})},
top as (select *, {Q.r('score')} as s from scored where score > 0.08 order by s desc, poi_id limit {max(PLAN['limit'] * 5, 18)}),
res as (select poi_id, s as score, lat, lon, {matches}, row_number() over (order by s desc, poi_id) as rank from top){sql},
chosen as (select res.*, coalesce(p.pick, {len(intents)}) as pick from res left join ({' union all '.join(picks)}) p on p.poi_id = res.poi_id order by pick, rank limit {limit}),
o as (select *, row_number() over (order by {start}, score desc, rank) as n from chosen),
l as (select *, coalesce(lag(lat) over (order by n), {lat}e0) as plat, coalesce(lag(lon) over (order by n), {lon}e0) as plon, count(*) over () as c from o),
k as (select *, {leg} as km, greatest(3, floor({leg} / 22e0 * 60e0 + 0.5))::bigint as travel, (case when n = c then {stay[1]} else {stay[0]} end)::bigint as stay from l)
select n as stop, poi_id, {Q.r('km', 2)} as km, travel, stay, (sum(travel) over ())::bigint as total_travel, (sum(stay) over ())::bigint as total_stay from k"""


QUERIES = {f.__name__: f for f in (normalize_places, quality_report, place_merge_candidates, road_density, profile_fallback, semantic_text_strength, distance_bias, itinerary_plan)}
ORACLE_SQL = {
    "normalize_places": NORMALIZE_SQL, "quality_report": REPORT_SQL, "place_merge_candidates": MERGE_SQL, "road_density": DENSITY_SQL, "profile_fallback": FALLBACK_SQL,
    "semantic_text_strength": STRENGTH_SQL, "distance_bias": BIAS_SQL, "itinerary_plan": _itinerary_sql(),
}
