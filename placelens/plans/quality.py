"""Quality reports, diagnostics, imports, evaluation, routes and trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..operators import rules as X
from ..operators import trips as T
from ..sources.tables import PLACES_SQL, places, table
from . import sqltext as Q


def poi_eda_metrics(spark, sf):
    """Rows of both sources stand in both views."""
    views = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("source").isin("google_maps", "google_maps+foody"), "google"), F.when(F.col("source").isin("foody", "google_maps+foody"), "foody")), lambda x: x.isNotNull()))
    g = places(spark, sf).select(views.alias("view"), "category", "district", "rating").groupBy("view")
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif("category", F.lit(""))).alias("categories"), F.countDistinct(F.nullif("district", F.lit(""))).alias("districts"), C.rounded(F.avg("rating"), 1).alias("mean_rating"))


_eda = f"count(*) as n, count(distinct nullif(category, '')) as categories, count(distinct nullif(district, '')) as districts, {Q.r('avg(rating)', 1)} as mean_rating"
EDA_SQL = f"with {PLACES_SQL} select 'all' as view, {_eda} from poi union all select 'google', {_eda} from poi where source in ('google_maps', 'google_maps+foody') union all select 'foody', {_eda} from poi where source in ('foody', 'google_maps+foody')"


def poi_quality_counters(spark, sf):
    ok = C.valid_coordinate(F.col("lat"), F.col("lon"))
    return places(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("poi_id").alias("n_ids"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(F.col("rating").isNull()).alias("missing_rating"), F.count_if(F.col("rating") > 5).alias("rating_out_of_range"),
        F.count_if(F.col("review_count").isNull()).alias("missing_reviews"), F.count_if(F.trim("text") == "").alias("missing_text"), F.count_if(F.col("source") == "google_maps+foody").alias("merged_provenance_rows"), F.count_if(F.col("lat").between(15.9, 16.1) & F.col("lon").between(108.1, 108.25)).alias("in_box"),
    )


COUNTERS_SQL = f"""with {PLACES_SQL} select count(*) as n_rows, count(distinct poi_id) as n_ids, count(*) filter (where lat between -90 and 90 and lon between -180 and 180) as valid, count(*) filter (where not (lat between -90 and 90 and lon between -180 and 180)) as invalid,
 count(*) filter (where rating is null) as missing_rating, count(*) filter (where rating > 5) as rating_out_of_range, count(*) filter (where review_count is null) as missing_reviews, count(*) filter (where trim(text) = '') as missing_text,
 count(*) filter (where source = 'google_maps+foody') as merged_provenance_rows, count(*) filter (where lat between 15.9 and 16.1 and lon between 108.1 and 108.25) as in_box from poi"""


def poi_duplicate_groups(spark, sf):
    g = table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return g.where("n > 1").orderBy("first").limit(100)


def duplicate_summary(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.count(F.lit(1)).alias("distinct_keys"), F.sum(F.greatest(F.lit(0), F.col("c") - 1)).alias("extra_rows"), F.count_if(F.col("c") > 1).alias("repeated_keys"))


def category_histogram(spark, sf):
    return places(spark, sf).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def orphan_checks(spark, sf):
    t = lambda n: table(spark, sf, n)
    pairs = [("orders_without_lines", t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k"))), ("lines_without_order", t("lineitem").select(F.col("l_orderkey").alias("k")), t("orders").select(F.col("o_orderkey").alias("k"))), ("orders_without_customer", t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"))), ("labels_without_document", t("labels").select(F.col("doc_id").alias("k")), t("documents").select(F.col("doc_id").alias("k")))]
    out = None
    for name, a, b in pairs:
        d = a.join(b, "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


ORPHAN_SQL = " union all ".join(f"select '{n}' as name, count(*) as n from {a} where not exists (select 1 from {b} where {b}.{y} = {a}.{x})" for n, a, b, x, y in (("orders_without_lines", "orders", "lineitem", "o_orderkey", "l_orderkey"), ("lines_without_order", "lineitem", "orders", "l_orderkey", "o_orderkey"), ("orders_without_customer", "orders", "customer", "o_custkey", "c_custkey"), ("labels_without_document", "labels", "documents", "doc_id", "doc_id")))
DUPLICATE_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_name"]}


def duplicate_key_checks(spark, sf):
    out = None
    for name, keys in DUPLICATE_KEYS.items():
        d = table(spark, sf, name).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit(name).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


DUPLICATE_SQL = " union all ".join(f"select '{n}' as name, count(*) as n from (select 1 from {n} group by {', '.join(k)} having count(*) > 1)" for n, k in DUPLICATE_KEYS.items())


def range_invariants(spark, sf):
    """All counts in one pass."""
    l = table(spark, sf, "lineitem")
    return l.agg(F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if(~F.col("l_discount").between(0, 0.1)).alias("bad_discount"), F.count_if(F.col("l_tax") > 0.05).alias("high_tax"), F.count_if(F.col("l_shipdate").isNull()).alias("no_date"), F.count_if(F.col("l_extendedprice") > 50000).alias("dear"), F.countDistinct("l_returnflag", "l_linestatus").alias("states"))


def table_counts(spark, sf):
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        d = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


def review_summary_join(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), C.rounded(F.sum("l_extendedprice"), 2).alias("total"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "total")


#: Line numbers repeat within an order here, so the part and the flag break ties.
TIES = ("l_linenumber", "l_partkey", "l_returnflag", "l_suppkey", "l_quantity")


def ordered_array_agg(spark, sf):
    """Three correlated ordered arrays as pre-aggregations."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(R.ordered_array(F.col("l_partkey"), F.struct(*TIES)), lambda x: x.cast("string")), ",").alias("parts"), F.array_join(R.ordered_array(F.col("l_returnflag"), F.struct(*TIES)), ",").alias("flags"))
    return table(spark, sf, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("parts", F.lit("")).alias("parts"), F.coalesce("flags", F.lit("")).alias("flags"))


ORDERED_SQL = "with g as (select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey, l_returnflag, l_suppkey, l_quantity) as parts, string_agg(l_returnflag, ',' order by l_linenumber, l_partkey, l_returnflag, l_suppkey, l_quantity) as flags from lineitem group by 1) select o_orderkey, coalesce(parts, '') as parts, coalesce(flags, '') as flags from orders left join g on o_orderkey = l_orderkey"


def image_url_parse(spark, sf):
    urls = C.image_urls(F.concat_ws(",", "url", F.lit("not-a-url"), F.lit("ftp://example.com/c.jpg"), F.lit(" https://example.com/a.jpg "), "url"))
    return table(spark, sf, "pages").select("page_id", F.size(urls).cast("long").alias("n"), F.array_join(urls, " ").alias("urls"))


IMAGE_SQL = "with u as (select page_id, list_filter([url, 'https://example.com/a.jpg'], lambda x: x is not null and regexp_matches(x, '^https?://[^/]')) as l from pages) select page_id, len(l)::bigint as n, array_to_string(l, ' ') as urls from u"


def entity_import_records(spark, sf):
    """Sources of each place as external ids, one row each, keeping their position."""
    p = places(spark, sf).select("poi_id", "name", F.posexplode(F.split("source", "\\+")).alias("sort_order", "namespace"))
    return p.select("poi_id", F.col("sort_order").cast("long").alias("sort_order"), "namespace", F.concat("namespace", F.lit(":"), F.col("poi_id").cast("string")).alias("external_id"), F.sha2(F.concat_ws("|", F.col("poi_id").cast("string"), "name"), 256).alias("checksum"))


IMPORT_SQL = f"with {PLACES_SQL}, s as (select poi_id, name, string_split(source, '+') as l from poi), x as (select poi_id, name, unnest(l) as namespace, generate_subscripts(l, 1) - 1 as sort_order from s) select poi_id, sort_order::bigint as sort_order, namespace, namespace || ':' || poi_id as external_id, sha256(poi_id || '|' || name) as checksum from x"


def upsert_merge(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.lit("old").alias("created_at"))
    new = o.where("k % 5 = 0").select("k", F.when(F.col("k") % 10 == 0, F.col("price") * 2).alias("price"), F.lit("new").alias("created_at")).unionByName(o.where("k % 100 = 1").select((-F.col("k")).alias("k"), "price", F.lit("new").alias("created_at")))
    return R.upsert(o, new, ["k"]).withColumn("price", C.rounded(F.col("price"), 2))


UPSERT_SQL = f"select o_orderkey as k, {Q.r('case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end', 2)} as price, 'old' as created_at from orders union all select -o_orderkey, {Q.r('o_totalprice', 2)}, 'new' from orders where o_orderkey % 100 = 1"


def insert_new_only(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 50 = 0").select("c_custkey", F.lit("changed").alias("c_name")).unionByName(c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("added").alias("c_name")))
    return R.insert_new(c, new, ["c_custkey"])


def eval_precision_recall(spark, sf):
    """Documents found by words against those labelled good, for each source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", "doc_id", (F.col("quality") == 1).alias("good"), C.rounded(C.keyword_score("the of and", C.normalize_text(F.col("text")))).alias("score"))
    top = d.withColumn("hit", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")) <= 5)
    g = top.groupBy("source").agg(F.count_if("hit").alias("k"), F.count_if("good").alias("n_good"), F.count_if(F.col("hit") & F.col("good")).alias("tp"))
    p, r = F.col("tp") / F.greatest("k", F.lit(1)), F.col("tp") / F.greatest("n_good", F.lit(1))
    return g.select("source", C.rounded(p, 4).alias("p_at_5"), C.rounded(r, 4).alias("r_at_5"), C.rounded(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4).alias("f1"), (F.col("tp") > 0).cast("int").alias("hit"))


EVAL_SQL = f"""with d as (select source, documents.doc_id, quality = 1 as good, {Q.r(Q.keyword('the of and', Q.norm('text')))} as score from documents join labels on documents.doc_id = labels.doc_id),
t as (select *, row_number() over (partition by source order by score desc, doc_id) <= 5 as hit from d),
g as (select source, count(*) filter (where hit) as k, count(*) filter (where good) as n, count(*) filter (where hit and good) as tp from t group by 1),
m as (select source, tp, tp * 1e0 / greatest(k, 1) as p, tp * 1e0 / greatest(n, 1) as r from g)
select source, {Q.r('p', 4)} as p_at_5, {Q.r('r', 4)} as r_at_5, {Q.r('case when p + r = 0 then 0e0 else 2 * p * r / (p + r) end', 4)} as f1, (tp > 0)::int as hit from m"""


def fuzzy_traffic_score(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("hour"), (F.col("event_id") % 97).cast("double").alias("density"), (F.col("value") % 12.0).alias("rain"), F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("residential")), (F.col("event_id") % 3 + 1).cast("int")).alias("road"))
    low, mid, high = X.traffic_levels(F.col("hour"), F.col("density"), F.col("rain"), F.col("road"))
    d = e.select("event_id", low.alias("low"), mid.alias("mid"), high.alias("high")).select("event_id", C.rounded(X.centroid(F.col("low"), F.col("mid"), F.col("high"))).alias("score"))
    return d.withColumn("level", X.level(F.col("score")))


def _trap(x, a, b, c, d):
    rise = f"when {x} < {b} then ({x} - {a}) / ({b} - {a})" if f"{a}" != f"{b}" else ""
    return f"(case when {x} <= {a} or {x} >= {d} then 0e0 when {x} >= {b} and {x} <= {c} then 1e0 {rise} else ({d} - {x}) / ({d} - {c}) end)"


_f = lambda *v: [f"{x}e0" for x in v]
_peak = "case road " + " ".join(f"when '{n}' then greatest({_trap('hour', *_f(a - 1, a, b, b + 1))}, {_trap('hour', *_f(c - 1, c, d, d + 1))})" for n, (a, b, c, d) in X.PEAKS.items()) + " end"
TRAFFIC_SQL = f"""with e as (select event_id, hour(ts) + minute(ts) / 60e0 as hour, (event_id % 97)::double as density, value % 12e0 as rain, ['primary', 'secondary', 'residential'][(event_id % 3 + 1)::int] as road from events),
m as (select event_id, {_peak} as p, {_trap('density', *_f(0, 0, 5, 15))} as dl, {_trap('density', *_f(10, 20, 35, 50))} as dm, {_trap('density', *_f(35, 50, 300, 500))} as dh, {_trap('rain', *_f(0, 0, 2, 5))} as rl, {_trap('rain', *_f(2, 5, 50, 100))} as rh from e),
o as (select event_id, greatest(least(1 - p, dl), least(1 - p, dm)) as lo, greatest(least(p, dm), least(1 - p, dh), least(p, dl)) as mi, greatest(least(p, dh, rh), least(p, dh, rl), least(p, dh, 1 - rh), least(1 - p, dh, rh)) as hi from m),
x as (select event_id, x::double as x, greatest(least({_trap('x::double', *_f(-20, 0, 20, 40))}, lo), least({_trap('x::double', *_f(20, 40, 60, 80))}, mi), least({_trap('x::double', *_f(60, 80, 100, 120))}, hi)) as mu from o, (select unnest(range(0, 101, 5)) as x)),
s as (select event_id, {Q.r('case when sum(mu) = 0 then 0e0 else sum(x * mu) / sum(mu) end')} as score from x group by 1)
select event_id, score, case when score > 70 then 'high' when score > 30 then 'medium' else 'low' end as level from s"""
HOURS = ["", "06:00 - 21:00", "09:30 - 14:00 | 16:00 - 21:00", "always open maybe", "22:00 - 02:00", "07:15-11:45"]


def opening_hours_parse(spark, sf):
    raw = F.element_at(F.array(*[F.lit(h) for h in HOURS]), (F.col("event_id") % len(HOURS) + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", raw.alias("raw"), (F.hour("ts") * 60 + F.minute("ts")).alias("at"))
    return e.select("event_id", C.opening_status(F.col("raw")).alias("status"), C.opening_fit(F.col("raw"), F.col("at"), F.col("at") + 45).alias("fit"), C.time_of(F.col("at") + 45).alias("until"))


OPENING_SQL = """with e as (select event_id, event_id % 6 as h, hour(ts) * 60 + minute(ts) as t from events),
f as (select *, case h when 0 then 'unknown' when 3 then 'unparseable' when 4 then 'unparseable' else 'known' end as status, case h when 1 then t >= 360 and t + 45 <= 1260 when 2 then (t >= 570 and t + 45 <= 840) or (t >= 960 and t + 45 <= 1260) when 5 then t >= 435 and t + 45 <= 705 end as ok from e)
select event_id, status, case when status <> 'known' then status when ok then 'open' else 'conflict' end as fit, printf('%02d:%02d', ((t + 45) % 1440) // 60, (t + 45) % 60) as until from f"""


def stops_of_orders(spark, sf):
    """Orders as trips: lines as stops at their suppliers, whose key gives the position."""
    s = table(spark, sf, "supplier").select("s_suppkey", (16.0544 + ((F.col("s_suppkey") * 7919) % 1000 - 500) * 2e-4).alias("lat"), (108.2022 + ((F.col("s_suppkey") * 104729) % 1000 - 500) * 2e-4).alias("lon"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("pos"), "l_suppkey", "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")


STOPS_SQL = "st as (select l_orderkey as trip_id, l_linenumber as pos, l_suppkey, l_quantity, 16.0544e0 + (((s_suppkey * 7919) % 1000) - 500) * 2e-4 as lat, 108.2022e0 + (((s_suppkey * 104729) % 1000) - 500) * 2e-4 as lon from lineitem left join supplier on l_suppkey = s_suppkey)"


def stop_legs_lag(spark, sf):
    w = Window.partitionBy("trip_id").orderBy("pos", "l_suppkey", "l_quantity")
    d = stops_of_orders(spark, sf).withColumn("plat", F.lag("lat").over(w)).withColumn("plon", F.lag("lon").over(w))
    m = C.leg_metres(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return d.select("trip_id", "pos", m.cast("long").alias("metres"), C.leg_minutes(m).cast("long").alias("minutes"))


def stop_legs(spark, sf):
    """Unknown legs as -1."""
    return stop_legs_lag(spark, sf).na.fill(-1, ["metres", "minutes"])


_m = f"floor({Q.metres('plat', 'plon', 'lat', 'lon')} / 10e0 + 0.5) * 10"
LEGS_CTE = f"{STOPS_SQL}, lg as (select *, lag(lat) over (partition by trip_id order by pos, l_suppkey, l_quantity) as plat, lag(lon) over (partition by trip_id order by pos, l_suppkey, l_quantity) as plon from st), legs as (select trip_id, pos, l_quantity, ({_m})::bigint as metres, case when plat is not null and lat is not null then greatest(4, ceil({_m} / 1000e0 / 22e0 * 60e0 + 3e0))::bigint end as minutes from lg)"


def trip_totals_null_propagation(spark, sf):
    """Any unknown leg makes the travel total unknown, here -1; the numbers of legs stand all the same."""
    g = stop_legs_lag(spark, sf).where((F.col("pos") > 1) | (F.col("trip_id") % 2 == 0)).groupBy("trip_id")
    return g.agg(F.when(F.count_if(F.col("minutes").isNull()) > 0, F.lit(-1)).otherwise(F.sum("minutes")).cast("long").alias("travel"), F.count_if(F.col("minutes").isNull()).alias("unknown_legs"), F.count("minutes").alias("known_legs"))


def trips(spark, sf):
    """Each order is a trip, its lines are the stops."""
    d = stops_of_orders(spark, sf)
    d = d.withColumn("stop", F.row_number().over(Window.partitionBy("trip_id").orderBy("pos", "l_suppkey", "l_quantity")))
    hours = F.element_at(F.array(F.lit(None).cast("string"), F.lit("08:00-18:00"), F.lit("always"), F.lit("09:00-11:00 | 13:00-20:00")), (F.col("stop") % 4 + 1).cast("int"))
    return d.select(
        "trip_id", F.col("stop").cast("long").alias("poi_id"), (F.col("l_quantity") / 50.0).alias("score"), F.col("stop").alias("rank"), "lat", "lon",
        F.lit(60).alias("stay"), hours.alias("opening_hours"), (F.col("stop") % 5 == 0).alias("must"),
    )


def nearest_neighbour_route(spark, sf):
    return T.order_trips(trips(spark, sf))


def trip_schedule(spark, sf):
    return T.schedule_trips(trips(spark, sf), days=2, per_day=3)


RULES = [(1, "red widget", "no_left"), (2, "ring", "no_entry"), (3, "street  bolt", "no_u_turn"), (4, "small", "no_right")]


def road_rule_fuzzy_join(spark, sf):
    rules = spark.createDataFrame(RULES, "rule_id long, rule string, ban string").withColumn("rule", X.road_name(F.col("rule")))
    names = table(spark, sf, "part").select("p_partkey", X.road_name(F.regexp_replace("p_name", "#", " ")).alias("road"))
    return names.join(X.fuzzy_join(names, rules, "road", "rule"), "road").select("p_partkey", "road", "rule_id", "ban")


_road = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '^\\s*(đường|phố|road|street)\\s+', ''), '\\s+', ' ', 'g'))"
ROAD_SQL = f"""with rules as (select rule_id::bigint as rule_id, {_road.format('rule')} as rule, ban from (values {', '.join(map(str, RULES))}) v(rule_id, rule, ban)),
n as (select p_partkey, {_road.format("replace(p_name, '#', ' ')")} as road from part),
j as (select n.*, rule_id, ban, row_number() over (partition by p_partkey order by rule_id) as k from n join rules on length(road) > 0 and (contains(road, rule) or contains(rule, road)))
select p_partkey, road, rule_id, ban from j where k = 1"""


def turn_restriction_lag(spark, sf):
    """Turns between parts in a row on an order that a rule table bans, the first one of each kind on a route."""
    w = Window.partitionBy("l_orderkey").orderBy(*TIES)
    seg = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("road"), F.lag(F.col("l_partkey") % 10).over(w).alias("before"))
    bans = spark.createDataFrame([(1, 2, "left"), (3, 4, "right"), (7, 7, "u")], "before long, road long, ban string")
    return R.keep_first(seg.join(bans, ["before", "road"]), ["l_orderkey", "ban"], [F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "ban")


TURN_SQL = "with s as (select l_orderkey, l_linenumber, l_partkey % 10 as road, lag(l_partkey % 10) over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag, l_suppkey, l_quantity) as before from lineitem), j as (select *, row_number() over (partition by l_orderkey, ban order by l_linenumber) as k from s join (values (1, 2, 'left'), (3, 4, 'right'), (7, 7, 'u')) v(b, r, ban) on before = b and road = r) select l_orderkey, l_linenumber, ban from j where k = 1"


def band_join_rules(spark, sf):
    """One-way rules (one beside each place) near places: both coordinates within 0.005 degrees."""
    p = places(spark, sf).select("poi_id", "lat", "lon")
    rules = p.select(F.col("poi_id").alias("rule"), (F.col("lat") + 0.001).alias("lat"), (F.col("lon") - 0.001).alias("lon"))
    return R.band_join(p, rules, 0.005).select("poi_id", F.col("r_rule").alias("rule"))


BAND_SQL = f"with {PLACES_SQL}, r as (select poi_id as rule, lat + 0.001e0 as rlat, lon - 0.001e0 as rlon from poi) select poi_id, rule from poi, r where abs(lat - rlat) < 0.005 and abs(lon - rlon) < 0.005"


def text_functions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"), "source")
    raw = F.concat_ws("", (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, ",5 km").when(F.col("doc_id") % 3 == 1, "abc").otherwise(".25"))
    return d.select("doc_id", C.clean_key(F.col("t")).alias("clean_key"), F.size(C.tokens(F.col("t"))).cast("long").alias("n_tokens"), C.optional_number(raw).alias("number"), F.array_join(C.parse_list(F.concat_ws("|", "source", F.lit(" nan ; x"))), ",").alias("list"), C.clean_string(F.col("source")).alias("clean"))


TEXT_SQL = f"""with d as (select doc_id, text as t, source from documents)
select doc_id, coalesce(nullif(trim(regexp_replace(lower(strip_accents(coalesce(t, ''))), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') as clean_key,
 len(list_filter(regexp_split_to_array({Q.norm('t')}, '[^a-z0-9]+'), lambda x: length(x) >= 2))::bigint as n_tokens,
 case doc_id % 3 when 0 then (doc_id % 50) + 0.5e0 when 1 then (doc_id % 50)::double else (doc_id % 50) + 0.25e0 end as number, concat_ws(',', nullif(trim(source), ''), 'x') as list, trim(coalesce(source, '')) as clean from d"""

QUERIES = {f.__name__: f for f in (poi_eda_metrics, poi_quality_counters, poi_duplicate_groups, duplicate_summary, category_histogram, orphan_checks, duplicate_key_checks, range_invariants, table_counts, review_summary_join, ordered_array_agg, image_url_parse, entity_import_records, upsert_merge, insert_new_only, eval_precision_recall, fuzzy_traffic_score, opening_hours_parse, stop_legs, trip_totals_null_propagation, nearest_neighbour_route, trip_schedule, road_rule_fuzzy_join, turn_restriction_lag, band_join_rules, text_functions)}
ORACLE_SQL = {
    "poi_eda_metrics": EDA_SQL, "poi_quality_counters": COUNTERS_SQL, "poi_duplicate_groups": "select p_name, count(*) as n, min(p_partkey) as first from part group by 1 having count(*) > 1 order by 3 limit 100",
    "duplicate_summary": "with g as (select count(*) as c from lineitem group by l_partkey) select count(*) as distinct_keys, sum(greatest(0, c - 1))::bigint as extra_rows, count(*) filter (where c > 1) as repeated_keys from g",
    "category_histogram": f"with {PLACES_SQL} select coalesce(nullif(category, ''), 'unknown') as category, count(*) as n from poi group by 1", "orphan_checks": ORPHAN_SQL, "duplicate_key_checks": DUPLICATE_SQL,
    "range_invariants": "select count(*) filter (where l_quantity <= 0) as bad_quantity, count(*) filter (where not l_discount between 0e0 and 0.1e0) as bad_discount, count(*) filter (where l_tax > 0.05e0) as high_tax, count(*) filter (where l_shipdate is null) as no_date, count(*) filter (where l_extendedprice > 50000) as dear, count(distinct l_returnflag || l_linestatus) as states from lineitem",
    "table_counts": " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "review_summary_join": f"with g as (select l_orderkey, count(*) as n_lines, {Q.r('sum(l_extendedprice)', 2)} as total from lineitem group by 1) select o_orderkey, coalesce(n_lines, 0) as n_lines, total from orders left join g on o_orderkey = l_orderkey",
    "ordered_array_agg": ORDERED_SQL, "image_url_parse": IMAGE_SQL, "entity_import_records": IMPORT_SQL, "upsert_merge": UPSERT_SQL,
    "insert_new_only": "select c_custkey, c_name from customer union all select c_custkey + 1000000, 'added' from customer where c_custkey % 50 = 0", "eval_precision_recall": EVAL_SQL, "fuzzy_traffic_score": TRAFFIC_SQL, "opening_hours_parse": OPENING_SQL,
    "stop_legs": f"with {LEGS_CTE} select trip_id, pos, coalesce(metres, -1) as metres, coalesce(minutes, -1) as minutes from legs",
    "trip_totals_null_propagation": f"with {LEGS_CTE} select trip_id, case when count(*) filter (where minutes is null) > 0 then -1 else sum(minutes)::bigint end as travel, count(*) filter (where minutes is null) as unknown_legs, count(minutes) as known_legs from legs where pos > 1 or trip_id % 2 = 0 group by 1",
    "road_rule_fuzzy_join": ROAD_SQL, "turn_restriction_lag": TURN_SQL, "band_join_rules": BAND_SQL, "text_functions": TEXT_SQL,
}
