"""Profiles, memories, weights and streams from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..operators import scoring as S
from ..sources.tables import EVENTS_SQL, PLACES_SQL, places, profile_events, table
from ..streaming import profiles as P
from . import sqltext as Q

PLACE_CATEGORY_SQL = f"{PLACES_SQL}, {EVENTS_SQL}, cat as (select poi_id, replace(replace({Q.norm('category')}, ' ', '_'), '-', '_') as category from poi), pe as (select e.*, c.category from ev e join cat c on e.poi_id = c.poi_id)"


def placed(spark, sf) -> DataFrame:
    """Events with their place's category as a key. Categories have no đ, so both foldings agree on them."""
    cats = places(spark, sf).select("poi_id", C.clean_key(F.col("category")).alias("category"))
    return profile_events(spark, sf).join(cats, "poi_id")


def profile_rows(e: DataFrame) -> DataFrame:
    """Long form: user, dimension, context, key, weight."""
    review = F.greatest(F.coalesce("rating", F.lit(0.0)), F.lit(1.0))
    visit = F.greatest(F.least(F.col("dwell") / 30.0, F.lit(4.0)), F.lit(0.75))
    part = F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday")
    context = F.concat_ws(".", C.time_of_day(F.hour("ts")), part)
    none = F.lit("")

    def item(kinds, dim, ctx, key, w):
        return F.when(F.col("kind").isin(*kinds) & key.isNotNull(), F.struct(F.lit(dim).alias("dim"), ctx.alias("ctx"), key.alias("key"), w.cast("double").alias("w")))

    both, w = ("review", "poi_visit"), F.when(F.col("kind") == "review", review).otherwise(visit)
    items = [
        item(both, "category", none, F.col("category"), w), item(both, "context_category", context, F.col("category"), w), item(("review",), "purpose", none, F.col("purpose"), review),
        item(("review",), "mood", none, F.col("mood"), review), item(("review",), "context_mood", context, F.col("mood"), review), item(("review",), "purpose_by_category", F.col("category"), F.col("purpose"), review),
        item(("route_segment",), "transport", none, F.col("transport"), F.lit(1.0)),
    ]
    return e.select("user_id", F.explode(F.array_compact(F.array(*items))).alias("x")).select("user_id", "x.*")


def user_profile_topk(spark, sf):
    g = profile_rows(placed(spark, sf)).groupBy("user_id", "dim", "ctx", "key").agg(C.rounded(F.sum("w"), 4).alias("weight"))
    limit = F.when(F.col("dim") == "category", 20).when(F.col("dim") == "purpose_by_category", 6).when(F.col("dim") == "transport", 8).otherwise(12)
    return R.top_per_group(g, ["user_id", "dim", "ctx"], [F.desc("weight"), F.col("key")], 20).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


_ctx = "case when hour(ts) < 11 then 'morning' when hour(ts) < 17 then 'afternoon' when hour(ts) < 22 then 'evening' else 'night' end || '.' || case when dayofweek(ts) in (0, 6) then 'weekend' else 'weekday' end"
_w = "case when kind = 'review' then greatest(coalesce(rating, 0), 1e0) else greatest(least(dwell / 30e0, 4e0), 0.75e0) end"
PROFILE_ROWS_SQL = f"""{PLACE_CATEGORY_SQL}, x as (
  select user_id, 'category' as dim, '' as ctx, category as key, {_w} as w from pe where kind in ('review', 'poi_visit') union all
  select user_id, 'context_category', {_ctx}, category, {_w} from pe where kind in ('review', 'poi_visit') union all
  select user_id, 'purpose', '', purpose, {_w} from pe where kind = 'review' union all
  select user_id, 'mood', '', mood, {_w} from pe where kind = 'review' union all
  select user_id, 'context_mood', {_ctx}, mood, {_w} from pe where kind = 'review' union all
  select user_id, 'purpose_by_category', category, purpose, {_w} from pe where kind = 'review' union all
  select user_id, 'transport', '', transport, 1e0 from pe where kind = 'route_segment')"""
PROFILE_SQL = f"""with {PROFILE_ROWS_SQL},
g as (select user_id, dim, ctx, key, {Q.r('sum(w)', 4)} as weight from x where key is not null group by all),
r as (select *, row_number() over (partition by user_id, dim, ctx order by weight desc, key) as rank from g)
select * from r where rank <= case dim when 'category' then 20 when 'purpose_by_category' then 6 when 'transport' then 8 else 12 end"""


def dwell_preference(spark, sf):
    """The dwell times are summed in the order of event ids, in double precision, as the SQL does where the table lies in that order. Visits of a user at one time are summed exactly first, as decimals, and count at their smallest id. So the order of rows never moves a mean that ends in .5 or lies at a style's bound."""
    v = profile_events(spark, sf).where((F.col("kind") == "poi_visit") & (F.col("dwell") > 0))
    at = v.groupBy("user_id", "ts").agg(F.sum(F.least("dwell", F.lit(360.0)).cast("decimal(28,25)")).cast("double").alias("d"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("id"))
    so_far = F.sum("d").over(Window.partitionBy("user_id").orderBy("id", "ts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g = at.withColumn("s", so_far).groupBy("user_id").agg((F.max("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))  # all are positive: the last sum is the largest
    return g.select("user_id", C.js_round(F.col("m")).cast("long").alias("target_minutes"), C.dwell_style(F.col("m")).alias("style"), "n")


DWELL_SQL = f"with {EVENTS_SQL}, g as (select user_id, avg(least(dwell, 360e0)) as m, count(*) as n from ev where kind = 'poi_visit' and dwell > 0 group by 1) select user_id, floor(m + 0.5)::bigint as target_minutes, case when m < 25 then 'quick_stop' when m < 75 then 'standard_visit' else 'long_stay' end as style, n from g"


def agent_memory_weights(spark, sf):
    """Signed sums by profile; every row also counts for the profile global."""
    e = placed(spark, sf)
    kind = F.col("kind")
    w = F.when(kind == "add_to_itinerary", 0.7).when(kind == "poi_not_fit", -1.0).when(kind == "review", (F.col("rating") - 3) * 0.4)
    rows = e.withColumn("w", w).where("w is not null").select(F.explode(F.array(F.col("user_id").cast("string"), F.lit("global"))).alias("profile"), "category", "w")
    g = rows.groupBy("profile", "category").agg(F.sum("w").alias("w"))
    return g.select("profile", "category", C.rounded(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("w"))), 4).alias("weight"))


MEMORY_SQL = f"""with {PLACE_CATEGORY_SQL}, w as (select user_id, category, case kind when 'add_to_itinerary' then 0.7e0 when 'poi_not_fit' then -1e0 when 'review' then (rating - 3) * 0.4e0 end as w from pe),
b as (select user_id::varchar as profile, category, w from w where w is not null union all select 'global', category, w from w where w is not null)
select profile, category, {Q.r('greatest(-4e0, least(4e0, sum(w)))', 4)} as weight from b group by 1, 2"""


def feedback_counters(spark, sf):
    e = placed(spark, sf).where(F.col("kind").isin("add_to_itinerary", "poi_not_fit"))
    rows = e.select("user_id", F.when(F.col("kind") == "poi_not_fit", "penalty").otherwise("affinity").alias("sign"), F.explode(F.array(F.struct(F.lit("poi").alias("of"), F.col("poi_id").cast("string").alias("key")), F.struct(F.lit("category").alias("of"), F.col("category").alias("key")))).alias("x"))
    return rows.groupBy("user_id", "sign", "x.of", "x.key").agg(F.count(F.lit(1)).alias("n"))


FEEDBACK_SQL = f"""with {PLACE_CATEGORY_SQL}, f as (select *, case kind when 'poi_not_fit' then 'penalty' else 'affinity' end as sign from pe where kind in ('add_to_itinerary', 'poi_not_fit'))
select user_id, sign, 'poi' as of, poi_id::varchar as key, count(*) as n from f group by 1, 2, 4 union all select user_id, sign, 'category', category, count(*) from f group by 1, 2, 4"""


def reflections(spark, sf):
    """The four categories that each user likes best, as text."""
    top = R.top_per_group(agent_memory_weights(spark, sf).where("weight > 0"), ["profile"], [F.desc("weight"), F.col("category")], 4)
    return top.groupBy("profile").agg(F.array_join(R.ordered_array(F.col("category"), F.col("rank")), ", ").alias("liked"))


REFLECTION_SQL = f"with m as ({MEMORY_SQL}), r as (select *, row_number() over (partition by profile order by weight desc, category) as rank from m where weight > 0) select profile, string_agg(category, ', ' order by rank) as liked from r where rank <= 4 group by 1"


def contextual_recommend(spark, sf, k: int = 5):
    """Popularity from counters, nearness, and taste from the user's category weights as a joined table, for all users. Within a category a user's taste is the same for all places, so only places
    that can be among the best k of their category meet the users: those within the rounding of the k-th best, k at most of each equal value."""
    p = places(spark, sf).withColumn("cat_key", C.clean_key(F.col("category")))
    counts = P.place_counters(profile_events(spark, sf)).withColumnRenamed("review_count", "reviews")
    pop = C.popularity_score(*[F.coalesce(c, F.lit(0)) for c in ("times_visited", "times_added", "times_routed", "reviews")], F.coalesce("rating", F.lit(0.0)))
    near = C.distance_score(C.haversine_km(F.lit(16.0544), F.lit(108.2022), F.col("lat"), F.col("lon")), 12.0)
    scored = p.join(counts, "poi_id", "left").select("poi_id", "cat_key", pop.alias("pop"), near.alias("near")).withColumn("base", F.col("pop") * 0.30 + F.col("near") * 0.28)
    best = R.top_per_group(scored, ["cat_key", "base"], [F.col("poi_id")], k, "__same").drop("__same")
    kth = R.top_per_group(best, ["cat_key"], [F.desc("base"), F.col("poi_id")], k, "__n").groupBy("cat_key").agg(F.min("base").alias("least"))
    best = best.join(kth, "cat_key").where(F.col("base") >= F.col("least") - 1e-5)
    weights = profile_rows(placed(spark, sf)).where("dim = 'category'").groupBy("user_id", "key").agg(F.sum("w").alias("w"))
    most = weights.groupBy("user_id").agg(F.greatest(F.max("w"), F.lit(1.0)).alias("most"))
    users = weights.join(most, "user_id").select("user_id", "key", C.clamp01(F.col("w") / F.col("most")).alias("taste"))
    d = best.join(users, F.col("cat_key") == F.col("key")).withColumn("score", C.rounded(C.clamp01(F.col("pop") * 0.30 + F.col("taste") * 0.42 + F.col("near") * 0.28)))
    return R.top_per_group(d, ["user_id"], [F.desc("score"), F.col("poi_id")], k).select("user_id", F.col("rank").cast("long").alias("rank"), "poi_id", "score")


_l = lambda c, d: Q.clamp01(f"log10(coalesce({c}, 0) + 1e0) / {d}e0")
CONTEXTUAL_SQL = f"""with {PLACE_CATEGORY_SQL},
n as (select poi_id, count(*) filter (where kind = 'poi_visit') as v, count(*) filter (where kind = 'add_to_itinerary') as a, count(*) filter (where kind = 'route_segment') as t, count(*) filter (where kind = 'review') as rv from ev group by 1),
w as (select user_id, category, sum({_w}) as w from pe where kind in ('review', 'poi_visit') group by 1, 2), m as (select user_id, greatest(max(w), 1e0) as most from w group by 1),
d as (select w.user_id, p.poi_id, {Q.r(Q.clamp01(f"({Q.clamp01(f'{_l('n.v', 2.2)} * 0.28e0 + {_l('n.a', 2.2)} * 0.24e0 + {_l('n.t', 2.4)} * 0.16e0 + {Q.review('n.rv')} * 0.14e0 + {Q.rating('coalesce(p.rating, 0)')} * 0.18e0')}) * 0.30e0 + {Q.clamp01('w.w / m.most')} * 0.42e0 + {Q.clamp01('1e0 - ' + Q.km('16.0544e0', '108.2022e0', 'p.lat', 'p.lon') + ' / 12e0')} * 0.28e0"))} as score
  from poi p left join n on n.poi_id = p.poi_id join cat c on c.poi_id = p.poi_id join w on w.category = c.category join m on m.user_id = w.user_id)
select * from (select user_id, row_number() over (partition by user_id order by score desc, poi_id) as rank, poi_id, score from d) where rank <= 5"""


#: What the users of each group said that they like, and the context of personalized_recommend.
LIKES = [["student", "deep_work_study"], ["tourist", "beach_view", "weekend_chill"], ["local_explorer", "hidden_gems"], []]
STYLES = ["quick_stop", "standard_visit", "long_stay"]
CONTEXT, MOOD, PURPOSE = "morning.weekday", "calm", "work"


def leaders(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The rows whose base is within the rounding of the k-th best of their keys, k at most of each equal base."""
    best = R.top_per_group(df, [*keys, "base"], [F.col("poi_id")], k, "__same").drop("__same")
    kth = R.top_per_group(best, keys, [F.desc("base"), F.col("poi_id")], k, "__n").groupBy(*keys).agg(F.min("base").alias("__least"))
    return best.join(kth, keys).where(F.col("base") >= F.col("__least") - 1e-5).drop("__least")


def personalized_recommend(spark, sf, k: int = 5):
    """The places that suit each user's whole profile in a context: category, category in the context, explicit tastes, purpose, mood, mood in the context, and length of stay.

    What depends on the place alone, or on the user's group of tastes and style of stay, ranks the places of each category and of all; only these leaders meet the users.
    A user's part is equal for all places of a category and least for a category the user doesn't know, so no other place can be among the best."""
    counts = P.place_counters(profile_events(spark, sf)).withColumnRenamed("review_count", "reviews")
    p = S.once(places(spark, sf), cat=C.clean_key(F.col("category")), hay=C.clean_key(F.concat_ws(" ", "name", "category", "text", "district")), kind=F.concat_ws(" ", "category", "name")).drop("text")
    pop = C.popularity_score(*[F.coalesce(c, F.lit(0)) for c in ("times_visited", "times_added", "times_routed", "reviews")], F.coalesce("rating", F.lit(0.0)))
    near = C.distance_score(C.haversine_km(F.lit(16.0544), F.lit(108.2022), F.col("lat"), F.col("lon")), 12.0)
    fits = F.array(*[F.struct(F.lit(g).alias("liking"), F.lit(s).alias("style"), (S.explicit_score(F.col("hay"), tags) * 0.22 + S.dwell_fit(s, F.col("kind")) * 0.09).alias("own")) for g, tags in enumerate(LIKES) for s in STYLES])
    p = S.once(p, fits=fits).drop("hay", "kind").join(counts, "poi_id", "left").select("poi_id", "cat", pop.alias("pop"), near.alias("near"), F.explode("fits").alias("f"))
    p = p.select("poi_id", "cat", "f.liking", "f.style", (F.col("pop") * 0.30 + F.col("near") * 0.28 + F.col("f.own") * 0.42).alias("base"))

    g = profile_rows(placed(spark, sf)).groupBy("user_id", "dim", "ctx", "key").agg(F.sum("w").alias("w"))
    s = g.withColumn("share", C.clamp01(F.col("w") / F.greatest(F.max("w").over(Window.partitionBy("user_id", "dim", "ctx")), F.lit(1.0))))
    share = lambda dim, **is_: F.coalesce(F.max(F.when((F.col("dim") == dim) & F.expr(" and ".join(["true", *(f"{c} = '{v}'" for c, v in is_.items())])), F.col("share"))), F.lit(0.0))
    dwell = dwell_preference(spark, sf).select("user_id", "target_minutes")
    users = s.groupBy("user_id").agg(share("mood", key=MOOD).alias("mood"), share("context_mood", ctx=CONTEXT, key=MOOD).alias("context_mood"), share("purpose", key=PURPOSE).alias("purpose"))
    users = users.join(dwell, "user_id", "left").select("user_id", "mood", "context_mood", "purpose", F.pmod("user_id", F.lit(len(LIKES))).cast("int").alias("liking"), C.dwell_style(F.coalesce("target_minutes", F.lit(45))).alias("style"))
    cat = F.when(F.col("dim") == "purpose_by_category", F.col("ctx")).when(F.col("dim").isin("category", "context_category"), F.col("key"))
    known = s.withColumn("cat", cat).where("cat is not null").groupBy("user_id", "cat").agg(share("category").alias("category"), share("context_category", ctx=CONTEXT).alias("context_category"), share("purpose_by_category", key=PURPOSE).alias("usual"))

    own = leaders(p, ["liking", "style", "cat"], k).join(known.join(users, "user_id"), ["liking", "style", "cat"])
    none = F.lit(0.0)
    other = leaders(p, ["liking", "style"], k).join(users, ["liking", "style"]).withColumns({"category": none, "context_category": none, "usual": none})
    personal = F.col("category") * 0.20 + F.col("context_category") * 0.19 + F.greatest("purpose", "usual") * 0.15 + F.col("mood") * 0.09 + F.col("context_mood") * 0.06
    both = own.unionByName(other).groupBy("user_id", "poi_id").agg(F.max(C.clamp01(F.col("base") + personal * 0.42)).alias("score")).withColumn("score", C.rounded(F.col("score"))).where("score > 0.08")
    return R.top_per_group(both, ["user_id"], [F.desc("score"), F.col("poi_id")], k).select("user_id", F.col("rank").cast("long").alias("rank"), "poi_id", "score")


def _explicit(tags: list[str]) -> str:
    return "(" + " + ".join(["0", *(f"{Q.any_of('hay', S.explicit_terms(t))}::int" for t in tags)]) + f") / {max(len(tags), 1)}e0"


_PERSONAL = f"pl.pop * 0.30e0 + pl.near * 0.28e0 + 0.42e0 * (coalesce(c.share, 0) * 0.20e0 + coalesce(cc.share, 0) * 0.19e0 + pl.likes[u.user_id % {len(LIKES)} + 1] * 0.22e0 + greatest(coalesce(u.purpose, 0), coalesce(pc.share, 0)) * 0.15e0 + coalesce(u.mood, 0) * 0.09e0 + coalesce(u.context_mood, 0) * 0.06e0 + case when coalesce(t.target, 45) >= 75 and regexp_matches(kind, '(?i)cafe|coffee|study|cowork|restaurant|bar') then 0.85e0 when coalesce(t.target, 45) < 25 and regexp_matches(kind, '(?i)takeaway|bakery|tea|juice|fast') then 0.8e0 else 0.5e0 end * 0.09e0)"
PERSONALIZED_SQL = f"""with {PROFILE_ROWS_SQL},
n as (select poi_id, count(*) filter (where kind = 'poi_visit') as v, count(*) filter (where kind = 'add_to_itinerary') as a, count(*) filter (where kind = 'route_segment') as t, count(*) filter (where kind = 'review') as rv from ev group by 1),
g as (select user_id, dim, ctx, key, sum(w) as w from x where key is not null group by all),
s as (select *, {Q.clamp01('w / greatest(max(w) over (partition by user_id, dim, ctx), 1e0)')} as share from g),
u as (select user_id, max(share) filter (where dim = 'mood' and key = '{MOOD}') as mood, max(share) filter (where dim = 'context_mood' and ctx = '{CONTEXT}' and key = '{MOOD}') as context_mood, max(share) filter (where dim = 'purpose' and key = '{PURPOSE}') as purpose from s group by 1),
t as (select user_id, floor(avg(least(dwell, 360e0)) + 0.5) as target from ev where kind = 'poi_visit' and dwell > 0 group by 1),
h as (select *, trim(regexp_replace(lower(strip_accents(concat_ws(' ', name, category, text, district))), '[^a-z0-9]+', '_', 'g'), '_') as hay from poi),
pl as (select p.poi_id, cat.category as cat, p.category || ' ' || p.name as kind, [{', '.join(_explicit(t) for t in LIKES)}] as likes,
  {Q.clamp01(f"{_l('n.v', 2.2)} * 0.28e0 + {_l('n.a', 2.2)} * 0.24e0 + {_l('n.t', 2.4)} * 0.16e0 + {Q.review('n.rv')} * 0.14e0 + {Q.rating('coalesce(p.rating, 0)')} * 0.18e0")} as pop,
  {Q.clamp01('1e0 - ' + Q.km('16.0544e0', '108.2022e0', 'p.lat', 'p.lon') + ' / 12e0')} as near from h p join cat on cat.poi_id = p.poi_id left join n on n.poi_id = p.poi_id),
d as (select u.user_id, pl.poi_id, {Q.r(Q.clamp01(_PERSONAL))} as score
  from u cross join pl left join t on t.user_id = u.user_id left join s c on c.user_id = u.user_id and c.dim = 'category' and c.key = pl.cat
  left join s cc on cc.user_id = u.user_id and cc.dim = 'context_category' and cc.ctx = '{CONTEXT}' and cc.key = pl.cat left join s pc on pc.user_id = u.user_id and pc.dim = 'purpose_by_category' and pc.ctx = pl.cat and pc.key = '{PURPOSE}')
select * from (select user_id, row_number() over (partition by user_id order by score desc, poi_id) as rank, poi_id, score from d where score > 0.08) where rank <= 5"""


def place_counters(spark, sf):
    return P.place_counters(profile_events(spark, sf))


COUNTERS_SQL = f"with {EVENTS_SQL} select poi_id, count(*) filter (where kind = 'poi_visit') as times_visited, count(*) filter (where kind = 'add_to_itinerary') as times_added, count(*) filter (where kind = 'route_segment') as times_routed, count(*) filter (where kind = 'review') as review_count, coalesce(sum(rating), 0e0) as rating_sum from ev group by 1"


def online_events(e: DataFrame) -> DataFrame:
    """The columns that online learning reads."""
    context = F.concat_ws(".", C.time_of_day(F.hour("ts")), F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday"))
    return e.select("user_id", "ts", F.when(F.col("kind") == "review", "review").otherwise("analytics").alias("source"), "event_id", F.concat(F.lit("poi_"), (F.col("poi_id") % 7).cast("string")).alias("category"), F.when(F.col("kind") == "review", F.col("purpose")).alias("purpose"), F.when(F.col("kind") == "review", F.col("mood")).alias("mood"), context.alias("context"), F.when(F.col("kind") == "route_segment", F.col("transport")).alias("transport"), "dwell", "rating")


def event_learning_rate(spark, sf):
    e = P.learning_columns(online_events(profile_events(spark, sf)))
    return e.select("event_id", C.rounded(F.col("alpha")).alias("alpha"), C.rounded(F.col("weight")).alias("weight"))


RATE_SQL = f"""with {EVENTS_SQL} select event_id,
  {Q.r("greatest(0.08e0, least(0.34e0, (case when coalesce(dwell, 0) <> 0 then greatest(0.4e0, least(1.8e0, dwell / 90e0)) else 1e0 end) * (case when coalesce(rating, 0) <> 0 then greatest(0.75e0, least(1.35e0, rating / 4e0)) else 1e0 end) * 0.18e0))")} as alpha,
  {Q.r("(case when kind = 'review' then greatest(0.2e0, least(1.2e0, coalesce(nullif(rating, 0), 3) / 5e0)) else 1e0 end) * (case when coalesce(dwell, 0) <> 0 then greatest(0.5e0, least(3e0, dwell / 45e0)) else 1e0 end)")} as weight from ev where user_id is not null"""


def ema_profile_batch(spark, sf):
    return P.batch_profiles(online_events(profile_events(spark, sf))).withColumn("weight", C.rounded(F.col("weight")))


def event_tumbling_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), C.rounded(F.sum("value"), 2).alias("total"))
    return g.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


TUMBLING_SQL = f"select (floor(epoch(ts) / 21600) * 21600)::bigint as start_s, event_type, count(*) as n, {Q.r('sum(value)', 2)} as total from events group by 1, 2"


def event_sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    g = e.groupBy("user_id", F.session_window("ts", "8 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


SESSION_SQL = """with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 8 hour then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l) select user_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as n from s group by user_id, s"""


def event_dedupe(spark, sf):
    """Redelivered events count once."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return e.unionByName(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), C.rounded(F.sum("value"), 2).alias("total"))


def json_props_rollup(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"), "value")
    return e.groupBy("event_type", (F.col("p.k") % 10).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), C.rounded(F.avg("value"), 4).alias("mean"))


JSON_SQL = f"select event_type, (json_extract_string(props, '$.k')::int % 10)::bigint as bucket, count(*) as n, {Q.r('avg(value)', 4)} as mean from events group by 1, 2"

QUERIES = {f.__name__: f for f in (user_profile_topk, dwell_preference, agent_memory_weights, feedback_counters, reflections, contextual_recommend, personalized_recommend, place_counters, event_learning_rate, ema_profile_batch, event_tumbling_counts, event_sessions, event_dedupe, json_props_rollup)}
ORACLE_SQL = {
    "user_profile_topk": PROFILE_SQL, "dwell_preference": DWELL_SQL, "agent_memory_weights": MEMORY_SQL, "feedback_counters": FEEDBACK_SQL, "reflections": REFLECTION_SQL, "contextual_recommend": CONTEXTUAL_SQL, "personalized_recommend": PERSONALIZED_SQL, "place_counters": COUNTERS_SQL,
    "event_learning_rate": RATE_SQL, "event_tumbling_counts": TUMBLING_SQL, "event_sessions": SESSION_SQL, "event_dedupe": f"select user_id, count(*) as n, {Q.r('sum(value)', 2)} as total from events group by 1", "json_props_rollup": JSON_SQL,
}
