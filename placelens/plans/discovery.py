"""Search, recommendation and business queries over places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..operators import scoring as S
from ..sources.tables import PLACES_SQL, places, table
from . import sqltext as Q

CENTRE = (16.0544, 108.2022)
QUERY = "quán cà phê yên tĩnh học bài gần biển"
CONCEPT = "quan cafe hoc bai cho sinh vien"
TASTE = {"persona": "student", "liked": ["beach_view", "deep_work_study", "the"], "disliked": ["loud_music_noisy"], "category_penalty": {"quán nhậu": 2.5, "bao tang": 1.0}}
PENALTY = {"quan nhau": 2.5, "bao tang": 1.0}


def area_opportunity(df: DataFrame, concept: str, least: int = 4) -> DataFrame:
    """One grouping by grid cell; all signals are conditional aggregates, so rows combine before the shuffle."""
    intent = next(iter(S.detect_intents(concept)), (None,))[0]
    d = S.haystacks(df)
    d = d.select(C.grid_key(F.col("lat"), F.col("lon")).alias("area"), "lat", "lon", (S.category_match(F.col("cat"), F.col("words"), intent) > 0.7).alias("direct"), (C.keyword_score(concept, F.col("hay")) > 0).alias("semantic"), C.rating_score(F.col("rating")).alias("rs"), C.review_signal(F.col("review_count")).alias("rv"))
    g = d.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count_if("direct").alias("direct"), F.count_if("semantic").alias("semantic"), F.avg("rs").alias("rs"), F.avg("rv").alias("rv")).where(F.col("n") >= least)
    g = g.withColumn("demand", C.clamp01(F.col("semantic") / F.col("n") * 0.45 + F.col("rs") * 0.3 + F.col("rv") * 0.25))
    g = g.withColumn("competition", C.clamp01(F.col("direct") / 12.0)).withColumn("complementary", C.clamp01(F.log10(F.col("n") + 1.0) / 2.0))
    g = g.withColumn("access", C.clamp01(1.0 - C.haversine_km(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])) / 18.0)).withColumn("fit", C.clamp01(F.col("direct") / 4.0 + F.col("semantic") / 12.0))
    g = g.withColumn("score", C.clamp01(F.col("demand") * 0.30 + F.col("complementary") * 0.20 + F.col("access") * 0.20 + F.col("fit") * 0.20 - F.col("competition") * 0.10))
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("competition") > 0.65, "competition"), F.when(F.col("demand") < 0.25, "demand"), F.when(F.col("access") < 0.35, "access"))), ",")
    return g.withColumn("warnings", warnings)


def business_area_opportunity(spark: SparkSession, sf: str) -> DataFrame:
    g = area_opportunity(places(spark, sf), CONCEPT)
    return g.select("area", "n", F.col("direct").alias("n_direct"), F.col("semantic").alias("n_semantic"), C.rounded(F.col("demand")).alias("demand"), C.rounded(F.col("access")).alias("access"), C.rounded(F.col("score")).alias("score"), "warnings")


AREA_CTE = f"""{Q.HAY},
cells as (select printf('%.3f,%.3f', floor(lat / 0.018e0 + 0.5) * 0.018e0, floor(lon / 0.018e0 + 0.5) * 0.018e0) as area, * from hay),
grouped as (select area, count(*) as n, avg(lat) as lat, avg(lon) as lon, count(*) filter (where {Q.category('cafe')} > 0.7) as direct, count(*) filter (where {Q.keyword(CONCEPT, 'hay')} > 0) as semantic,
  avg({Q.rating('rating')}) as rs, avg({Q.review('review_count')}) as rv from cells group by area having count(*) >= 4),
sig as (select *, {Q.clamp01('semantic * 1e0 / n * 0.45e0 + rs * 0.3e0 + rv * 0.25e0')} as demand, {Q.clamp01('direct / 12e0')} as competition, {Q.clamp01('log10(n + 1e0) / 2e0')} as complementary,
  {Q.clamp01('1e0 - ' + Q.km('lat', 'lon', '16.0544e0', '108.2022e0') + ' / 18e0')} as access, {Q.clamp01('direct / 4e0 + semantic / 12e0')} as fit from grouped),
areas as (select *, {Q.clamp01('demand * 0.30e0 + complementary * 0.20e0 + access * 0.20e0 + fit * 0.20e0 - competition * 0.10e0')} as score from sig)"""
BUSINESS_SQL = f"""with {AREA_CTE}
select area, n, direct as n_direct, semantic as n_semantic, {Q.r('demand')} as demand, {Q.r('access')} as access, {Q.r('score')} as score,
  concat_ws(',', case when competition > 0.65 then 'competition' end, case when demand < 0.25 then 'demand' end, case when access < 0.35 then 'access' end) as warnings from areas"""


def area_top_categories(spark, sf):
    p = places(spark, sf).select(C.grid_key(F.col("lat"), F.col("lon")).alias("area"), "category")
    return R.top_per_group(p.groupBy("area", "category").agg(F.count(F.lit(1)).alias("n")), ["area"], [F.desc("n"), F.col("category")], 5)


AREA_CATEGORIES_SQL = f"""with {PLACES_SQL}, g as (select printf('%.3f,%.3f', floor(lat / 0.018e0 + 0.5) * 0.018e0, floor(lon / 0.018e0 + 0.5) * 0.018e0) as area, category, count(*) as n from poi group by 1, 2)
select * from (select area, category, n, row_number() over (partition by area order by n desc, category) as rank from g) where rank <= 5"""


def business_evidence(spark, sf, limit: int = 6):
    """Evidence rows of the best areas: direct competitors and complementary places, three of each, with their ids."""
    p = places(spark, sf)
    cells = p.withColumn("area", C.grid_key(F.col("lat"), F.col("lon"))).withColumn("cat", C.normalize_text(F.col("category"))).withColumn("words", C.normalize_text(F.concat_ws(" ", "name", "text")))
    best = area_opportunity(p, CONCEPT).select("area", C.rounded(F.col("score")).alias("s"), F.col("lat").alias("alat"), F.col("lon").alias("alon")).orderBy(F.desc("s"), "area").limit(limit)
    rows = cells.join(F.broadcast(best), "area").withColumn("kind", F.when(S.category_match(F.col("cat"), F.col("words"), "cafe") > 0.7, "competitor").otherwise("complementary"))
    rows = rows.withColumn("km", C.rounded(C.haversine_km(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon")), 3))
    order = [F.when(F.col("kind") == "competitor", F.col("km")).otherwise(0.0), F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), F.col("poi_id")]
    top = R.top_per_group(rows, ["area", "kind"], order, 3)
    return top.select("area", "kind", F.col("rank").cast("long").alias("rank"), "poi_id", "km", F.concat_ws(":", "area", "kind", F.col("rank").cast("string")).alias("evidence_id"))


EVIDENCE_SQL = f"""with {AREA_CTE}, best as (select area, lat as alat, lon as alon from areas order by {Q.r('score')} desc, area limit 6),
ev as (select c.area, case when {Q.category('cafe')} > 0.7 then 'competitor' else 'complementary' end as kind, poi_id, rating, review_count, {Q.r(Q.km('alat', 'alon', 'c.lat', 'c.lon'), 3)} as km from cells c join best b on c.area = b.area),
ranked as (select *, row_number() over (partition by area, kind order by case when kind = 'competitor' then km else 0e0 end, rating desc nulls last, review_count desc nulls last, poi_id) as rank from ev)
select area, kind, rank, poi_id, km, area || ':' || kind || ':' || rank as evidence_id from ranked where rank <= 3"""


def recommend(spark, sf, **more):
    return S.score_places(places(spark, sf), QUERY, CENTRE, **TASTE, **more)


RECOMMEND_CTE = Q.scored(QUERY, CENTRE, "student", TASTE["liked"], TASTE["disliked"], PENALTY)


def recommend_scored(spark, sf):
    return recommend(spark, sf).where("score > 0.08").select("poi_id", C.rounded(F.col("score")).alias("score"), C.rounded(F.col("distance_km")).alias("distance_km"), F.array_join("warnings", ",").alias("warnings"))


def recommend_topk(spark, sf, limit: int = 8):
    d = recommend(spark, sf).where("score > 0.08").withColumn("s", C.rounded(F.col("score")))
    return d.orderBy(F.desc("s"), "poi_id").limit(limit).select("poi_id", "name", F.col("s").alias("score"), C.js_round(F.col("s") * 100).cast("long").alias("percent"))


RERANK = {"place": {7: 3.0, 12: 1.5, 40: 4.0}, "categories": {"cafe": 2.0, "hải sản": 1.25}, "intents": {"cafe": {"cafe": 0.5}, "seafood": {"hai san": 0.75}}, "penalties": {3: 2.0, 12: 1.0}, "memory_places": {40: -2.0, 9: 5.0}, "memory_categories": {"bao tang": 1.5}}


def recommend_with_reranker(spark, sf, limit: int = 50):
    d = S.rerank(recommend(spark, sf), QUERY, **RERANK)
    return d.select("poi_id", C.rounded(F.col("score")).alias("score"), C.rounded(F.col("delta"), 4).alias("delta")).orderBy(F.desc("score"), F.desc("delta"), "poi_id").limit(limit)


def _case(w: dict) -> str:
    return "(case poi_id " + " ".join(f"when {k} then {v}e0" for k, v in w.items()) + " else 0e0 end)"


_names = [n for n, _ in S.detect_intents(QUERY)]
_boost = f"{_case(RERANK['place'])} + {Q.weights('cat', RERANK['categories'])}" + "".join(f" + {Q.weights('cat', RERANK['intents'][n])}" for n in _names if n in RERANK["intents"])
_delta = f"({Q.clamp01(f'({_boost}) * 0.08e0')} + greatest(-0.32e0, least(0.32e0, ({_case(RERANK['memory_places'])} + {Q.weights('cat', RERANK['memory_categories'])}) * 0.08e0)) - {Q.clamp01(_case(RERANK['penalties']) + ' * 0.08e0')})"
RERANK_SQL = f"""with {RECOMMEND_CTE}, d as (select *, {_delta} as delta from scored)
select poi_id, {Q.r(Q.clamp01('score + delta'))} as score, {Q.r('delta', 4)} as delta from d order by 2 desc, 3 desc, 1 limit 50"""


def category_penalty_max(spark, sf):
    """Distinct categories against the weights, then back to the places by an equi-join."""
    cats = places(spark, sf).select("category", C.normalize_text(F.col("category")).alias("cat")).groupBy("category", "cat").agg(F.count(F.lit(1)).alias("n"))
    return cats.select("category", "n", S.weight_max(F.col("cat"), {"quan": 1.5, "nhau": 2.25, "cafe": 0.5, "": 0.25}).alias("penalty"))


def poi_search_ranked(spark, sf, q: str = "customer 12 the", category: str = "quan"):
    p = places(spark, sf).withColumn("doc", C.normalize_text(F.concat_ws(" ", "name", "category", "district")))
    terms = [t for t in S.plain(q).split() if t]
    p = p.where(F.contains(C.normalize_text(F.col("category")), F.lit(S.plain(category)))).withColumn("relevance", C.hits(F.col("doc"), terms))
    return p.where("relevance > 0").select("poi_id", "name", F.col("relevance").cast("long").alias("relevance")).orderBy(F.desc("relevance"), "name", "poi_id")


def poi_search_page(spark, sf):
    return R.page(poi_search_ranked(spark, sf), [F.desc("relevance"), F.col("name"), F.col("poi_id")], 20, R.encode_cursor(20))[0]


_relevance = " + ".join(f"{Q.has('doc', t)}::int" for t in ("customer", "12", "the"))
SEARCH_SQL = f"""with {PLACES_SQL}, d as (select *, {Q.norm("concat_ws(' ', name, category, district)")} as doc from poi where {Q.has(Q.norm('category'), 'quan')})
select poi_id, name, ({_relevance})::bigint as relevance from d where {_relevance} > 0"""


def keyword_score_topk(spark, sf, q: str = "the of that und der que", k: int = 25):
    d = table(spark, sf, "documents").select("doc_id", C.rounded(C.keyword_score(q, C.normalize_text(F.col("text")))).alias("score"))
    return d.orderBy(F.desc("score"), "doc_id").limit(k)


KEYWORD_SQL = f"select doc_id, {Q.r(Q.keyword('the of that und der que', Q.norm('text')))} as score from documents order by 2 desc, 1 limit 25"


def detect_intents(spark, sf):
    turns = S.once(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", "text", F.when(F.col("conv_id") % 3 == 0, "quán cà phê").when(F.col("conv_id") % 3 == 1, "Hải sản gần biển")).alias("q")), nq=C.normalize_text(F.col("q")))
    turns = S.once(turns, best=S.intent_column(F.col("nq"), normalized=True))
    i = F.col("best")
    return turns.select("conv_id", "turn", F.coalesce(i["intent"], F.lit("none")).alias("intent"), F.coalesce(i["score"], F.lit(0)).cast("long").alias("score"))


_score = {n: "(" + " + ".join(f"{Q.has('q', t)}::int" for t in terms) + ")" for n, (terms, _) in S.INTENTS.items()}
_most = "greatest(" + ", ".join(_score.values()) + ")"
INTENT_SQL = f"""with t as (select conv_id, turn, {Q.norm("concat_ws(' ', text, case conv_id % 3 when 0 then 'quán cà phê' when 1 then 'Hải sản gần biển' end)")} as q from conversations where role = 'user')
select conv_id, turn, case when {_most} = 0 then 'none' {' '.join(f"when {s} = {_most} then '{n}'" for n, s in _score.items())} end as intent, ({_most})::bigint as score from t"""


def category_match(spark, sf):
    p = S.once(places(spark, sf), cat=C.normalize_text(F.col("category")), words=C.normalize_text(F.concat_ws(" ", "name", "text")))
    return p.select("poi_id", *[S.category_match(F.col("cat"), F.col("words"), i).alias(f"m_{i}") for i in S.INTENTS])


def candidate_union_precedence(spark, sf):
    p = places(spark, sf).select("poi_id", "rating")
    must = p.where("poi_id % 97 = 5").select("poi_id", F.lit("must_include").alias("reason"))
    ranked = p.where("rating > 4.5").select("poi_id", F.lit("recommended").alias("reason"))
    wide = p.where("poi_id % 10 = 5").select("poi_id", F.lit("filler").alias("reason"))
    return R.with_precedence([must, ranked, wide], "poi_id").join(p.where("poi_id % 7 = 0").select("poi_id"), "poi_id", "left_anti")


def search_keyword_prefixes(spark, sf):
    k = C.search_keywords(F.concat_ws(" ", "name", "category"))
    return places(spark, sf).select("poi_id", F.size(k).cast("long").alias("n_keywords"), F.array_contains(k, "cu").alias("has_cu"), F.array_contains(k, "qua").alias("has_qua"))


PREFIX_SQL = f"""with {PLACES_SQL}, t as (select poi_id, list_filter(regexp_split_to_array({Q.norm("concat_ws(' ', name, category)")}, '[^a-z0-9]+'), lambda x: length(x) >= 2) as w from poi),
k as (select poi_id, list_distinct(list_concat(w, flatten(list_transform(w, lambda x: list_transform(range(2, least(12, length(x)) + 1), lambda i: substr(x, 1, i)))))) as k from t)
select poi_id, least(120, len(k))::bigint as n_keywords, list_contains(k, 'cu') as has_cu, list_contains(k, 'qua') as has_qua from k"""


def route_matrix(spark, sf):
    d = places(spark, sf).select("poi_id", C.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon")).alias("km"))
    return d.select("poi_id", C.rounded(F.col("km"), 2).alias("km"), *[C.matrix_minutes(F.col("km"), m).cast("long").alias(m) for m in ("walking", "car", "cycling")])


_km = Q.km("16.0544e0", "108.2022e0", "lat", "lon")
MATRIX_SQL = f"""with {PLACES_SQL} select poi_id, {Q.r(_km, 2)} as km, {', '.join(f"greatest(3, floor({_km} / {v}e0 * 60e0 + 0.5))::bigint as {m}" for m, v in (('walking', 4.5), ('car', 28), ('cycling', 22)))} from poi"""


def radius_density(spark, sf):
    """Places within 0.5 km of each one, by grid cells."""
    p = places(spark, sf).select("poi_id", "lat", "lon")
    pairs = R.band_join(p, p, 0.006).where(C.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 0.5)
    return pairs.groupBy("poi_id").agg(F.count(F.lit(1)).alias("n"))


RADIUS_SQL = f"with {PLACES_SQL} select a.poi_id, count(*) as n from poi a join poi b on {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.5 group by 1"


def stop_duration_policy(spark, sf):
    p = S.once(places(spark, sf), hay=C.normalize_text(F.concat_ws(" ", "category", "name", "text")))
    return p.select("poi_id", C.stop_minutes(F.col("hay"), F.when(F.col("poi_id") % 11 == 0, (F.col("poi_id") % 600).cast("int"))).cast("long").alias("minutes"))


_stop = "case " + " ".join(f"when {Q.has('hay', t)} then {m}" for t, m in C.STOP_MINUTES.items()) + " else 60 end"
STOP_SQL = f"with {Q.HAY.replace('concat_ws(\' \', name, category, text, district)', 'concat_ws(\' \', category, name, text)')} select poi_id, (case when poi_id % 11 = 0 and poi_id % 600 between 15 and 480 then poi_id % 600 else {_stop} end)::bigint as minutes from hay"


def embedding_cosine_topk(spark, sf, k: int = 20):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, w = F.col("v"), F.col("q")
    score = C.rounded(dot(v, w) / (F.sqrt(dot(v, v)) * F.sqrt(dot(w, w))))
    return e.crossJoin(F.broadcast(q)).where("vec_id <> 0").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)  # the query is one row


COSINE_SQL = f"""with q as (select embedding::double[] as q from embeddings where vec_id = 0)
select vec_id, {Q.r('list_cosine_similarity(embedding::double[], q)')} as score from embeddings, q where vec_id <> 0 order by 2 desc, 1 limit 20"""

QUERIES = {f.__name__: f for f in (business_area_opportunity, area_top_categories, business_evidence, recommend_scored, recommend_topk, recommend_with_reranker, category_penalty_max, poi_search_ranked, poi_search_page, keyword_score_topk, detect_intents, category_match, candidate_union_precedence, search_keyword_prefixes, route_matrix, radius_density, stop_duration_policy, embedding_cosine_topk)}
ORACLE_SQL = {
    "business_area_opportunity": BUSINESS_SQL, "area_top_categories": AREA_CATEGORIES_SQL, "business_evidence": EVIDENCE_SQL,
    "recommend_scored": f"with {RECOMMEND_CTE} select poi_id, {Q.r('score')} as score, {Q.r('distance_km')} as distance_km, concat_ws(',', case when distance_km > 10 then 'far' end, case when s_category < 0.3 then 'category' end, case when rating is null or rating = 0 then 'no_rating' end) as warnings from scored where score > 0.08",
    "recommend_topk": f"with {RECOMMEND_CTE} select poi_id, name, {Q.r('score')} as score, floor({Q.r('score')} * 100 + 0.5)::bigint as percent from scored where score > 0.08 order by 3 desc, 1 limit 8",
    "recommend_with_reranker": RERANK_SQL,
    "category_penalty_max": f"with {PLACES_SQL}, c as (select category, count(*) as n, {Q.norm('category')} as cat from poi group by category) select category, n, greatest(0.25e0, case when {Q.has('cat', 'quan')} then 1.5e0 else 0e0 end, case when {Q.has('cat', 'nhau')} then 2.25e0 else 0e0 end, case when {Q.has('cat', 'cafe')} then 0.5e0 else 0e0 end) as penalty from c",
    "poi_search_ranked": SEARCH_SQL, "poi_search_page": SEARCH_SQL + " order by relevance desc, name, poi_id limit 20 offset 20", "keyword_score_topk": KEYWORD_SQL, "detect_intents": INTENT_SQL,
    "category_match": f"with {Q.HAY} select poi_id, {', '.join(f'{Q.category(i)} as m_{i}' for i in S.INTENTS)} from hay",
    "candidate_union_precedence": f"with {PLACES_SQL} select poi_id, case when poi_id % 97 = 5 then 'must_include' when rating > 4.5 then 'recommended' else 'filler' end as reason from poi where (poi_id % 97 = 5 or rating > 4.5 or poi_id % 10 = 5) and poi_id % 7 <> 0",
    "search_keyword_prefixes": PREFIX_SQL, "route_matrix": MATRIX_SQL, "radius_density": RADIUS_SQL, "stop_duration_policy": STOP_SQL, "embedding_cosine_topk": COSINE_SQL,
}
