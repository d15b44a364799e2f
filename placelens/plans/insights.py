"""Concepts, business insights and their guardrail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import insights as I
from ..operators import relational as R
from ..operators import scoring as S
from ..sources.tables import places, table
from . import discovery
from . import sqltext as Q

PHRASES = ["Quán cafe yên tĩnh cho sinh viên", "Nhà hàng hải sản gần biển, cao cấp", "premium budget office bar", "Shop for families near a school, parking", "", "Tour du lịch giá rẻ, giao thông tốt", "moderate luxury spa"]


def concept_parse(spark, sf):
    """Concepts of customers, two phrases each, in both languages."""
    k = F.col("c_custkey")
    phrase = lambda i: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i % len(PHRASES) + 1).cast("int"))
    d = S.once(table(spark, sf, "customer").select(k.alias("concept_id"), phrase(k).alias("a"), phrase(F.floor(k / 7)).alias("b")), folded=C.normalize_text(F.concat_ws(" ", "a", "b")))
    d = S.once(d, vi=I.concept_fields(F.col("folded")), en=I.concept_fields(F.col("folded"), "en"))
    both = d.select("concept_id", F.inline(F.array(*[F.struct(F.lit(x).alias("language"), F.col(x).alias("f")) for x in ("vi", "en")])))
    return both.select("concept_id", "language", "f.type", F.array_join("f.customers", "|").alias("customers"), "f.budget", F.array_join("f.priorities", "|").alias("priorities"))


def _named(rules, default, at: int) -> str:
    return f"coalesce(nullif(concat_ws('|', {', '.join(f"case when {Q.any_of('t', r[0])} then '{r[1 + at]}' end" for r in rules)}), ''), '{default}')"


def _concept_sql(language: str) -> str:
    at = ["vi", "en"].index(language)
    hits = {i: "(" + " + ".join(f"{Q.has('t', w)}::int" for w in terms) + ")" for i, (terms, _) in S.INTENTS.items()}
    best = f"greatest({', '.join(hits.values())})"
    kind = " ".join(f"when {h} = {best} then '{I.LABELS[i]}'" for i, h in hits.items())
    budget = " ".join(f"when {Q.any_of('t', terms)} then '{names[at]}'" for terms, *names in reversed(I.BUDGETS))
    return f"""select concept_id, '{language}' as language, case when {best} = 0 then case when {Q.any_of('t', ['restaurant', 'nha hang'])} then 'Restaurant' else '{I.DEFAULTS['type'][at]}' end {kind} end as type,
 {_named(I.CUSTOMERS, I.DEFAULTS['customers'][at], at)} as customers, case {budget} else '{I.DEFAULTS['budget'][at]}' end as budget, {_named(I.PRIORITIES, I.DEFAULTS['priorities'][at], at)} as priorities from c"""


_list = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
CONCEPT_SQL = f"with c as (select c_custkey as concept_id, {Q.norm(f"{_list}[(c_custkey % 7 + 1)::int] || ' ' || {_list}[((c_custkey // 7) % 7 + 1)::int]")} as t from customer) {_concept_sql('vi')} union all {_concept_sql('en')}"


def area_insights(spark, sf, language: str, limit: int = 5):
    """The best areas with their evidence lists, texts and guardrail: places are grouped by area once for the scores, and once for the few best areas."""
    p = places(spark, sf)
    best = discovery.area_opportunity(p, discovery.CONCEPT).select("area", C.rounded(F.col("score")).alias("s"), C.rounded(F.col("demand")).alias("demand"), C.rounded(F.col("fit")).alias("fit"), "n", F.col("lat").alias("alat"), F.col("lon").alias("alon")).orderBy(F.desc("s"), "area").limit(limit)
    # limit rows, so the side that is broadcast has a fixed bound
    d = S.haystacks(p.withColumn("area", C.grid_key(F.col("lat"), F.col("lon"))).join(F.broadcast(best), "area"))
    d = S.once(d, direct=S.category_match(F.col("cat"), F.col("words"), "cafe") > 0.7, km=C.rounded(C.haversine_km(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon")), 3))
    d = S.once(d, kind=F.when(F.col("direct"), "competitor").when(I.complementary(F.col("cat"), F.col("words"), F.col("direct")), "complementary_poi")).where("kind is not null")
    order = [F.when(F.col("kind") == "competitor", F.col("km")).otherwise(0.0), F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), F.col("poi_id")]
    top = R.top_per_group(d, ["area", "kind"], order, 4).select("area", "kind", "rank", "name")
    cats = p.select(C.grid_key(F.col("lat"), F.col("lon")).alias("area"), "category").join(F.broadcast(best.select("area")), "area").groupBy("area", "category").agg(F.count(F.lit(1)).alias("c"))
    cats = R.top_per_group(cats, ["area"], [F.desc("c"), F.col("category")], 3).select("area", F.lit("category").alias("kind"), "rank", F.concat("category", F.lit(" ("), F.col("c").cast("string"), F.lit(")")).alias("name"))
    rows = top.unionByName(cats)
    of = lambda kind: R.ordered_array(F.when(F.col("kind") == kind, F.col("name")), F.when(F.col("kind") == kind, F.col("rank")))
    ids = F.array_sort(F.collect_list(F.concat_ws(":", "area", "kind", (F.col("rank") - 1).cast("string"))))
    packs = rows.groupBy("area").agg(*[F.filter(of(k), lambda x: x.isNotNull()).alias(k) for k in ("category", "complementary_poi", "competitor")], ids.alias("ids"))
    d = best.join(packs, "area")
    return S.once(d, text=I.insight(language, C.js_round(F.col("s") * 100.0), F.col("demand"), F.col("fit"), F.col("n"), F.col("category"), F.col("complementary_poi"), F.col("competitor")))


def business_insights(spark, sf):
    vi, en = (area_insights(spark, sf, x).select("area", F.lit(x).alias("language"), "text.*", F.array_join("ids", ",").alias("used_ids")) for x in ("vi", "en"))
    return vi.unionByName(en)


def _fill(template: str, **slots: str) -> str:
    parts = template.replace("}", "{").split("{")
    return "(" + " || ".join(f"({slots[p]})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts)) + ")"


def _insight_sql(language: str) -> str:
    t = I.TEXT[language]
    pct = lambda c: f"floor({c} * 100e0 + 0.5)::bigint || '%'"
    part = lambda kind: f"(select string_agg(name, ', ' order by rank) from ev where ev.area = best.area and kind = '{kind}' and rank <= 3)"
    return f"""select area, '{language}' as language, {_fill(t['summary'], score='floor(s * 100e0 + 0.5)::bigint', demand=pct('demand'), fit=pct('fit'), n='n')} as summary,
 {_fill(t['potential'], categories=f"coalesce({part('category')}, '{t['no_category']}')")} as potential, coalesce({_fill(t['complementary'], names=part('complementary_poi'))}, '{t['no_complementary']}') as complementary,
 coalesce({_fill(t['competition'], names=part('competitor'))}, '{t['no_competition']}') as risk, (select string_agg(id, ',' order by id) from (select area || ':' || kind || ':' || (rank - 1) as id, area as a from ev) where a = best.area) as used_ids from best"""


INSIGHT_CTE = f"""{discovery.AREA_CTE}, best as (select area, {Q.r('score')} as s, {Q.r('demand')} as demand, {Q.r('fit')} as fit, n, lat as alat, lon as alon from areas order by s desc, area limit 5),
dd as (select c.area, c.name, rating, review_count, poi_id, {Q.category('cafe')} > 0.7 as direct, {Q.any_of("(cat || ' ' || words)", I.SUPPORT)} as support, {Q.r(Q.km('alat', 'alon', 'c.lat', 'c.lon'), 3)} as km from cells c join best b on c.area = b.area),
kk as (select *, case when direct then 'competitor' when support then 'complementary_poi' end as kind from dd),
rr as (select area, kind, name, row_number() over (partition by area, kind order by case when kind = 'competitor' then km else 0e0 end, rating desc nulls last, review_count desc nulls last, poi_id) as rank from kk where kind is not null),
cc as (select c.area, category, count(*) as n from cells c join best b on c.area = b.area group by 1, 2), ct as (select area, category || ' (' || n || ')' as name, row_number() over (partition by area order by n desc, category) as rank from cc),
ev as (select area, kind, name, rank from rr where rank <= 4 union all select area, 'category', name, rank from ct where rank <= 3)"""
INSIGHT_SQL = f"with {INSIGHT_CTE} {_insight_sql('vi')} union all {_insight_sql('en')}"
CLAIMS = ["", " Guaranteed revenue.", " Real footfall is high.", " Mật độ khách thật cao."]


def insight_guardrail(spark, sf):
    """Texts with added claims and an added id, against the evidence: a customer's comment on each text."""
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("claim_id"), F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (k % 4 + 1).cast("int")).alias("claim"))
    allowed = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: F.concat(F.lit("area:"), x.cast("string")))
    g = I.guardrail(F.concat(F.lit("This area scores well."), F.col("claim")), F.when(F.col("claim_id") % 3 == 0, "real footfall, rent price"), F.array(F.concat(F.lit("area:"), (F.col("claim_id") % 9).cast("string"))), allowed)
    return d.select("claim_id", g.alias("g")).select("claim_id", F.array_join("g.unknown", ",").alias("unknown"), F.array_join("g.unsafe", ",").alias("unsafe"), "g.passed")


GUARD_SQL = """with c as (select c_custkey as claim_id, case when c_custkey % 9 > 6 then 'area:' || c_custkey % 9 else '' end as unknown,
 case c_custkey % 4 when 1 then 'guaranteed revenue' when 2 then case when c_custkey % 3 = 0 then '' else 'real footfall' end when 3 then 'mật độ khách thật' else '' end as unsafe from customer)
select claim_id, unknown, unsafe, unknown = '' and unsafe = '' as passed from c"""

QUERIES = {f.__name__: f for f in (concept_parse, business_insights, insight_guardrail)}
ORACLE_SQL = {"concept_parse": CONCEPT_SQL, "business_insights": INSIGHT_SQL, "insight_guardrail": GUARD_SQL}
