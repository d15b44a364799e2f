"""Synthetic samples, training pairs, reranker weights and the learning loop over the place view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators.scoring import INTENTS
from ..sources.tables import EVENTS_SQL, PLACES_SQL, places, profile_events
from . import sqltext as Q

COUNT = 120


def _samples(spark, sf):
    return L.synthetic_samples(spark, places(spark, sf), COUNT)


def synthetic_samples(spark, sf):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    expected = F.array_join(F.transform("expected", lambda x: F.concat(x["role"], F.lit(":"), x["poi_id"].cast("string"))), ",")
    return _samples(spark, sf).select("index", "sample_id", "segment", "scenario", "query", expected.alias("expected"), ids(F.col("negatives")).alias("negatives"), ids(F.col("pool")).alias("pool"))


def _text(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(ids: str, seed: str, n: int) -> str:
    return f"list_transform(list_sort(list_transform({ids}, lambda x: struct_pack(h := sha1({seed} || '_' || x)[:8], id := x)))[1:{n}], lambda s: s.id)"


_kinds = " union all ".join(
    [f"select origin, 'intent:{i}' as k, poi_id, {Q.r(f'm_{i} * 5e0 + rating * 0.7e0 + ln(1 + reviews) * 0.1e0 - km * 0.08e0')} as score, 0e0 as tie from near where m_{i} >= 0.7e0" for i in INTENTS]
    + [f"select origin, 'hard:{s}', poi_id, {Q.r('rating + ln(1 + reviews) * 0.15e0 + least(len / 1200e0, 1e0)')}, km from near where 1e0 - greatest({', '.join(f'm_{i}' for i in intents)}) >= 0.28e0" for s, (intents, _) in L.SCENARIOS.items()]
    + [f"select origin, 'near:', poi_id, {Q.r('rating')}, -reviews from near where km <= 12"]
)
_intents = "[" + ", ".join(_text(i) for i, _ in L.SCENARIOS.values()) + "]"
_texts = "[" + ", ".join(_text(t) for _, t in L.SCENARIOS.values()) + "]"


def _slot(j: int) -> str:
    used = "[" + ", ".join(f"pick{i}" for i in range(j)) + "]"
    ids = f"list_filter(coalesce(list_extract(map_extract(lists, 'intent:' || intents[{j + 1}]), 1), []), lambda x: not coalesce(list_contains({used}, x), false))[1:18]"
    return f"s{j} as (select *, {_pick(ids, f"(seed || '_' || intents[{j + 1}] || '_' || index)", 1)}[1] as pick{j} from {'base' if j == 0 else f's{j - 1}'})"


SAMPLES_CTE = f"""{Q.HAY},
m as (select poi_id, lat, lon, coalesce(rating, 0e0) as rating, coalesce(review_count, 0) as reviews, length(words) + 1 + length(cat) as len, {', '.join(f'{Q.category(i)} as m_{i}' for i in INTENTS)} from hay),
o as (select * from (values {', '.join(f'({i}, {a}e0, {b}e0)' for i, (a, b) in enumerate(L.ORIGINS))}) as t(origin, olat, olon)),
near as (select * from (select m.*, origin, {Q.r(Q.km('olat', 'olon', 'lat', 'lon'))} as km from m, o) where km <= 14),
rows as ({_kinds}),
ranked as (select *, row_number() over (partition by origin, k order by score desc, tie, poi_id) as rank from rows),
per as (select origin, k, list(poi_id order by rank) as ids from ranked where rank <= 83 group by 1, 2), lists as (select origin, map(list(k), list(ids)) as lists from per group by 1),
i as (select i as index, (i % 4)::int as origin, (i % 35) // 7 as p, (i % 35) % 7 as s from range({COUNT}) as t(i)),
d as (select index, origin, {_text(L.PERSONAS)}[p + 1] as segment, {_text(m for _, m, _ in L.PERSONAS.values())}[p + 1] as mobility, {_text(L.SCENARIOS)}[s + 1] as scenario, {_intents}[s + 1] as intents, {_texts}[s + 1] as texts, {list(L.DURATIONS)}[index % 4 + 1] as minutes from i),
e as (select *, segment || '_' || scenario as seed, case when sha1(segment || '_' || scenario || '_' || index || '_0')[:8] <= sha1(segment || '_' || scenario || '_' || index || '_1')[:8] then 1 else 2 end as which from d),
base as (select e.*, replace(replace(texts[which], '{{duration}}', floor(minutes / 60 + 0.5)::int::varchar), '{{transport}}', case when mobility = 'car' then 'oto/Grab' else 'xe may' end) as query, lists from e join lists on e.origin = lists.origin),
{', '.join(_slot(j) for j in range(3))},
u as (select *, list_filter([pick0, pick1, pick2], lambda x: x is not null) as used from s2),
v as (select *, list_filter([struct_pack(role := intents[1], poi_id := pick0), struct_pack(role := intents[2], poi_id := pick1), struct_pack(role := intents[3], poi_id := pick2)], lambda x: x.poi_id is not null) as expected,
  {_pick("list_filter(coalesce(list_extract(map_extract(lists, 'hard:' || scenario), 1), []), lambda y: not list_contains(used, y))[1:80]", "(seed || '_neg_' || index)", 10)} as negatives,
  list_filter(coalesce(list_extract(map_extract(lists, 'near:'), 1), []), lambda x: not list_contains(used, x))[index % 20 + 1:index % 20 + 18] as around from u),
w as (select *, list_concat(around, used, negatives) as every from v where len(used) > 0),
samples as (select *, 'synth_' || sha1(seed || '_' || index || '_' || query)[:12] as sample_id, list_filter(every, lambda x, n: list_position(every, x) = n) as pool from w)"""
SAMPLES_SQL = f"with {SAMPLES_CTE} select index, sample_id, segment, scenario, query, array_to_string(list_transform(expected, lambda x: x.role || ':' || x.poi_id), ',') as expected, array_to_string(negatives, ',') as negatives, array_to_string(pool, ',') as pool from samples"


def training_pairs(spark, sf):
    p = L.training_pairs(_samples(spark, sf), places(spark, sf))
    return p.select("sample_id", "record_type", "label", "role", "poi_id", F.md5("semantic_text").alias("text_md5"))


PAIRS_SQL = f"""with {SAMPLES_CTE},
x as (select sample_id, unnest(expected) as e from samples), n as (select sample_id, unnest(negatives) as poi_id from samples),
pairs as (select sample_id, 'query_positive_poi' as record_type, 1 as label, e.role as role, e.poi_id as poi_id from x union all select sample_id, 'persona_memory_positive', 1, 'long_term_preference', e.poi_id from x
  union all select sample_id, 'query_negative_poi', 0, 'hard_negative_candidate', poi_id from n
  union all select sample_id, 'query_negative_poi', 0, 'hard_negative_candidate', unnest(list_filter(pool, lambda p: not list_contains(used, p))[1:8]) from samples where len(negatives) = 0)
select sample_id, record_type, label, role, pairs.poi_id, md5(left(concat_ws(' | ', nullif(name, ''), nullif(category, ''), nullif(district, ''), nullif(text, '')), 1200)) as text_md5 from pairs join poi on poi.poi_id = pairs.poi_id"""


def _weights(spark, sf, samples):
    return L.reranker_weights(samples, places(spark, sf), profile_events(spark, sf))


def reranker_weights(spark, sf):
    return _weights(spark, sf, _samples(spark, sf))


WEIGHTS_CTE = f"""{SAMPLES_CTE}, {EVENTS_SQL}, cats as (select poi_id, trim(split_part({Q.norm('category')}, ',', 1)) as category from poi),
x as (select intents, unnest(expected).poi_id as poi_id from samples), xc as (select x.*, c.category from x join cats c on c.poi_id = x.poi_id), xi as (select unnest(intents) as intent, category from xc),
n as (select intents, unnest(negatives) as poi_id from samples), ni as (select unnest(intents) as intent, poi_id from n),
f as (select ev.kind, ev.poi_id, c.category from ev join cats c on c.poi_id = ev.poi_id where kind in ('add_to_itinerary', 'poi_not_fit')),
parts as (select 'poi' as kind, '' as intent, poi_id::varchar as key, 1e0 as w from xc union all select 'category', '', category, 0.45e0 from xc union all select 'intent_category', intent, category, 0.6e0 from xi
  union all select 'intent_penalty', intent, poi_id::varchar, 0.45e0 from ni
  union all select case kind when 'poi_not_fit' then 'penalty' else 'poi' end, '', poi_id::varchar, 0.8e0 from f union all select 'category', '', category, case kind when 'poi_not_fit' then -0.15e0 else 0.25e0 end from f),
weights as (select kind, intent, key, {Q.r("case when kind = 'intent_penalty' then greatest(-2.5e0, least(2.5e0, sum(w))) else greatest(-4e0, least(4e0, sum(w))) end", 4)} as weight from parts group by 1, 2, 3)"""


def learning_loop_eval(spark, sf):
    samples = _samples(spark, sf)
    return L.learning_loop(samples, _weights(spark, sf, samples))


LOOP_SQL = f"""with {WEIGHTS_CTE},
sl as (select index, used, unnest(range(1, len(intents) + 1)) as slot, intents, lists from samples),
sr as (select index, used, slot, unnest(range(1, 19)) as rank, list_extract(map_extract(lists, 'intent:' || intents[slot]), 1) as ids from sl),
sc as (select index, used, slot, rank, ids[rank] as poi_id, coalesce(weight, 0e0) as weight from sr left join weights on kind = 'poi' and key = ids[rank]::varchar where ids[rank] is not null),
b as (select index, used, slot, first(poi_id order by rank) as before, first(poi_id order by weight desc, rank) as after from sc group by 1, 2, 3),
st as (select index, used, 'before' as stage, list(distinct before) as p, list(before order by slot) as o from b group by 1, 2 union all select index, used, 'after', list(distinct after), list(after order by slot) from b group by 1, 2),
t as (select *, list_filter(o, lambda x, n: list_position(o, x) = n)[1:greatest(1, len(used))] as top from st),
mt as (select stage, len(list_intersect(top, used)) * 1e0 / len(top) as p, len(list_intersect(p, used)) * 1e0 / len(used) as r from t),
g as (select stage, {Q.r('p', 4)} as p4, {Q.r('r', 4)} as r4, {Q.r('case when p + r > 0 then 2 * p * r / (p + r) else 0e0 end', 4)} as f4, case when r > 0 then 1e0 else 0e0 end as h from mt)
select stage, count(*) as n, {Q.r('avg(p4)', 4)} as precision, {Q.r('avg(r4)', 4)} as recall, {Q.r('avg(f4)', 4)} as f1, {Q.r('avg(h)', 4)} as hit from g group by 1"""

QUERIES = {f.__name__: f for f in (synthetic_samples, training_pairs, reranker_weights, learning_loop_eval)}
ORACLE_SQL = {"synthetic_samples": SAMPLES_SQL, "training_pairs": PAIRS_SQL, "reranker_weights": f"with {WEIGHTS_CTE} select kind, intent, key, weight from weights", "learning_loop_eval": LOOP_SQL}
