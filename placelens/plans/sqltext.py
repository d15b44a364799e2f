"""Pieces of oracle SQL."""

from ..operators.scoring import INTENTS, TAGS, detect_intents, plain, query_tokens
from ..sources.tables import PLACES_SQL


def norm(x: str) -> str:
    return f"lower(replace(replace(strip_accents(coalesce({x}, '')), 'đ', 'd'), 'Đ', 'D'))"


def r(x: str, n: int = 6) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def clamp01(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def has(doc: str, term: str) -> str:
    return f"contains({doc}, '{term}')"


def any_of(doc: str, terms) -> str:
    return "(" + " or ".join(has(doc, t) for t in terms) + ")"


def keyword(query: str, doc: str) -> str:
    ts = list(dict.fromkeys(query_tokens(query)))
    return "((" + " + ".join(f"{has(doc, t)}::int" for t in ts) + f") / {len(ts)}e0)"


def rating(x: str) -> str:
    return f"(case when {x} is null or {x} = 0 then 0.35e0 when {x} > 5 then {clamp01(f'{x} / 10e0')} else {clamp01(f'{x} / 5e0')} end)"


def review(x: str) -> str:
    return clamp01(f"log10(coalesce({x}, 0) + 1e0) / 3e0")


def km(a, b, c, d) -> str:
    return f"(2 * 6371e0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def metres(a, b, c, d) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def category(intent, cat: str = "cat", words: str = "words") -> str:
    if intent is None:
        return "0.5e0"
    terms, cats = INTENTS[intent]
    return f"(case when {any_of(cat, cats)} then 1e0 when {any_of(words, terms)} then 0.72e0 else 0.12e0 end)"


def tags(hay: str, keys) -> str:
    if not keys:
        return "0e0"
    return "((" + " + ".join(f"{any_of(hay, [plain(t) for t in TAGS.get(k, [k])])}::int" for k in keys) + f") / {len(keys)}e0)"


def weights(hay: str, w: dict) -> str:
    return "greatest(0e0, " + ", ".join(f"case when {has(hay, plain(k))} then {v}e0 else 0e0 end" for k, v in w.items()) + ")"


HAY = f"""{PLACES_SQL},
hay as (select *, {norm("concat_ws(' ', name, category, text, district)")} as hay, {norm('category')} as cat, {norm("concat_ws(' ', name, text)")} as words from poi)"""


def scored(query: str, location, persona, liked, disliked, penalty, max_km=14) -> str:
    """CTEs up to scored: the columns of hay, distance_km, s_category, score."""
    intent = next(iter(detect_intents(query)), (None,))[0]
    distance = km(f"{location[0]}e0", f"{location[1]}e0", "lat", "lon") if location else "null::double"
    near = clamp01(f"1e0 - distance_km / {max_km}e0") if location else "0.5e0"
    taste = clamp01(f"({tags('hay', [persona]) if persona else '0.35e0'}) * 0.34e0 + {tags('hay', list(liked))} * 0.66e0")
    return f"""{HAY},
sig as (select *, {distance} as distance_km, {keyword(query, 'hay')} as s_keyword, {category(intent)} as s_category, {rating('rating')} as s_rating, {review('review_count')} as s_review, {taste} as s_preference from hay),
scored as (select *, {clamp01(f"s_keyword * 0.28e0 + s_category * 0.22e0 + s_preference * 0.18e0 + s_rating * 0.13e0 + {near} * 0.11e0 + s_review * 0.08e0 - least({weights('hay', penalty)} * 0.08e0 + {tags('hay', list(disliked))} * 0.16e0, 0.34e0)")} as score from sig)"""
