"""Intents, place scores, reranking: column expressions over small literal dictionaries, no joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import clamp, clamp01, contains_any, distance_score, haversine_km, hits, keyword_score, normalize_text, query_tokens, rating_score, review_signal, total

#: Intents with their terms in queries and in categories, in order: fixed values.
INTENTS = {
    "cafe": (["cafe", "ca phe", "coffee", "coffe", "dessert", "tra sua", "hoc bai", "yen tinh"], ["cafe", "ca phe", "coffee", "dessert", "tra sua"]),
    "seafood": (["hai san", "seafood", "gan bien", "bien"], ["hai san", "seafood", "nha hang"]),
    "food": (["quan an", "an vat", "via he", "mon an", "binh dan"], ["quan an", "an vat", "via he", "food"]),
    "pub": (["quan nhau", "nhau", "bia", "beer", "dem"], ["quan nhau", "nhau", "bar", "beer"]),
    "travel": (["di choi", "check in", "tham quan", "lich trinh", "du lich"], ["diem du lich", "bao tang", "bien", "park"]),
}

#: Terms of each taste tag: fixed values.
TAGS = {
    "beach_view": ["bien", "beach", "sea", "ocean", "ngam bien"],
    "riverfront": ["song", "river", "riverfront", "ven song", "han"],
    "hidden_gems": ["hidden", "an minh", "hem", "local", "yen tinh"],
    "amusement_parks": ["khu vui choi", "amusement", "park", "cong vien", "game"],
    "rooftop_city_view": ["rooftop", "city view", "view", "tang thuong"],
    "deep_work_study": ["hoc bai", "study", "work", "cowork", "yen tinh", "cafe"],
    "casual_socializing": ["social", "gap go", "ban be", "cafe", "restaurant"],
    "weekend_chill": ["chill", "weekend", "thu gian", "cafe", "beach"],
    "late_night_hangouts": ["dem", "night", "late", "bar", "nhau"],
    "solo": ["solo", "mot minh", "quiet", "yen tinh"],
    "dating_romantic": ["hen ho", "romantic", "lang man", "view", "rooftop"],
    "friends_gathering": ["ban be", "group", "nhom", "nhau", "quan an"],
    "family_friendly": ["family", "gia dinh", "tre em", "nha hang"],
    "overcrowded_places": ["dong", "crowded", "hot", "famous"],
    "loud_music_noisy": ["karaoke", "bar", "pub", "music", "nhac", "on ao"],
    "no_parking_space": ["hem", "small", "nho", "parking"],
    "high_pricing": ["premium", "luxury", "cao cap", "expensive"],
    "student": ["hoc bai", "study", "sinh vien", "cafe", "budget"],
    "remote_worker": ["work", "cowork", "wifi", "yen tinh", "cafe"],
    "tourist": ["tourist", "du lich", "check in", "beach", "heritage"],
    "local_explorer": ["local", "hidden", "an minh", "quan an", "hem"],
}

#: Terms of each explicit taste tag, fewer than above: fixed values.
EXPLICIT_TAGS = {
    "beach_view": ["bien", "beach", "sea", "ngam bien"],
    "riverfront": ["song", "river", "ven song", "han"],
    "hidden_gems": ["hidden", "an minh", "hem", "local", "yen tinh"],
    "amusement_parks": ["khu vui choi", "amusement", "park", "cong vien"],
    "rooftop_city_view": ["rooftop", "city view", "view", "tang thuong"],
    "deep_work_study": ["hoc bai", "study", "work", "cowork", "yen tinh", "cafe"],
    "casual_socializing": ["gap go", "social", "ban be", "cafe", "restaurant"],
    "weekend_chill": ["chill", "weekend", "thu gian", "cafe", "beach"],
    "late_night_hangouts": ["dem", "night", "late", "bar", "nhau"],
    "solo": ["solo", "mot minh", "quiet", "yen tinh"],
    "dating_romantic": ["hen ho", "romantic", "lang man", "view"],
    "friends_gathering": ["ban be", "group", "nhom", "nhau", "quan an"],
    "family_friendly": ["family", "gia dinh", "tre em", "nha hang"],
    "student": ["hoc bai", "study", "sinh vien", "cafe", "budget"],
    "remote_worker": ["work", "cowork", "wifi", "yen tinh", "cafe"],
    "tourist": ["tourist", "du lich", "check in", "beach"],
    "local_explorer": ["local", "hidden", "an minh", "quan an", "hem"],
}


def plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D").lower()


def detect_intents(query: str) -> list[tuple[str, int]]:
    """(intent, number of its query terms held), most first; equal ones in the order above."""
    q = plain(query)
    found = [(name, sum(t in q for t in terms)) for name, (terms, _) in INTENTS.items()]
    return sorted([x for x in found if x[1]], key=lambda x: -x[1])


def intent_column(text: Column, normalized: bool = False) -> Column:
    """The first intent of a column of queries, as a struct (intent, score); null where there is none."""
    q = text if normalized else normalize_text(text)
    scored = [F.struct(hits(q, terms).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("intent")) for i, (name, (terms, _)) in enumerate(INTENTS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, F.struct(best["intent"].alias("intent"), best["score"].alias("score")))


def category_match(category: Column, text: Column, intent: str | None) -> Column:
    """category and text: normalized."""
    if intent is None:
        return F.lit(0.5)
    terms, categories = INTENTS[intent]
    return F.when(contains_any(category, categories), 1.0).when(contains_any(text, terms), 0.72).otherwise(0.12)


def tag_score(haystack: Column, tags: list[str]) -> Column:
    return clamp01(total([contains_any(haystack, [plain(t) for t in TAGS.get(tag, [tag])]).cast("int") for tag in tags]) / float(max(len(tags), 1)))


def weight_max(haystack: Column, weights: dict[str, float]) -> Column:
    """Largest weight whose key is part of the text, 0 at least; an empty key is part of all."""
    if not weights:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), *[F.when(F.contains(haystack, F.lit(plain(k))), float(w)).otherwise(0.0) for k, w in weights.items()], F.lit(0.0))


def explicit_terms(tag: str) -> list[str]:
    """The tag's terms (itself, if it has none) as parts of a clean key."""
    import re

    return [re.sub("[^a-z0-9]+", "_", plain(t)).strip("_") for t in EXPLICIT_TAGS.get(tag, [tag])]


def explicit_score(key: Column, tags: list[str]) -> Column:
    """Share of the tags that have a term in a place's text, given as a clean key."""
    return clamp01(total([contains_any(key, explicit_terms(t)).cast("int") for t in tags]) / float(max(len(tags), 1)))


def dwell_fit(style: str, text: Column) -> Column:
    """Whether a place's category and name suit long stays (75 minutes and more) or short ones (under 25)."""
    if style == "long_stay":
        return F.when(text.rlike("(?i)cafe|coffee|study|cowork|restaurant|bar"), 0.85).otherwise(0.5)
    return F.when(text.rlike("(?i)takeaway|bakery|tea|juice|fast"), 0.8).otherwise(0.5) if style == "quick_stop" else F.lit(0.5)


def once(df, **columns: Column):
    """Adds columns that are computed once a row: Spark neither pushes filters through this nor repeats the expressions in what is built on them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def haystacks(df):
    """hay, cat, words: the folded texts that scores look into; each part is folded once."""
    parts = once(df, cat=normalize_text(F.col("category")), n_name=normalize_text(F.col("name")), n_text=normalize_text(F.col("text")), n_district=normalize_text(F.col("district")))
    return once(parts, hay=F.concat_ws(" ", "n_name", "cat", "n_text", "n_district"), words=F.concat_ws(" ", "n_name", "n_text")).drop("n_name", "n_text", "n_district")


def score_places(df, query: str, location: tuple[float, float] | None = None, max_km: float = 14.0, persona: str | None = None, liked: list[str] = (), disliked: list[str] = (), category_penalty: dict[str, float] | None = None, semantic: Column | None = None):
    """df with the signals and the score. Text is normalized once, in hay."""
    intent = next(iter(detect_intents(query)), (None,))[0]
    d = haystacks(df)
    km = haversine_km(F.lit(location[0]), F.lit(location[1]), F.col("lat"), F.col("lon")) if location else F.lit(None).cast("double")
    likes = list(dict.fromkeys(liked))
    taste = clamp01((tag_score(F.col("hay"), [persona]) if persona else F.lit(0.35)) * 0.34 + tag_score(F.col("hay"), likes) * 0.66)
    d = once(
        d, distance_km=km, s_keyword=keyword_score(query, F.col("hay")), s_category=category_match(F.col("cat"), F.col("words"), intent), s_rating=rating_score(F.col("rating")), s_review=review_signal(F.col("review_count")),
        s_distance=distance_score(km, max_km) if location else F.lit(0.5), s_preference=taste,
    )
    without = F.col("s_keyword") * 0.28 + F.col("s_category") * 0.22 + F.col("s_preference") * 0.18 + F.col("s_rating") * 0.13 + F.col("s_distance") * 0.11 + F.col("s_review") * 0.08
    base = without
    if semantic is not None:
        with_model = F.col("s_keyword") * 0.20 + F.col("s_category") * 0.20 + F.col("s_preference") * 0.17 + F.col("s_rating") * 0.12 + F.col("s_distance") * 0.08 + F.col("s_review") * 0.05 + semantic * 0.18
        base = F.when(semantic.isNull(), without).otherwise(with_model)
    penalty = F.least(weight_max(F.col("hay"), category_penalty or {}) * 0.08 + tag_score(F.col("hay"), list(disliked)) * 0.16, F.lit(0.34))
    warnings = F.array_compact(F.array(F.when(F.col("distance_km") > 10, "far"), F.when((F.col("s_category") < 0.3) & F.lit(intent is not None), "category"), F.when(F.col("rating").isNull() | (F.col("rating") == 0), "no_rating")))
    return once(d, score=clamp01(base - penalty)).withColumn("warnings", warnings)


def rerank(scored, query: str, place: dict[str, float], categories: dict[str, float], intents: dict[str, dict[str, float]], penalties: dict[str, float], memory_places: dict | None = None, memory_categories: dict[str, float] | None = None, rate: float = 0.08, memory_rate: float = 0.08):
    """Adds delta and moves the score by it. Weights by place are a map literal when small; larger ones belong in a joined table."""
    def by_id(weights):
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (int(k), float(v))]), F.col("poi_id")), F.lit(0.0)) if weights else F.lit(0.0)

    boost = by_id(place) + weight_max(F.col("cat"), categories) + total([weight_max(F.col("cat"), intents.get(name, {})) for name, _ in detect_intents(query)])
    memory = by_id(memory_places or {}) + weight_max(F.col("cat"), memory_categories or {})
    delta = clamp01(boost * rate) + clamp(memory * memory_rate, -0.32, 0.32) - clamp01(by_id(penalties) * rate)
    return once(scored, delta=delta).withColumn("score", clamp01(F.col("score") + F.col("delta")))


__all__ = ["INTENTS", "TAGS", "category_match", "detect_intents", "intent_column", "plain", "query_tokens", "rerank", "score_places", "tag_score", "weight_max"]
