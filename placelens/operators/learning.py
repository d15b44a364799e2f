"""Samples, training pairs and weights for ranking models, and their evaluation.

A sample draws from short candidate lists that depend on its start and intents only. The lists are ranked once over all places, for each start, in one
pass with a bounded window; samples then work on arrays of bounded length and never scan the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp, haversine_km, normalize_text, rounded
from . import relational as R
from .scoring import INTENTS, category_match, haystacks, once
from .serializers import semantic_text

#: Starts, people, scenes and durations of synthetic samples: fixed values.
ORIGINS = ((16.0544, 108.2022), (16.0617, 108.2474), (16.0731, 108.1539), (16.0901, 108.2452))
PERSONAS = {
    "student": ("medium", "motorbike", ("quiet", "study", "wifi", "moderate_price")), "tourist": ("medium", "car", ("near_beach", "seafood", "check_in", "high_rating")),
    "young_professional": ("high", "car", ("dessert", "premium", "meeting", "central")), "family": ("medium", "car", ("family_friendly", "clean", "easy_route", "safe")),
    "business_owner": ("startup", "motorbike", ("demand_signal", "complementary_poi", "low_competition")),
}
SCENARIOS = {
    "study_cafe_food": (("food", "cafe"), (
        "Toi muon an nhe roi tim cafe yen tinh de hoc bai trong {duration} gio.", "Tao lich trinh cho sinh vien: co quan an vua tien va cafe ngoi lau, di bang {transport}.")),
    "tourist_seafood_cafe_beach": (("seafood", "travel", "cafe"), (
        "Tao lich trinh toi nay co hai san, diem check-in va cafe gan bien trong {duration} gio.", "Khach du lich muon an hai san roi di choi va ghe cafe dep gan bien.")),
    "dessert_cafe_meeting": (("cafe", "food"), (
        "Goi y noi gap ban co banh ngot, cafe dep va de di bang {transport}.", "Toi can lich trinh nhe co dessert va cafe khong gian dep trong {duration} gio.")),
    "pub_late_food": (("food", "pub"), (
        "Nhom ban muon an toi roi ghe quan nhau vui nhung duong di khong qua kho.", "Lap lich trinh buoi dem co quan an va cho uong bia phu hop nhom ban.")),
    "family_food_travel": (("food", "travel"), (
        "Gia dinh toi muon di an va tham quan nhe nha, uu tien duong de di.", "Tao lich trinh {duration} gio cho gia dinh co bua an va diem di choi an toan.")),
    "business_location_cafe": (("cafe", "food"), (
        "Mo tiem banh ngot va cafe gan khu sinh vien, can khu co nhu cau nhung doi thu vua phai.", "Phan tich vi tri mo cafe dessert o Da Nang, uu tien POI bo tro va de tiep can.")),
    "business_location_seafood": (("seafood", "travel"), (
        "Mo nha hang hai san gan cum du lich, can danh gia demand proxy va canh tranh.", "Tim khu vuc phu hop cho quan hai san phuc vu khach du lich Da Nang.")),
}
DURATIONS = (120, 180, 240, 360)
#: Bounds of the lists, and what each keeps in reserve for places that a sample has used already.
TOP, HARD, NEAR, PAGE, NEGATIVES, SPARE = 18, 80, 18, 20, 10, 3


def candidate_lists(places: DataFrame) -> DataFrame:
    """origin, kind, name, ids: the best places of each intent, those that look good but fit no intent of a scene, and the best rated ones nearby."""
    d = haystacks(places)
    d = once(d, **{f"m_{i}": category_match(F.col("cat"), F.col("words"), i) for i in INTENTS}, length=F.length("words") + 1 + F.length("cat"))
    starts = F.array(*[F.struct(F.lit(i).alias("origin"), F.lit(a).alias("olat"), F.lit(b).alias("olon")) for i, (a, b) in enumerate(ORIGINS)])
    d = d.select("poi_id", "lat", "lon", F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("review_count", F.lit(0)).alias("reviews"), "length", *[f"m_{i}" for i in INTENTS], F.inline(starts))
    d = once(d, km=rounded(haversine_km(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon")))).where("km <= 14")
    row = lambda kind, name, when, score: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), rounded(score).alias("score")))
    by_intent = [row("intent", i, F.col(f"m_{i}") >= 0.7, F.col(f"m_{i}") * 5.0 + F.col("rating") * 0.7 + F.log1p("reviews") * 0.1 - F.col("km") * 0.08) for i in INTENTS]
    quality = F.col("rating") + F.log1p("reviews") * 0.15 + F.least(F.col("length") / 1200.0, F.lit(1.0))
    hard = [row("hard", s, 1.0 - F.greatest(*[F.col(f"m_{i}") for i in intents]) >= 0.28, quality) for s, (intents, _) in SCENARIOS.items()]
    near = [row("near", "", F.col("km") <= 12, F.col("rating"))]
    rows = d.select("origin", "poi_id", "km", "reviews", F.inline(F.array_compact(F.array(*by_intent, *hard, *near))))
    tie = F.when(F.col("kind") == "hard", F.col("km")).when(F.col("kind") == "near", -F.col("reviews").cast("double")).otherwise(0.0)
    top = R.top_per_group(rows, ["origin", "kind", "name"], [F.desc("score"), tie, F.col("poi_id")], HARD + SPARE)
    return top.groupBy("origin", "kind", "name").agg(R.ordered_array(F.col("poi_id"), F.col("rank")).alias("ids"))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat(*[p.cast("string") for p in parts])), 1, 8)


def pick(ids: Column, seed: Column, n: int) -> Column:
    """n ids in the order of a hash: the same for the same seed."""
    hashed = F.array_sort(F.transform(ids, lambda x: F.struct(short_hash(seed, F.lit("_"), x).alias("h"), x.alias("id"))))
    return F.transform(F.slice(hashed, 1, n), lambda s: s["id"])


def synthetic_samples(spark: SparkSession, places: DataFrame, count: int) -> DataFrame:
    """Samples 0 to count - 1: person and scene in turn, expected places by role, hard negatives and a pool of candidates."""
    lists = candidate_lists(places)
    maps = lists.groupBy("origin").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "name"), "ids"))).alias("lists"))
    at = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    combo = F.col("index") % (len(PERSONAS) * len(SCENARIOS))
    people = [F.struct(F.lit(p).alias("segment"), F.lit(m).alias("mobility")) for p, (_, m, _) in PERSONAS.items()]
    scenes = [F.struct(F.lit(s).alias("scenario"), F.array(*[F.lit(i) for i in intents]).alias("intents"), F.array(*[F.lit(t) for t in texts]).alias("texts")) for s, (intents, texts) in SCENARIOS.items()]
    d = spark.range(count).select(F.col("id").alias("index"))
    d = d.select("index", (F.col("index") % len(ORIGINS)).cast("int").alias("origin"), at(people, F.floor(combo / len(SCENARIOS))).alias("p"), at(scenes, combo % len(SCENARIOS)).alias("s"), at([F.lit(x) for x in DURATIONS], F.col("index") % len(DURATIONS)).alias("minutes"))
    seed = F.concat_ws("_", "p.segment", "s.scenario")
    d = d.select("index", "origin", "p.segment", "p.mobility", "s.scenario", "s.intents", "minutes", seed.alias("seed"), F.element_at(pick(F.array(F.lit(0), F.lit(1)), F.concat_ws("_", seed, F.col("index").cast("string")), 1), 1).alias("which"), "s.texts")
    text = F.replace(F.element_at("texts", F.col("which") + 1), F.lit("{duration}"), F.floor(F.col("minutes") / 60 + 0.5).cast("string"))
    d = d.withColumn("query", F.replace(text, F.lit("{transport}"), F.when(F.col("mobility") == "car", "oto/Grab").otherwise("xe may"))).drop("texts", "which")
    d = d.join(F.broadcast(maps), "origin", "left")  # a row for each of ORIGINS, of bounded lists
    none = F.array().cast("array<bigint>")
    index = F.col("index").cast("string")
    listed = lambda key: F.coalesce(F.try_element_at("lists", key), none)
    free = lambda ids, used: F.filter(ids, lambda x: ~F.array_contains(used, x))
    d = d.withColumn("used", none)
    for j in range(3):
        role = F.get("intents", F.lit(j))
        found = pick(F.slice(free(listed(F.concat(F.lit("intent:"), role)), F.col("used")), 1, TOP), F.concat_ws("_", "seed", role, index), 1)
        d = once(d, **{f"pick{j}": F.get(found, F.lit(0))}).withColumn("used", F.array_compact(F.concat("used", F.array(F.col(f"pick{j}")))))
    expected = F.filter(F.transform(F.arrays_zip(F.array(*[F.get("intents", F.lit(j)) for j in range(3)]).alias("role"), F.array("pick0", "pick1", "pick2").alias("poi_id")), lambda x: F.struct(x["role"].alias("role"), x["poi_id"].alias("poi_id"))), lambda x: x["poi_id"].isNotNull())
    negatives = pick(F.slice(free(listed(F.concat(F.lit("hard:"), F.col("scenario"))), F.col("used")), 1, HARD), F.concat_ws("_", "seed", F.lit("neg"), index), NEGATIVES)
    d = once(d, expected=expected, negatives=negatives, near=F.slice(free(listed(F.lit("near:")), F.col("used")), (F.col("index") % PAGE + 1).cast("int"), NEAR))
    sample = F.concat(F.lit("synth_"), F.substring(F.sha1(F.concat_ws("_", "seed", index, "query")), 1, 12))
    return d.where(F.size("expected") > 0).select("index", sample.alias("sample_id"), "segment", "scenario", "origin", "intents", "query", "expected", "negatives", F.array_distinct(F.concat("near", "used", "negatives")).alias("pool"), "lists")


def training_pairs(samples: DataFrame, places: DataFrame) -> DataFrame:
    """sample_id, record_type, label, role and the place: expected places, negatives (else other places of the pool) and remembered places."""
    item = lambda kind, label, role, poi: F.struct(F.lit(kind).alias("record_type"), F.lit(label).alias("label"), role.alias("role"), poi.alias("poi_id"))
    good = F.transform("expected", lambda x: item("query_positive_poi", 1, x["role"], x["poi_id"]))
    memory = F.transform("expected", lambda x: item("persona_memory_positive", 1, F.lit("long_term_preference"), x["poi_id"]))
    known = F.transform("expected", lambda x: x["poi_id"])
    explicit = F.slice(F.array_except("negatives", known), 1, 10)
    other = F.when(F.size(explicit) > 0, explicit).otherwise(F.slice(F.array_except("pool", known), 1, 8))
    bad = F.transform(other, lambda x: item("query_negative_poi", 0, F.lit("hard_negative_candidate"), x))
    rows = samples.select("sample_id", F.inline(F.concat(good, bad, memory)))
    return rows.join(places.select("poi_id", semantic_text(*[F.col(c) for c in ("name", "category", "district", "text")]).alias("semantic_text")), "poi_id")


def category_key(c: Column) -> Column:
    """Normalized, up to the first comma."""
    return F.trim(F.substring_index(normalize_text(c), ",", 1))


def reranker_weights(samples: DataFrame, places: DataFrame, feedback: DataFrame) -> DataFrame:
    """kind, intent, key, weight: sums of signed weights from samples and feedback (kind, poi_id), clipped. Rows combine before the shuffle."""
    none, cats = F.lit(""), places.select("poi_id", category_key(F.col("category")).alias("category"))
    w = lambda kind, intent, key, value: F.struct(F.lit(kind).alias("of"), intent.alias("intent"), key.cast("string").alias("key"), F.lit(value).alias("w"))
    expected = samples.select("intents", F.explode("expected").alias("x")).select("intents", "x.poi_id").join(cats, "poi_id")
    poi, cat = F.col("poi_id"), F.col("category")
    good = expected.select(F.inline(F.concat(F.array(w("poi", none, poi, 1.0), w("category", none, cat, 0.45)), F.transform("intents", lambda i: w("intent_category", i, cat, 0.6)))))
    bad = samples.select("intents", F.explode("negatives").alias("poi_id")).select(F.inline(F.transform("intents", lambda i: w("intent_penalty", i, poi, 0.45))))
    liked = F.array(w("poi", none, poi, 0.8), w("category", none, cat, 0.25))
    unfit = F.array(w("penalty", none, poi, 0.8), w("category", none, cat, -0.15))
    told = feedback.where(F.col("kind").isin("add_to_itinerary", "poi_not_fit")).join(cats, "poi_id").select(F.inline(F.when(F.col("kind") == "poi_not_fit", unfit).otherwise(liked)))
    total = good.unionByName(bad).unionByName(told).groupBy("of", "intent", "key").agg(F.sum("w").alias("w"))
    bounded = F.when(F.col("of") == "intent_penalty", clamp(F.col("w"), -2.5, 2.5)).otherwise(clamp(F.col("w"), -4.0, 4.0))
    return total.select(F.col("of").alias("kind"), "intent", "key", rounded(bounded, 4).alias("weight"))


def ranking_metrics(predicted: Column, expected: Column) -> dict[str, Column]:
    """Precision at the number of expected ids, recall, F1 and hit of two arrays of ids."""
    top = F.slice(predicted, F.lit(1), F.greatest(F.lit(1), F.size(expected)))
    p = F.when(F.size(top) > 0, F.size(F.array_intersect(top, expected)) / F.size(top)).otherwise(0.0)
    r = F.when(F.size(expected) > 0, F.size(F.array_intersect(predicted, expected)) / F.size(expected)).otherwise(0.0)
    return {"precision": rounded(p, 4), "recall": rounded(r, 4), "f1": rounded(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4), "hit": (F.size(F.array_intersect(predicted, expected)) > 0).cast("double")}


def learning_loop(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """stage, n and mean metrics of what is recommended before and after the places' learned weights reorder the candidates of each role."""
    slots = samples.select("index", F.transform("expected", lambda x: x["poi_id"]).alias("expected"), "lists", F.posexplode("intents").alias("slot", "role"))
    slots = slots.select("index", "expected", "slot", F.posexplode(F.slice(F.try_element_at("lists", F.concat(F.lit("intent:"), F.col("role"))), 1, TOP)).alias("rank", "poi_id"))
    learned = weights.where("kind = 'poi'").select(F.col("key").cast("long").alias("poi_id"), "weight")
    scored = slots.join(learned, "poi_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    best = scored.groupBy("index", "expected", "slot").agg(F.min_by("poi_id", "rank").alias("before"), F.min_by("poi_id", F.struct(-F.col("weight"), F.col("rank"))).alias("after"))
    per = best.groupBy("index", "expected").agg(*[F.array_distinct(R.ordered_array(F.col(s), F.col("slot"))).alias(s) for s in ("before", "after")])
    both = per.select("expected", F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("predicted")) for s in ("before", "after")])))
    m = ranking_metrics(F.col("predicted"), F.col("expected"))
    return both.select("stage", *[c.alias(n) for n, c in m.items()]).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(n), 4).alias(n) for n in m])
